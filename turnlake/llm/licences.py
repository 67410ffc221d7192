"""Licence scans: ordered signature rules, gated by keywords, with overlaps resolved by priority.

A rule is a label, a keyword, a priority and a pattern over normalised words.
Rules stand in a small table. A text is joined with the rules whose keyword it
holds, so the patterns of other rules are never run on it and a text without
any keyword stops at the gate. Of overlapping detections the one contained in
another with at least its priority goes. Detections are placed by word number.
Everything is built-in Spark functions and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import spans
from turnlake.llm.common import string_or_empty, without

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
NOT_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
LONGEST = 16  # words of the longest rule
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

# The fixed phrases and labels of the contract.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Families: label, names (patterns over lower-case words joined by blanks), short identifiers, versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl", "gnu public licen[sc]e"), ("gpl",), ("1", "2", "3")),
    ("lgpl", ("gnu (?:lesser|library) general public licen[sc]e", "gnu lgpl"), ("lgpl",), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e"), ("agpl",), ("1", "3")),
    ("gfdl", ("gnu free documentation licen[sc]e",), ("gfdl",), ("1 1", "1 2", "1 3")),
    ("apache", ("apache (?:software )?licen[sc]e",), ("apache",), ("1", "1 1", "2", "2 0")),
    ("mit", ("mit licen[sc]e", "expat licen[sc]e", "mit x11 licen[sc]e"), ("mit",), ("0",)),
    ("bsd", ("bsd licen[sc]e", "berkeley software distribution licen[sc]e"), ("bsd",), ("2", "3", "4")),
    ("isc", ("isc licen[sc]e", "internet systems consortium licen[sc]e"), ("isc",), ()),
    ("mpl", ("mozilla public licen[sc]e",), ("mpl",), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public licen[sc]e",), ("epl",), ("1 0", "2 0")),
    ("edl", ("eclipse distribution licen[sc]e",), ("edl",), ("1 0",)),
    ("cddl", ("common development and distribution licen[sc]e",), ("cddl",), ("1 0", "1 1")),
    ("cpl", ("common public licen[sc]e",), ("cpl",), ("1 0",)),
    ("eupl", ("european union public licen[sc]e",), ("eupl",), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e"), ("artistic",), ("1 0", "2 0")),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ("zlib",), ()),
    ("boost", ("boost software licen[sc]e",), ("bsl",), ("1 0",)),
    ("unlicense", ("the unlicen[sc]e", "unlicen[sc]e"), ("unlicense",), ()),
    ("wtfpl", ("do what the fuck you want to public licen[sc]e",), ("wtfpl",), ("2",)),
    ("psf", ("python software foundation licen[sc]e", "psf licen[sc]e"), ("psf", "python"), ("2 0",)),
    ("php", ("php licen[sc]e",), ("php",), ("3 0", "3 01")),
    ("ruby", ("ruby licen[sc]e",), ("ruby",), ()),
    ("openssl", ("openssl licen[sc]e", "ssleay licen[sc]e"), ("openssl",), ()),
    ("postgresql", ("postgresql licen[sc]e",), ("postgresql",), ()),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("ofl",), ("1 0", "1 1")),
    ("odbl", ("open database licen[sc]e", "odc open database licen[sc]e"), ("odbl",), ("1 0",)),
    ("pddl", ("public domain dedication and licen[sc]e",), ("pddl",), ("1 0",)),
    ("afl", ("academic free licen[sc]e",), ("afl",), ("1 1", "2 1", "3 0")),
    ("osl", ("open software licen[sc]e",), ("osl",), ("1 0", "2 1", "3 0")),
    ("upl", ("universal permissive licen[sc]e",), ("upl",), ("1 0",)),
    ("ms-pl", ("microsoft public licen[sc]e",), ("ms pl",), ()),
    ("ms-rl", ("microsoft reciprocal licen[sc]e",), ("ms rl",), ()),
    ("apsl", ("apple public source licen[sc]e",), ("apsl",), ("1 0", "2 0")),
    ("lppl", ("latex project public licen[sc]e",), ("lppl",), ("1 0", "1 2", "1 3")),
    ("qpl", ("q public licen[sc]e",), ("qpl",), ("1 0",)),
    ("ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa open source licen[sc]e"), ("ncsa",), ()),
    ("w3c", ("w3c software notice and licen[sc]e", "w3c licen[sc]e"), ("w3c",), ()),
    ("cecill", ("cecill free software licen[sc]e agreement",), ("cecill",), ("1 0", "2 0", "2 1")),
    ("sspl", ("server side public licen[sc]e",), ("sspl",), ("1 0",)),
    ("busl", ("business source licen[sc]e",), ("busl",), ("1 0", "1 1")),
    ("elastic", ("elastic licen[sc]e",), ("elastic",), ("1 0", "2 0")),
    ("mulan", ("mulan permissive software licen[sc]e", "mulan psl"), ("mulanpsl",), ("1 0", "2 0")),
    ("blueoak", ("blue oak model licen[sc]e",), ("blueoak",), ("1 0 0",)),
    ("zpl", ("zope public licen[sc]e",), ("zpl",), ("1 1", "2 0", "2 1")),
    ("sleepycat", ("sleepycat licen[sc]e",), ("sleepycat",), ()),
    ("vim", ("vim licen[sc]e",), ("vim",), ()),
    ("json", ("json licen[sc]e",), ("json",), ()),
    ("cc0", ("creative commons zero", "cc0 public domain dedication", "cc0 licen[sc]e"), ("cc0",), ("1 0",)),
)
# Creative Commons: label, the part after "cc", the spelled form.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
# Notices: label, keyword, priority, pattern.
NOTICES = (
    ("bsd", "redistribution", 70, "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "endorse", 40, "may be used to endorse or promote products derived from this software"),
    ("mit", "permission", 70, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 70, "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "altered", 60, "altered source versions must be plainly marked as such"),
    ("public-domain", "domain", 50, "(?:released|placed|dedicated) (?:in|in to|into|to) the public domain"),
    ("public-domain", "domain", 40, "this (?:work|file|software) is in the public domain"),
    ("proprietary", "rights", 20, "all rights reserved"),
    ("proprietary", "confidential", 30, "proprietary and confidential"),
    ("warranty-disclaimer", "warrant", 10, "without (?:any )?warranty of any kind"),
    ("unlicense", "unencumbered", 70, "free and unencumbered software released into the public domain"),
)


def _keyword(name: str) -> str:
    """A keyword every text that matches the pattern ``name`` holds."""
    if "licen" in name:
        return "licen"
    return next(k for k in ("creative commons", "cc0", "gnu", "psl") if k in name)


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, pattern), highest priority first; patterns match whole words of a blank-joined text."""
    made = [(label, "licen" if "licen" in phrase else "cc ", 50, phrase) for phrase, label in BASE]
    for label, names, shorts, versions in FAMILIES:
        for name in names:
            made.append((label, _keyword(name), 50, name))
            made.append((label, _keyword(name), 60, rf"(?:licen[sc]ed|released|distributed|available) under (?:the )?{name}"))
            for version in versions:
                made.append((f"{label}-{version.replace(' ', '.')}", _keyword(name), 65, rf"{name} (?:version |v ?)?{version}"))
        for short in shorts:
            made.append((label, "spdx", 80, rf"spdx licen[sc]e identifier {short}"))
            for version in versions:
                tag = rf"spdx licen[sc]e identifier {short} {version}"
                made.append((f"{label}-{version.replace(' ', '.')}", "spdx", 85, tag))
    for label, part, spelled in COMMONS:
        made.append((label, "cc ", 50 + len(part), rf"cc {part}"))
        made.append((label, "creative commons", 50 + len(part), rf"creative commons {spelled}"))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            made.append((f"{label}-{version.replace(' ', '.')}", "cc ", 60 + len(part), rf"cc {part} {version}"))
            name = rf"creative commons {spelled} (?:[0-9a-z]+ )?{version}"
            made.append((f"{label}-{version.replace(' ', '.')}", "creative commons", 60 + len(part), name))
    return sorted({*made, *NOTICES}, key=lambda r: (-r[2], r))


def normalised(text: Column) -> Column:
    """Words in lower case (A-Z only) with one blank before, between and after."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, NOT_WORD, " "), F.lit(" "))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_replace(F.translate(spaced, capitals, small), " +", " ")


def _words_before(text: Column, at: Column) -> Column:
    """Number of words before code point ``at`` of a normalised text; ``at`` is the blank before a word."""
    prefix = F.substring(text, F.lit(1), at)
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit("")))).cast("bigint")


def _placed(text: Column, pattern: Column) -> Column:
    """(first, end) word numbers of the matches of a rule; neighbours share the blank between them."""
    searched = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))
    found = F.regexp_extract_all(text, searched, F.lit(0))

    def with_pieces(pieces: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return spans.bound(
            spans.running_sums(lengths),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    _words_before(text, F.get(ends, i) - F.length(m)).alias("first"),
                    _words_before(text, F.get(ends, i)).alias("end"),
                ),
            ),
        )

    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return F.when(F.size(found) > 0, spans.bound(F.split(text, searched, -1), with_pieces)).otherwise(none)


def _holds(low: Column, keyword: str) -> Column:
    """Cheap necessary condition of the rules of a keyword."""
    parts = keyword.split()
    if keyword == "cc ":
        return low.rlike(f"cc{NOT_WORD}by")
    return low.rlike(NOT_WORD.join(parts)) if len(parts) > 1 else F.contains(low, F.lit(keyword))


def rule_table(spark: SparkSession) -> DataFrame:
    """One row per rule: a few hundred, whatever the data."""
    base = {(label, 50, phrase) for phrase, label in BASE}
    rows = [(label, word, rank, pattern, (label, rank, pattern) in base) for label, word, rank, pattern in rules()]
    return spark.createDataFrame(rows, "label string, keyword string, priority int, pattern string, base boolean")


def scan(docs: DataFrame) -> DataFrame:
    """Documents with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    ``detections`` lists (first, end, priority, label) in word numbers after
    suppression; ``score`` is the highest priority left, as a share of 100.
    Base places and labels are never suppressed.

    Null text counts as empty: no words, no places, empty labels, score 0. Texts
    of any length are read whole. Rows are told apart by doc_id and text, either
    of which may be null or repeated. An empty table gives an empty one. Existing
    columns of the added names are replaced, others kept.
    """
    docs = without(docs, ADDED)
    spark = docs.sparkSession
    table = rule_table(spark)
    keywords = sorted({r[1] for r in rules()})
    text = string_or_empty("text")
    low = F.lower(text)
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64("text")})

    gates = [F.when(_holds(low, k), F.lit(k)) for k in keywords]
    held = F.array_compact(F.array(*gates))
    gated = (
        keyed.select("_id", "_hash", text.alias("text"), held.alias("_keys"))
        .filter(F.size("_keys") > 0)
        .withColumn("_text", normalised(F.col("text")))
        .select("_id", "_hash", "_text", F.explode("_keys").alias("keyword"))
    )
    hits = (
        gated.join(F.broadcast(table), "keyword")
        .withColumn("place", F.explode(_placed(F.col("_text"), F.col("pattern"))))
        .groupBy(F.col("_id").alias("_to"), F.col("_hash").alias("_of"))
        .agg(F.array_sort(F.collect_set(F.struct("place.first", "place.end", "priority", "label", "base"))).alias("_hits"))
    )

    def covers(a: Column, b: Column) -> Column:
        wider = (a["first"] <= b["first"]) & (a["end"] >= b["end"])
        larger = (a["end"] - a["first"] > b["end"] - b["first"]) | (a["priority"] > b["priority"])
        return wider & larger & (a["priority"] >= b["priority"])

    # Sorted by first word, what covers a detection stands near it: a start lies at most LONGEST words
    # before, and no word starts more detections than there are rules.
    reach = LONGEST * len(rules())

    def near(i: Column) -> Column:
        return F.slice("_hits", F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach + 1))

    kept = F.filter("_hits", lambda b, i: ~F.exists(near(i), lambda a: covers(a, b)))
    same = F.col("_id").eqNullSafe(F.col("_to")) & (F.col("_hash") == F.col("_of"))
    counted = keyed.withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("bigint"))
    joined = counted.join(hits, same, "left").withColumn("_hits", F.coalesce("_hits", F.expr("array()")))
    base = F.filter("_hits", lambda h: h["base"])
    joined = joined.withColumns({"_base": base, "_kept": kept})
    names = F.array_sort(F.array_distinct(F.transform("_base", lambda h: h["label"])))
    every = F.array_union(F.transform("_base", lambda h: h["label"]), F.transform("_kept", lambda h: h["label"]))
    return joined.select(
        *docs.columns,
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_base", lambda h: h["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda h: h["first"])).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda h: h["priority"])) / 100.0, F.lit(0.0)).alias("score"),
        F.transform(
            "_kept", lambda h: F.struct(h["first"].alias("first"), h["end"].alias("end"), h["priority"], h["label"])
        ).alias("detections"),
    )
