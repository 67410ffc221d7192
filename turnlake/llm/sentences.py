"""Substring dedup over sliding spans of sentences.

Sentences are cut further at inner borders the characters beside them decide, so
a passage glued to foreign words has the same pieces inside. At every piece one
span starts and one ends: the fewest consecutive pieces that hold MIN_WORDS
words. Spans are hashed, joined over all documents, and every piece covered by a
repeated span goes, except where that span stands first.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import appended, bounded_batches, extended, stored, without

MIN_WORDS = 25  # two short stock lines stay below; a longer run loses at most the words outside its first and last border
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
CHARACTER = re.compile(f"[{UNSPACED}]")  # of scripts without blanks; two count as a word


def _class(first: int, last: int, step: int, rest: int) -> str:
    """Characters whose lower-case form leaves ``rest`` by ``step``, for use in brackets."""
    chosen = (chr(i) for i in range(first, last) if ord(chr(i).lower()[0]) % step == rest)
    return "".join(re.escape(c) for c in chosen if not c.isspace())


# All borders of BLANKS start with white space, which the search can look for; the others are for texts that hold UNSPACED.
BLANKS = (
    r"\s(?:(?<=[.!?…。！？]\s)\s*|\s*\n\s*|(?<=\n)\s*"
    rf"|(?<=[{_class(0x21, 0x3000, 3, 0)}]\s)\s*(?=[{_class(0x21, 0x3000, 3, 1)}]))"
)
BORDER = re.compile(BLANKS)
BORDER_UNSPACED = re.compile(
    rf"{BLANKS}|(?<=[。！？，、；：])(?=\S)|(?<=[{_class(0x3040, 0xA000, 4, 0)}])(?=[{_class(0x3040, 0xA000, 4, 1)}])"
)
ADDED = ("n_sentences", "n_removed", "removed")


def cut(text: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces of sentences; trailing white space belongs to the piece before it."""
    border = BORDER if text.isascii() or not CHARACTER.search(text) else BORDER_UNSPACED
    ends = [m.end() for m in border.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    starts = [0, *ends[:-1]]
    return [(a, b) for a, b in zip(starts, ends, strict=True) if b > a]


def words_in(words: list[str]) -> int:
    """Words, and half the characters of scripts without blanks."""
    spaced, characters = CHARACTER.subn(" ", " ".join(words))
    return len(spaced.split()) + (characters + 1) // 2


def spans_of(text: str) -> list[tuple[bytes, int, int]]:
    """(hash, first piece, number of pieces) of every span; case and white space do not count."""
    split = [text[a:b].lower().split() for a, b in cut(text)]
    pieces = [" ".join(words) for words in split]
    spaced = text.isascii() or not CHARACTER.search(text)
    sizes = [len(words) if spaced else words_in(words) for words in split]
    # White space alone holds no word; a span neither starts nor ends with it.
    places, end, words = set(), 0, 0
    for start in range(len(pieces)):
        while end < len(pieces) and words < MIN_WORDS:
            words += sizes[end]
            end += 1
        if words < MIN_WORDS:
            break
        if sizes[start]:
            places.add((start, end))
        words -= sizes[start]
    start, words = 0, 0
    for end, size in enumerate(sizes, 1):
        words += size
        while words - sizes[start] >= MIN_WORDS:
            words -= sizes[start]
            start += 1
        if size and words >= MIN_WORDS:
            while not sizes[start]:
                start += 1
            places.add((start, end))
    found = []
    for start, end in sorted(places):
        own = " ".join(filter(None, pieces[start:end])).encode("utf-8", "surrogatepass")
        found.append((hashlib.blake2b(own, digest_size=16).digest(), start, end - start))
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` less its repeated sentences, n_sentences, n_removed and removed.

    Sentences cut at inner borders are counted by their pieces.
    ``removed`` lists (start, end) of what went, in code points of the old text.
    A text without repeated span stays as it is, to the byte. First is the span
    with the smallest doc_id, then the smallest place.

    Null text stays null; null, empty and short texts have no span. Rows without
    a doc_id are neither searched nor changed. Rows equal in doc_id and text are
    one document and change alike. Texts of any length are read whole. An empty
    table gives an empty one. Columns of the added names are replaced, others kept.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, ADDED)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spans(batches):
        for batch in batches:
            ids, hashes, own, first, count = [], [], [], [], []
            rows = zip(*[batch.column(n).to_pylist() for n in ("doc_id", "_hash", "text")], strict=True)
            for doc_id, text_hash, text in rows:
                for digest, start, length in spans_of(text):
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    own.append(digest)
                    first.append(start)
                    count.append(length)
            halves = np.frombuffer(b"".join(own), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0].copy()),
                    pa.array(halves[:, 1].copy()),
                    pa.array(ids, batch.column("doc_id").type),
                    pa.array(hashes, pa.int64()),
                    pa.array(first, pa.int32()),
                    pa.array(count, pa.int32()),
                ],
                ["a", "b", "doc_id", "hash", "first", "n"],
            )

    keyed = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("_hash"), "text"
    )
    found = keyed.mapInArrow(spans, f"a bigint, b bigint, doc_id {kind}, hash bigint, first int, n int")
    place = F.struct("doc_id", "hash", "first")
    # Most spans stand once: what stands twice is found by halves of hashes and of places, in rows of fixed size.
    spot = F.xxhash64("doc_id", "hash", "first")
    twice = found.groupBy("a").agg(F.min(spot).alias("_low"), F.max(spot).alias("_high")).filter("_low <> _high")
    repeated = stored(found.join(stored(twice.select("a"), "repeated"), "a"), "repeated")
    # A table, so that the join may split a span that very many documents hold.
    origins = stored(repeated.groupBy("a", "b").agg(F.min(place).alias("origin")), "origins")
    later = repeated.join(origins, ["a", "b"]).filter(place != F.col("origin"))
    gone = (
        later.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_of"))
        .agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("_gone"))
    )
    marked = docs.withColumn("_hash", F.xxhash64("text"))
    joined = marked.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")
    rows = joined.select(*docs.columns, "_gone")
    names = docs.columns
    place_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    added = pa.schema([("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", place_type)])

    def rebuild(batches):
        for batch in batches:
            texts, totals, counts, removed = [], [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                sentences = cut(text) if text else []
                covered = sorted({i for g in gone or () for i in range(g["first"], g["first"] + g["n"])})
                left, last = [], 0
                for i in covered:
                    left.append(text[last : sentences[i][0]])
                    last = sentences[i][1]
                texts.append(text if not covered else "".join([*left, text[last:]]))
                totals.append(len(sentences))
                counts.append(len(covered))
                removed.append([{"start": sentences[i][0], "end": sentences[i][1]} for i in covered])
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            more = [pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, place_type)]
            yield appended(columns, names, more, added)

    return rows.mapInArrow(rebuild, extended(docs.schema, added))
