"""Order MinHash fingerprints: sensitive to edit distance, not only to the set of k-mers.

The k-mers of a text are numbered by occurrence, so a repeated k-mer counts as
often as it stands there. Their hashes fall into BINS bins; of each bin the
TUPLE smallest are taken, put back in the order they have in the text, and
hashed together. Two texts agree in a bin when they share those k-mers and
their order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import appended, bounded_batches, extended, without
from turnlake.llm.shingles import mix

K = 5  # code points of a k-mer; a shorter text is one k-mer
BINS = 64
TUPLE = 2
_PLACE_BITS = 31  # places of the longest string a column can hold
ADDED = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _ranked(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (upper bits) in order, equal ones by place, with their places."""
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    packed = np.sort((hashes & ~mask) | places.astype(np.uint64))
    return packed & ~mask, (packed & mask).astype(np.int64)


def fingerprint(text: str) -> np.ndarray:
    """One number per bin, 0 for a bin without k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    made = np.zeros(BINS, dtype=np.uint32)
    if not len(points):
        return made
    width = min(K, len(points))
    hashes = np.zeros(len(points) - width + 1, dtype=np.uint64)
    for i in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - width + 1 + i] + np.uint64(1)
    hashes = mix(hashes, width)
    kmers, places = _ranked(hashes, np.arange(len(hashes)))
    fresh = np.flatnonzero(np.concatenate([[True], kmers[1:] != kmers[:-1]]))
    occurrence = np.arange(len(kmers)) - np.repeat(fresh, np.diff(np.append(fresh, len(kmers))))
    keys, places = _ranked(mix(kmers + occurrence.astype(np.uint64), 3), places)
    bins = (keys >> np.uint64(58)).astype(np.int64)
    starts = np.searchsorted(bins, np.arange(BINS))
    # The smallest of each bin, later ones missing where a bin holds fewer.
    chosen = starts[:, None] + np.arange(TUPLE)[None, :]
    inside = np.minimum(chosen, len(keys) - 1)
    there = (chosen < len(keys)) & (bins[inside] == np.arange(BINS)[:, None])
    order = np.argsort(np.where(there, places[inside], np.iinfo(np.int64).max), axis=1, kind="stable")
    picked = np.take_along_axis(np.where(there, keys[inside], np.uint64(0)), order, axis=1)
    total = np.zeros(BINS, dtype=np.uint64)
    for column in picked.T:
        total = mix(total + column, 9)
    short = (total >> np.uint64(32)).astype(np.uint32)
    return np.where(there.any(axis=1), np.maximum(short, 1), 0).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of bins, of those filled in either, in which both agree; two empty texts are alike."""
    filled = (a != 0) | (b != 0)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with ``_part`` and ``_border``: ranges of descending doc_id, each followed by the first row of the next.

    Only ids are read to find the ranges. What comes to the driver is one id and
    one hash per range.
    """
    steps = [i / parts for i in range(1, parts)] or [0.5]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), F.lit(10_000))).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: F.col("doc_id") <= c))
    )
    keyed = docs.withColumns({"_part": part.cast("int"), "_hash": F.xxhash64("text")})
    head = F.max(F.struct("doc_id", "_hash")).alias("head")
    heads = sorted(keyed.groupBy("_part").agg(head).collect(), key=lambda r: r["_part"])
    after = docs.sparkSession.createDataFrame(
        [
            (heads[i - 1]["_part"], r["_part"], r["head"]["doc_id"], r["head"]["_hash"])
            for i, r in enumerate(heads)
        ],
        "_before int, _own int, _id bigint, _first bigint",
    )
    same = (
        (F.col("_part") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_first"))
    )
    marked = keyed.join(F.broadcast(after), same, "left")  # one row per range
    own = F.struct(F.col("_part").alias("_part"), F.lit(False).alias("_border"))
    copy = F.struct(F.col("_before").alias("_part"), F.lit(True).alias("_border"))
    to = F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to")
    return marked.select(*docs.columns, "_hash", to).select(*docs.columns, "_hash", "to.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Documents with their fingerprint and that of their edited text, and two likenesses.

    The next document is the one with the next smaller doc_id, null ids last;
    rows of one doc_id stand in a fixed order of their texts' hashes; after the
    last comes the first, which for a single row is itself. Each text goes over
    the network once: ranges of doc_id are sorted, and a task walks through its
    range with one text in hand.

    Null text counts as empty. Texts of any length are read whole. An empty
    table gives an empty one. Existing columns of the added names are replaced,
    others kept. doc_id must be an integer.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, ADDED)
    names = docs.columns
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(docs, parts)
    ordered = dealt.repartition(parts, "_part").sortWithinPartitions(
        "_part", "_border", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc()
    )
    added = pa.schema(
        [
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )
    def compared(text, own, following, other):
        changed = edited(text, following)
        print_ = fingerprint(changed)
        return (
            len(text),
            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            own.tobytes().hex(),
            print_.tobytes().hex(),
            likeness(own, print_),
            likeness(own, other),
        )

    def run(batches):
        waiting = None  # (part, row of the own columns, text, fingerprint)
        for batch in batches:
            rows, made = [], []
            texts = batch.column("text").to_pylist()
            for i, (part, border) in enumerate(
                zip(batch.column("_part").to_pylist(), batch.column("_border").to_pylist(), strict=True)
            ):
                text = texts[i] or ""
                if border and (waiting is None or waiting[0] != part):
                    continue  # the border was met already by an equal row
                print_ = fingerprint(text)
                if waiting is not None:
                    rows.append(waiting[1])
                    made.append(compared(waiting[2], waiting[3], text, print_))
                waiting = None if border else (part, batch.slice(i, 1).select(names), text, print_)
            if rows:
                table = pa.Table.from_batches(rows).combine_chunks()
                columns = [table.column(n).combine_chunks() for n in names]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield appended(columns, names, [pa.array([m[k] for m in made], f.type) for k, f in enumerate(added)], added)

    return ordered.mapInArrow(run, extended(docs.schema, added))
