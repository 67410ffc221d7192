"""Ranked lexical search for a table of queries: short lists summed first, long lists skipped through.

1. Documents become segments of bounded size, each with its own posting lists of
   the terms that queries hold. Segments are rows of a checkpoint, so no text and
   no posting is shuffled.
2. Two counts of documents and terms and one count per term complete the weights.
3. In a segment, a query's short lists are summed term at a time into one list
   of accumulators. This list then counts as one more iterator with an upper
   bound beside the long lists. Documents are visited in order: iterators whose
   bounds together stay below the score a hit must reach only confirm documents
   that another iterator offers, and are skipped through otherwise.
4. A task keeps the best of each query across its segments, which raises the
   score to beat; tasks hand on only these, and the best of all are ranked.

Queries are dealt into blocks of bounded size; a block's terms are all that tasks
are sent, and a block reads the whole table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, stored
from turnlake.session import cut_lineage

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # in lower-cased UTF-8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TOP = 10
BLOCK_CHARS = 2 << 20  # text of queries that tasks are sent at once
SEGMENT_DOCS = 16_384
SEGMENT_TERMS = 1_000_000  # terms of a segment's documents, repeats included
SHORT_POSTINGS = 2048  # postings a query's short lists hold together in a segment
STRIDE = 2048  # documents visited between two looks at the score to beat
SCALE, K1, B = 1_000_000_000, 1000, 75


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else []


@dataclass(frozen=True)
class Queries:
    """A block of queries: numbers of their distinct terms with how often each stands in the query."""

    numbers: list[int]
    terms: dict[bytes, int]
    wanted: list[list[tuple[int, int]]]


def read_queries(rows: Sequence[tuple[int, str | None]]) -> Queries:
    terms: dict[bytes, int] = {}
    wanted = []
    for _, text in rows:
        counts: dict[int, int] = {}
        for term in terms_of(text):
            place = terms.setdefault(term, len(terms))
            counts[place] = counts.get(place, 0) + 1
        wanted.append(list(counts.items()))
    return Queries([number for number, _ in rows], terms, wanted)


_SEGMENT = [
    ("ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())),
    ("terms", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int64())),
    ("docs", pa.list_(pa.int32())),
    ("counts", pa.list_(pa.int32())),
    ("n_docs", pa.int64()),
    ("n_terms", pa.int64()),
]
_SEGMENT_SQL = (
    "ids array<bigint>, lengths array<int>, terms array<int>, ends array<bigint>, docs array<int>, "
    "counts array<int>, n_docs bigint, n_terms bigint"
)


class _Segment:
    """Posting lists of the documents met so far."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.pairs: list[np.ndarray] = []  # number of the document << 32 | number of the term, repeats included
        self.n_terms = 0

    def add(self, doc_id: int | None, terms: list[bytes], wanted: dict[bytes, int]) -> None:
        found = [n for n in map(wanted.get, terms) if n is not None]
        self.n_terms += len(terms)
        if found:
            self.pairs.append(np.array(found, dtype=np.int64) + (len(self.ids) << 32))
            self.ids.append(doc_id)
            self.lengths.append(len(terms))

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros(0, dtype=np.int64)
        # By term, then document.
        keys, counts = np.unique((pairs & 0xFFFFFFFF) << 32 | pairs >> 32, return_counts=True)
        terms, ends = np.unique(keys >> 32, return_index=True)
        values = {
            "ids": self.ids,
            "lengths": self.lengths,
            "terms": terms.astype(np.int32),
            "ends": np.append(ends[1:], len(keys)) if len(terms) else [],
            "docs": (keys & 0xFFFFFFFF).astype(np.int32),
            "counts": counts.astype(np.int32),
            "n_docs": n_docs,
            "n_terms": n_terms,
        }
        nested = [pa.array([values[n]], t) for n, t in _SEGMENT]
        return pa.RecordBatch.from_arrays(nested, [n for n, _ in _SEGMENT])


def segments(docs: DataFrame, queries: Queries) -> DataFrame:
    """Segments of the documents (doc_id, text): posting lists of the queries' terms, and counts of all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(queries.terms)  # at most BLOCK_CHARS of text

    def run(batches):
        wanted, segment, n_docs, n_terms = shipped.value, _Segment(), 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                segment.add(doc_id, terms, wanted)
                n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                if len(segment.ids) >= SEGMENT_DOCS or segment.n_terms >= SEGMENT_TERMS:
                    yield segment.row(n_docs, n_terms)
                    segment, n_docs, n_terms = _Segment(), 0, 0
        if n_docs:
            yield segment.row(n_docs, n_terms)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SEGMENT_SQL)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The highest scores of one query so far; equal scores by ascending id, null last."""

    def __init__(self, size: int):
        self.size, self.scores, self.ids = size, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)

    @property
    def least(self) -> int:
        """Score below which nothing can enter."""
        return int(self.scores[-1]) if len(self.scores) >= self.size else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[: self.size]
        self.scores, self.ids = scores[order], ids[order]


@dataclass(frozen=True)
class List:
    """An iterator over documents in order: their numbers, their parts of the score and the largest of these."""

    docs: np.ndarray
    parts: np.ndarray
    most: int

    def at(self, docs: np.ndarray) -> np.ndarray:
        """Parts of the score of given documents, 0 where the list passes them by."""
        place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[place] == docs, self.parts[place], 0)


def summed(lists: Sequence[List]) -> List:
    """Accumulators of several lists, as one list."""
    docs, where = np.unique(np.concatenate([own.docs for own in lists]), return_inverse=True)
    parts = np.zeros(len(docs), dtype=np.int64)
    np.add.at(parts, where, np.concatenate([own.parts for own in lists]))
    return List(docs, parts, int(parts.max()))


def search_segment(lists: Sequence[List], n_docs: int, best: Best, ids: np.ndarray) -> None:
    """Offer the documents of a segment that can enter the best of a query."""
    lists = sorted(lists, key=lambda own: len(own.docs))
    sizes = np.cumsum([len(own.docs) for own in lists])
    short = int(np.searchsorted(sizes, SHORT_POSTINGS, side="right"))
    iterators = [summed(lists[:short])] if short else []
    iterators = sorted([*iterators, *lists[short:]], key=lambda own: own.most)
    bounds = np.cumsum([own.most for own in iterators])  # of the iterators up to each
    at = 0
    while at < n_docs:
        # Iterators before `offering` cannot lift a document of their own to the score to beat.
        offering = int(np.searchsorted(bounds, best.least))
        if offering == len(iterators):
            return
        ends = at + STRIDE
        inside = [own.docs[slice(*np.searchsorted(own.docs, (at, ends)))] for own in iterators[offering:]]
        if not any(map(len, inside)):
            nearest = [own.docs[i] for own in iterators[offering:] if (i := np.searchsorted(own.docs, ends)) < len(own.docs)]
            if not nearest:
                return
            at = int(min(nearest))
            continue
        docs = np.unique(np.concatenate(inside))
        scores = np.zeros(len(docs), dtype=np.int64)
        for own in iterators[offering:]:
            scores += own.at(docs)
        for i in range(offering - 1, -1, -1):
            open_ = scores + bounds[i] >= best.least
            docs, scores = docs[open_], scores[open_]
            if not len(docs):
                break
            scores = scores + iterators[i].at(docs)
        reached = np.flatnonzero(scores >= best.least)
        if len(reached) > best.size:  # of equal scores at the border all go on, ids decide
            border = np.partition(scores[reached], -best.size)[-best.size]
            reached = reached[scores[reached] >= border]
        if len(reached):
            best.offer(scores[reached], ids[docs[reached]])
        at = ends


def _lists(row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> dict[int, List]:
    """Posting lists of a segment by term, with the parts of the score of one occurrence in a query."""
    lengths = row["lengths"].astype(np.int64)
    # In Python's unbounded integers where a product could pass 64 bits.
    products = [100 - B + (B * n * n_docs) // n_terms for n in lengths.tolist()]
    m = np.array(products, dtype=np.int64)
    docs, counts = row["docs"], row["counts"].astype(np.int64)
    rates = (SCALE * counts) // (K1 * counts + 8 * m[docs])
    found, start = {}, 0
    for term, end in zip(row["terms"].tolist(), row["ends"].tolist(), strict=True):
        parts = weights[term] * rates[start:end]
        found[term] = List(docs[start:end], parts, int(parts.max()))
        start = end
    return found


def _block(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """(number, doc_id, score): the best documents of each query of a block, from each task."""
    spark = docs.sparkSession
    built = cut_lineage(segments(docs, queries))  # read row by row, as a row is large
    n_docs, n_terms = built.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    per_term = built.select(F.arrays_zip(F.col("terms").alias("term"), F.col("ends").alias("end")).alias("list"))
    sizes = F.transform(
        "list", lambda own, i: F.struct(own["term"].alias("term"), (own["end"] - F.when(i > 0, F.get("list", i - 1)["end"]).otherwise(0)).alias("n"))
    )
    counted = per_term.select(F.explode(sizes).alias("own")).groupBy("own.term").agg(F.sum("own.n").alias("df"))
    weights = np.zeros(len(queries.terms), dtype=np.int64)
    sizes_of = counted.toArrow()  # one row for each term of the block
    for term, df in zip(sizes_of.column("term").to_pylist(), sizes_of.column("df").to_pylist(), strict=True):
        weights[term] = weight(n_docs, df)
    shipped = spark.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shipped.value
        best = [Best(top) for _ in queries.numbers]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("lengths", "terms", "ends", "docs", "counts")}
                ids = np.array(batch.column("ids")[i].as_py(), dtype=object)
                lists = _lists(row, weights, n_docs, n_terms)
                for wanted, own in zip(queries.wanted, best, strict=True):
                    here = [
                        List(found.docs, found.parts * times, found.most * times)
                        for term, times in wanted
                        if (found := lists.get(term)) is not None and found.most > 0
                    ]
                    if here:
                        search_segment(here, len(ids), own, ids)
        counts = [len(own.scores) for own in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array(queries.numbers, dtype=np.int64), counts)),
                pa.array([x for own in best for x in own.ids.tolist()], pa.int64()),
                pa.array([x for own in best for x in own.scores.tolist()], pa.int64()),
            ],
            ["number", "doc_id", "score"],
        )

    return built.drop("n_docs", "n_terms").mapInArrow(run, "number bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text; whole
    texts count, at any length. The score sums, over an item's terms with
    repeats, weight * (SCALE * tf div (1000 * tf + 8 * m)); only scores above 0
    count. Equal scores stand by ascending doc_id, rows without a doc_id last;
    rows that repeat a document are documents of their own. Items without a
    known term, null or empty ones too, get no row; rows that repeat an item_id
    are ranked each by itself. Empty tables give an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    numbered = stored(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "items")
    size = numbered.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    found: DataFrame = spark.createDataFrame([], "number bigint, doc_id bigint, score bigint")
    for block in range(blocks):
        own = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "text")
        queries = read_queries([tuple(r) for r in own.collect()])
        if queries.terms:
            found = found.union(_block(docs, queries, top))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
