"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one distributed count of n-gram buckets per language. The
log-probability matrix has a fixed number of buckets, so it is broadcast; a
batch of texts is scored by gathering the rows its n-grams hit and adding them
up per text, which is the product of the sparse count matrix with the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import appended, bounded_batches, extended, stored, with_arrow_columns

ORDERS = (1, 2, 3)
BITS = 16
ALPHA = 0.5
BLOCK_LANGUAGES = 64  # about so many labels are scored at once; bounds the matrix, 2**BITS x labels floats
BLOCK = 1 << 20  # characters hashed at a time
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (buckets, languages): log P(bucket | language)
    priors: np.ndarray


@dataclass(frozen=True)
class Blocks:
    """Counts of more labels than one matrix holds, dealt into blocks by a hash of the label."""

    counts: DataFrame
    number: int
    n_docs: int

    def model(self, block: int) -> Model:
        return _block_model(self.counts.filter(F.col("block") == block), self.n_docs)


def _code_points(text: str) -> np.ndarray:
    """Lower-cased code points between two blanks; lone surrogates pass as they are."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def buckets(text: str):
    """Arrays of bucket numbers of all n-grams of a text, a block of characters at a time."""
    points = _code_points(text)
    for start in range(0, len(points), BLOCK):
        part = points[start : start + BLOCK + max(ORDERS) - 1]
        hashed = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(part) < n:
                break
            hashed = hashed[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                own = mixed[: min(BLOCK, len(part))]  # starts of the next block are counted there
                yield (own >> np.uint64(64 - BITS)).astype(np.int64)


def train(labelled: DataFrame) -> Model | Blocks:
    """Model of rows (text, lang), in blocks where labels are many; rows without text or label are passed over."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for found in buckets(text):
                    own += np.bincount(found, minlength=1 << BITS)
        for lang, own in counts.items():
            hit = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * (len(hit) + 1)),
                    "bucket": pa.array(np.append(hit, -1).astype(np.int32)),  # -1: number of documents
                    "n": pa.array(np.append(own[hit], docs[lang])),
                }
            )

    bounded_batches(labelled.sparkSession)
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    summed = stored(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    n_labels, n_docs = summed.filter("bucket < 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = -(-n_labels // BLOCK_LANGUAGES)
    if blocks <= 1:
        return _block_model(summed, n_docs or 0)
    return Blocks(summed.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks))), blocks, n_docs)


def _block_model(summed: DataFrame, n_docs: int) -> Model:
    found = summed.select("lang", "bucket", "n").toArrow()  # about BLOCK_LANGUAGES labels
    names = found.column("lang").combine_chunks().dictionary_encode()
    languages = tuple(sorted(names.dictionary.to_pylist()))
    matrix = np.zeros(((1 << BITS), len(languages)), dtype=np.float64)
    docs = np.zeros(len(languages), dtype=np.float64)
    if languages:
        place = {language: i for i, language in enumerate(languages)}
        where = np.array([place[n] for n in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
        is_doc = bucket < 0
        docs[where[is_doc]] = n[is_doc]
        matrix[bucket[~is_doc], where[~is_doc]] = n[~is_doc]
    weights = np.log(matrix + ALPHA) - np.log(matrix.sum(axis=0) + ALPHA * (1 << BITS))
    priors = np.log(docs / n_docs) if languages else docs
    return Model(languages, weights.astype(np.float32), priors)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def totals(text: str, model: Model) -> np.ndarray:
    """Log-probability of a text with each language."""
    total = model.priors.copy()
    for found in buckets(text):
        total += model.weights[found].sum(axis=0, dtype=np.float64)
    return total


def score(text: str | None, model: Model) -> tuple[str, float]:
    """Most likely language and its posterior probability; ties go to the first in order."""
    if text is None or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    total = totals(text, model)
    best = int(np.argmax(total))
    return model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def detect(docs: DataFrame, model: Model | Blocks) -> DataFrame:
    """Documents with lang_pred and score (0 to 1).

    Only ``text`` is read. Null text, text without a letter (so also empty
    text), or a model without any language gives ``und`` and score 0. Texts of
    any length are scored whole, a block at a time. Equal texts score alike.
    Existing columns named lang_pred and score are replaced, others kept. Any
    number of labels is scored, a block of them in each pass over the texts.
    """
    if isinstance(model, Blocks):
        return _detect_in_blocks(docs, model)
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.priors))

    def compute(batch):
        own = Model(*shipped.value)
        found = [score(text, own) for text in batch.column("text").to_pylist()]
        return [
            pa.array([lang for lang, _ in found], pa.string()),
            pa.array([p for _, p in found], pa.float64()),
        ]

    return with_arrow_columns(docs, compute, pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]))


def _detect_in_blocks(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """One pass for each block: the best label so far, its total, and all probability relative to it."""
    bounded_batches(docs.sparkSession)
    context, names = docs.sparkSession.sparkContext, [n for n in docs.columns if n not in ("lang_pred", "score")]
    fields = pa.schema([("_lang", pa.string()), ("_total", pa.float64()), ("_mass", pa.float64())])
    rows = docs.select(*names).withColumns(
        {"_lang": F.lit(None).cast("string"), "_total": F.lit(None).cast("double"), "_mass": F.lit(None).cast("double")}
    )
    for block in range(blocks.number):
        model = blocks.model(block)
        if not model.languages:
            continue
        shipped = context.broadcast((model.languages, model.weights, model.priors))

        def compute(batch, shipped=shipped):
            own, made = Model(*shipped.value), []
            before = zip(*[batch.column(c).to_pylist() for c in ("text", "_lang", "_total", "_mass")], strict=True)
            for text, lang, most, mass in before:
                if text is not None and has_letter(text):
                    total = totals(text, own)
                    best = int(np.argmax(total))
                    here, name = float(total[best]), own.languages[best]
                    own_mass = float(np.exp(total - here).sum())
                    if lang is None:
                        lang, most, mass = name, here, own_mass
                    else:
                        top = max(here, most)
                        mass = mass * float(np.exp(most - top)) + own_mass * float(np.exp(here - top))
                        if here > most or (here == most and name < lang):
                            lang = name
                        most = top
                made.append((lang, most, mass))
            return [pa.array([m[i] for m in made], fields.field(i).type) for i in range(3)]

        def run(batches, compute=compute):
            for batch in batches:
                yield appended([batch.column(n) for n in names], names, compute(batch), fields)

        rows = stored(rows.mapInArrow(run, extended(docs.select(*names).schema, fields)), "scored")
        shipped.unpersist()
    return (
        rows.withColumn("lang_pred", F.coalesce("_lang", F.lit(UNKNOWN)))
        .withColumn("score", F.coalesce(1.0 / F.col("_mass"), F.lit(0.0)))
        .drop("_lang", "_total", "_mass")
    )


def fold_of(doc_id: str) -> Column:
    """Fold 0 to 4 of a document; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)).cast("int")
