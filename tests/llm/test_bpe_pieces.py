"""Pieces between blanks, merges by pairs of ids, and the fold over them."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from turnlake.llm import bpe

PATTERN = public_tokenizers.PATTERN
ODD = ["  a  b \n c", " x", "a ", "\n\n d", "it's 'll  \n\n  ok", "", None, " ", "x　 y 　z", "\x1c a \x1c", "\x85 q \x85", "a\n b\n\n c", "\na b"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def table_of(words, ranks):
    ids = [np.array(bpe.merge_long(w.encode(), ranks), dtype=np.uint16).view(np.int16) for w in words]
    return bpe.WordTable(pa.array(words, pa.string()), pa.array(ids, pa.list_(pa.int16())), np.dtype(np.uint16))


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(" \n\ta'sé1.　\x1c\x85​") for _ in range(rng.randrange(30))) for _ in range(2000)]
    return [*ODD, *made]


@pytest.mark.parametrize("pattern", [PATTERN, PATTERN + "|x^"])
def test_words_of_pieces_are_the_words_of_the_text(ranks, pattern):
    assert bpe.Pieces(pattern, table_of([], ranks), ranks, {}).at_blanks == (pattern == bpe.CUT_AT_BLANKS)
    known, rest = bpe.Pieces(pattern, table_of([], ranks), ranks, {}).look_up(pa.array(odd_texts(), pa.string()))
    for text, ids, words in zip(odd_texts(), known.to_pylist(), rest.to_pylist(), strict=True):
        found = regex.findall(PATTERN, text or "")
        assert [w.encode("iso-8859-1").decode() for w in words] == found
        assert ids == b"\xff\xff" * len(found)


def test_only_different_pieces_are_cut_into_words(ranks):
    pieces = bpe.Pieces(PATTERN, table_of(["word", " word"], ranks), ranks, {})
    seen, cut = [], pieces.words
    pieces.words = lambda text: seen.append(len(text)) or cut(text)
    known, _ = pieces.look_up(pa.array(["word" + " word" * 10_000] * 20, pa.string()))
    assert len(known) == 20 and sum(seen) < 1000


def test_encode_odd_texts(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(odd_texts()[:300])), "doc_id int, text string")
    for row in bpe.encode(docs, ranks, PATTERN, ("ids",), table_words=5).collect():
        assert row.ids == library.encode_ordinary(row.text or "")


def test_fold_merges_by_pairs_of_ids(spark, ranks):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdet hingé中") for _ in range(rng.randrange(1, 30))).encode() for _ in range(300)]
    rows = spark.createDataFrame([(w, [w.decode("iso-8859-1")]) for w in words], "raw binary, word array<string>")
    for row in rows.select("raw", bpe.fold_all(bpe.read_merges(ranks), F.col("word"))[0].alias("ids")).collect():
        assert row.ids == bpe.merge_long(bytes(row.raw), ranks)


def test_tokens_that_no_merge_makes_are_whole_words_only(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257}
    assert bpe.read_merges(ranks).whole == {b"xyz": 257}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz", "xyz xyz abxyz", "xyzab ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for words in (0, 100):
        for row in bpe.encode(docs, ranks, PATTERN, ("ids",), table_words=words).collect():
            assert row.ids == library.encode_ordinary(row.text)
