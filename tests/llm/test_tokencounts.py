"""Token counts against the tokenizers library, at every prefix."""

from __future__ import annotations

import json
import pickle
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnlake.llm import tokencounts
from turnlake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "Hello  world,\n\n  it's we'll they've don't  'r 'l 'lx \t\n x",
    "a <|endoftext|> b..<|endoftext|><|endoftext|>  <|endo",
    "  <|endoftext|>  x<|endoftext|>",
    "<|endoftext|",
    "'ll 've\n'll''ll",
    "x=1;\r\n\r\n\tif(a){  }",
    "éàü日本語 テキスト 🙂🙂 ՘x \U00010940 \U0001df1f1͸",
    "a" * 300 + " " * 200 + "=" * 150,
    "\u0085 　  x\x00\x1c\x1f￾￿",
]


@pytest.fixture(scope="module")
def vocabulary():
    return tokencounts.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def size(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_counts_as_a_text_of_its_own(vocabulary, library):
    rnd = random.Random(3)
    letters = [*"abcdeths' \n\t.,lre<|>0123éß日 　", "<|endoftext|>", "'ll", "  ", " the", "՘"]
    texts = [t for t in TEXTS if t] + ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(200)]
    counter = tokencounts.Counter(vocabulary)
    for text in texts:
        want = [size(library, text[:k]) for k in range(1, len(text) + 1)]
        assert counter.counts(text).tolist() == want, text


def test_counts_do_not_depend_on_what_is_remembered(vocabulary, library, monkeypatch):
    for name in ("KNOWN_WORDS", "KNOWN_PAIRS", "KNOWN_STARTS"):
        monkeypatch.setattr(tokencounts, name, 3)
    counter = tokencounts.Counter(vocabulary)
    for text in filter(None, TEXTS):
        assert counter.counts(text)[-1] == size(library, text)


def test_characters_of_newer_unicode_versions_split_as_in_the_library(vocabulary, library):
    """All assigned and unassigned characters, in words."""
    counter = tokencounts.Counter(vocabulary)
    for start in range(0, 0x110000, 1 << 12):
        if not 0xD000 <= start < 0xE000:
            text = " ".join(f"a{chr(c)}1" for c in range(start, start + (1 << 12), 3))
            assert counter.counts(text)[-1] == size(library, text), hex(start)


def test_whole_tables(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        n = size(library, text or "")
        want = (doc_id, len((text or "").encode()), n, n > 1024)
        assert tuple(found[doc_id]) == want


def test_awkward_rows_and_questions_without_encoding(spark, vocabulary, library):
    more = {"n_tokens": F.lit("x"), "prefix_tokens": F.lit("x"), "day": F.to_date(F.lit("2026-01-01"))}
    rows = list(enumerate(TEXTS)) + [(None, "tail"), (3, TEXTS[3]), (99, "long word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(more)
    counted = tokencounts.count_tokens(docs, vocabulary)
    assert counted.columns == ["doc_id", "text", "day", "n_bytes", "n_tokens", "prefix_tokens"]
    prefix = F.col("prefix_tokens")
    asked = counted.select(
        "text",
        "n_tokens",
        F.size("prefix_tokens").alias("n_chars"),
        tokencounts.tokens_before(prefix, F.lit(5)).alias("five"),
        tokencounts.longest_within(prefix, F.lit(4)).alias("fits"),
    ).collect()
    assert len(asked) == len(rows)
    for row in asked:
        text = row["text"] or ""
        assert row["n_chars"] == len(text) and row["n_tokens"] == size(library, text)
        assert row["five"] == size(library, text[:5])
        if len(text) < 1000:
            assert row["fits"] == max(k for k in range(len(text) + 1) if size(library, text[:k]) <= 4)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokencounts.count_tokens(empty, vocabulary).count() == 0


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    content = json.load(open(PATH, encoding="utf-8"))
    content["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    with pytest.raises(ValueError):
        tokencounts.read_vocabulary(str(path))


def test_words_stay_known_from_task_to_task(vocabulary, monkeypatch):
    monkeypatch.setattr(tokencounts, "KNOWN_WORDS", 4)
    own = pickle.loads(pickle.dumps(vocabulary))
    counter = own.shared_counter()
    assert own.shared_counter() is counter and pickle.loads(pickle.dumps(own)).counter is None
    worked, work_out = [], counter.words.work_out
    counter.words.work_out = lambda word: worked.append(word) or work_out(word)
    for rare in ("one", "two", "three", "four", "five", "six", "seven"):
        counter.counts(f"often{rare}"), counter.counts("often")
    assert worked.count("often") == 1 and len(worked) == 8
