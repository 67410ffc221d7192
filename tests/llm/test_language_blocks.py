"""Many labels: blocks of labels give what one matrix gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from turnlake.llm import language


def rows(labels, each):
    rnd, found = random.Random(2), []
    for i in range(labels):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñ", 9)
        for _ in range(each):
            found.append((f"l{i:03d}", " ".join("".join(rnd.choices(letters, k=5)) for _ in range(25))))
    return found


@pytest.mark.parametrize("size", [1, 3, 7])
def test_blocks_equal_one_matrix(spark, monkeypatch, size):
    labelled = spark.createDataFrame(rows(7, 6), "lang string, text string")
    asked = labelled.union(spark.createDataFrame([(None, None), ("x", ""), ("x", "123"), (None, "aé")], "lang string, text string"))
    whole = {r["text"]: (r["lang_pred"], r["score"]) for r in language.detect(asked, language.train(labelled)).collect()}
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", size)
    model = language.train(labelled)
    assert isinstance(model, language.Blocks) == (size < 7)
    found = language.detect(asked.withColumn("score", F.lit("x")), model)
    assert found.columns == ["lang", "text", "lang_pred", "score"]
    for row in found.collect():
        lang, score = whole[row["text"]]
        assert row["lang_pred"] == lang and row["score"] == pytest.approx(score, rel=1e-9)


def test_more_labels_than_a_block(spark):
    """A dirty label column is scored, not refused."""
    labelled = spark.createDataFrame(rows(150, 2), "lang string, text string")
    found = language.detect(labelled, language.train(labelled)).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in found)
    assert len(found) == 300 and right > 200
