"""The table of words that the last stage of the pipeline sends through the driver."""

import corpus_pipeline
from turnlake.llm import bpe


def test_the_driver_gets_a_small_table(spark, monkeypatch):
    sizes, made = [], bpe.word_table

    def watched(*args):
        table = made(*args)
        sizes.append(len(table))
        return table

    monkeypatch.setattr(bpe, "word_table", watched)
    docs = spark.createDataFrame([(i, f"own{i} words{i} here", "web") for i in range(40)], "doc_id long, text string, source string")
    assert corpus_pipeline.TABLE_WORDS < bpe.TABLE_WORDS
    whole = corpus_pipeline.byte_bpe(spark, docs, "").collect()
    monkeypatch.setattr(corpus_pipeline, "TABLE_WORDS", 5)
    assert sorted(map(str, corpus_pipeline.byte_bpe(spark, docs, "").collect())) == sorted(map(str, whole))
    assert sizes[0] > 5 >= sizes[1]
