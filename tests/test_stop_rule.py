"""A run ends after so many failures in a row; what was not asked stays pending."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnlake.plans import extraction


def prompts(spark, size):
    return spark.range(size).select(F.format_string("k%05d", "id").alias("key"), F.format_string("p%05d", "id").alias("prompt"))


def answers(spark, monkeypatch, size, model, wave=10):
    monkeypatch.setattr(extraction, "WAVE", wave)
    monkeypatch.setattr(extraction, "WAVE_TASKS", 2)
    return {r["key"]: (r["content"], r["error"]) for r in extraction.ask(prompts(spark, size), "key", model, 5).collect()}


def test_a_dead_service_is_asked_for_one_wave(spark, monkeypatch, tmp_path):
    def down(prompt):
        (tmp_path / prompt).touch()
        raise RuntimeError("down")

    found = answers(spark, monkeypatch, 60, down)
    assert len(found) == 60 and all(content is None for content, _ in found.values())
    asked = {k for k, (_, error) in found.items() if error != extraction.NOT_ASKED}
    assert 5 <= len(asked) <= 25
    assert {p.name for p in tmp_path.iterdir()} == {k.replace("k", "p") for k in asked}
    assert max(asked) < min(set(found) - asked)


def test_a_streak_goes_on_across_waves_and_is_broken_by_success(spark, monkeypatch):
    def flaky(prompt):
        number = int(prompt[1:])
        if number % 10 in (8, 9, 0, 1):  # four in a row, over the border of two waves
            raise RuntimeError
        return "ok"

    found = answers(spark, monkeypatch, 60, flaky)
    assert all(error != extraction.NOT_ASKED for _, error in found.values())
    assert sum(content == "ok" for content, _ in found.values()) == 36


@pytest.mark.parametrize("size", [0, 1, 4])
def test_few_prompts(spark, monkeypatch, size):
    def down(prompt):
        raise RuntimeError("down")

    found = answers(spark, monkeypatch, size, down)
    assert len(found) == size and all(error == "down" for _, error in found.values())
