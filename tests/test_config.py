"""Settings and small driver-side files."""

from __future__ import annotations

import os

import pytest

from turnlake import config as cf
from turnlake.sources import sinks


def test_defaults_without_a_file(tmp_path):
    loaded = cf.load_config(str(tmp_path))
    assert loaded.wallet_dir == str(tmp_path)
    assert (loaded.injection.max_tokens, loaded.injection.max_turns) == (1800, 8)


def test_merge_and_wrong_types(tmp_path, monkeypatch):
    monkeypatch.setenv("TURNLAKE_A", "secret")
    (tmp_path / "config.yaml").write_text(
        "indexBuckets: 99\nproxy: {port: 5000}\ninjection: {maxTokens: 100, recencyBoost: x}\nincognito: true\n"
        "unknown: 1\n"
        "tools:\n - {name: a, provider: openai, apiKey: 'env:TURNLAKE_B'}\n - {name: b, provider: other}\n - 5\n"
    )
    loaded = cf.load_config(str(tmp_path))
    assert loaded.index_buckets == 99
    assert (loaded.injection.max_tokens, loaded.injection.recency_boost) == (100, 0.3)
    assert loaded.incognito is True
    assert [(t.name, t.api_key) for t in loaded.tools] == [("a", "env:TURNLAKE_B")]


def test_malformed_and_odd_documents(tmp_path):
    (tmp_path / "config.yaml").write_text("a: [1, 2")
    with pytest.raises(ValueError):
        cf.load_config(str(tmp_path))
    assert cf.from_mapping(["x"]) == cf.Config()


def test_key_resolution(monkeypatch):
    monkeypatch.delenv("TURNLAKE_NO", raising=False)
    assert cf.resolve_key("plain") == "plain"
    assert cf.resolve_key("env:TURNLAKE_NO") == "env:TURNLAKE_NO"
    assert cf.resolve_key("env:TURNLAKE_NO", unset="empty") == ""
    with pytest.raises(KeyError):
        cf.resolve_key("env:TURNLAKE_NO", unset="raise")


def test_home_paths():
    home = os.path.expanduser("~")
    assert cf.expand_home("~/x") == f"{home}/x"
    assert cf.tilde_path(f"{home}/x") == "~/x"
    assert cf.expand_home("/a/~/b") == "/a/~/b"


def test_incognito_keeps_other_keys(tmp_path):
    (tmp_path / "config.yaml").write_text("walletDir: /w\nextra: 1\n")
    cf.set_incognito(str(tmp_path), True)
    assert "extra: 1" in (tmp_path / "config.yaml").read_text()
    assert cf.load_config(str(tmp_path)).incognito is True


def test_small_texts_are_tables(spark, tmp_path):
    base = f"{tmp_path}/profile"
    assert sinks.read_text(spark, base) == ""
    sinks.write_text(spark, base, "one")
    sinks.write_text(spark, base, "two\nlines")
    assert sinks.read_text(spark, base) == "two\nlines"


def test_snapshots(spark, tmp_path):
    base, schema = f"{tmp_path}/t", "id string"
    assert sinks.read_snapshot(spark, base, schema).count() == 0
    assert sinks.write_snapshot(spark.createDataFrame([("a",)], schema), base) == 1
    current = sinks.read_snapshot(spark, base, schema)
    assert sinks.write_snapshot(current.unionByName(spark.createDataFrame([("b",)], schema)), base) == 2
    assert sinks.read_snapshot(spark, base, schema).count() == 2
