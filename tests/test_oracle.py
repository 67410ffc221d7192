"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import compare
import pytest

from turnlake.verify.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLES:
        assert compare.difference(QUERIES[name], ORACLES[name], spark, duck, SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() >= 0


@pytest.mark.parametrize(
    "name",
    [
        "turn_pairs", "orphan_messages", "captures", "capture_sessions", "session_representatives", "context_boost",
        "substantive_sessions", "search_turns", "conversation_heads", "stream_ingest_turns",
        "render_conversation", "clean_session", "normalize_requests", "request_heads",
    ],
)
def test_query_with_tiny_slices(spark, duck, name, monkeypatch):
    """The same results when every conversation and wallet is cut into slices."""
    from turnlake.operators import sessions, slices

    monkeypatch.setattr(slices, "SLICE_BITS", 1)
    monkeypatch.setattr(sessions, "MAX_PLAIN_GROUP", 3)
    assert compare.difference(QUERIES[name], ORACLES[name], spark, duck, SF_DIR) is None


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
