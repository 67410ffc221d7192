"""Conversation repair against a plain shortest path over all edits."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from turnlake.llm import repair
from turnlake.llm.queries import QUERIES

BLANKS = " \t\n\v\f\r"
NEXT = (2, 2, 3, 2)
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, edits) of rows (initial, fault): every edit tried at every place."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def take(letter, price, *to):
            cost, edits = best(*to)
            found.append((cost + price, letter + edits))

        if inserted < 4:
            take("I", 3, i, NEXT[state], inserted + 1)
        if i < len(rows):
            initial, fault = rows[i]
            take("D", 4, i + 1, state, 0)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                take("R", 3 + extra, i + 1, NEXT[state], 0)
                if (state, initial) in KEEPS:
                    take("K", extra, i + 1, KEEPS[state, initial], 0)
        return min(found) if found else (10**9, "")

    for i in range(len(rows), -1, -1):  # from the end, so that calls do not nest deeply
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def summary(rows):
    """Contract columns of one conversation; rows (turn, role, text) after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(BLANKS)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    cost, edits = cheapest(tuple(zip(initials, faults)))
    state, out, left = 0, [], iter(rows)
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append({2: "user", 3: "assistant"}[state] + ":")
            continue
        _, role, text = next(left)
        if edit != "D":
            state = KEEPS[state, role[0]] if edit == "K" else NEXT[state]
            out.append(f"{role if edit == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[faults.count(name) for name in ("blank", "duplicate", "truncated")],
        illegal,
        cost,
        edits,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def expected(rows):
    """Summaries by conv_id; rows (conv, turn, role, text), one turn's rows ordered as the docstring says."""
    every = {}
    for conv, turn, role, text in rows:
        every.setdefault(conv, []).append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: summary(sorted(own, key=order)) for conv, own in every.items()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(frame):
    return {row["conv_id"]: tuple(row[n] for n in NAMES) for row in frame.collect()}


def made(seed, conversations, longest):
    rnd, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", "util"])
            text = rnd.choice(["Yes.", "No!", "cut", "", " \n", "Why? ", "é 日本.", f"text {rnd.random()}.", f"{rnd.random()}"])
            rows.append((conv, turn * rnd.choice([1, 1, 1, 2]) if rnd.random() > 0.03 else None, role, text))
    return rows


def unique_turns(rows):
    """One row per conversation and turn, so that the order of rows leaves no question."""
    return list({(r[0], r[1]): r for r in rows}.values())


def test_tables_agree_with_single_steps():
    solver = repair.Solver(repair.build_tables())
    rnd = random.Random(5)
    fault = {0: "blank", **dict.fromkeys(range(1, 5), ""), **dict.fromkeys(range(5, 9), "truncated")}
    for _ in range(800):
        symbols = "".join(rnd.choice("012345678") for _ in range(rnd.randint(0, 13)))
        rows = tuple(("xsuax"[(int(s) - 1) % 4 + 1] if s != "0" else "x", fault[int(s)]) for s in symbols)
        assert solver.solve(symbols) == cheapest(rows)


@pytest.mark.parametrize("size", [3, 2048])
def test_repair_is_cheapest_whatever_the_pieces(spark, monkeypatch, size):
    """Short pieces make long conversations cross many borders."""
    monkeypatch.setattr(repair, "FRAGMENT_ROWS", size)
    rows = unique_turns(made(7, 40, 30)) + [(None, t, "user", "Hm.") for t in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repair.summarise(repair.repair(frame))) == expected(rows)


def test_hot_conversation_is_split(spark, monkeypatch):
    monkeypatch.setattr(repair, "FRAGMENT_ROWS", 50)
    rows = [(1, t, "assistant" if t % 2 else "user", f"Turn {t % 700}.") for t in range(900)]
    rows += [(2 + t % 3, t, "user", "Short.") for t in range(30)]
    parts = repair.repair(spark.createDataFrame(rows, SCHEMA)).cache()
    assert parts.agg(F.max("n_rows")).first()[0] <= 50
    found = result(repair.summarise(parts))
    audit = found[1][6]
    assert len(audit) == 900 and audit[:700] == "K" * 700 and set(audit[700:]) == {"D"}
    assert found == expected(rows)


def test_equal_rows_ties_nulls_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Hi."), (1, None, None, None)]
    rows += [(1, None, "system", "Be kind."), (2, None, "user", "x"), (2, None, "user", "x"), (3, 9, "User", "Upper.")]
    rows += [(None, None, None, None), (4, 5, "user", "a" * 200000 + "."), (4, 6, "assistant", "ok." * 70000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("part", "cost", "audit", "symbols")})
    clean = [(c, t, *[" " if x is None else x for x in more]) for c, t, *more in rows]
    assert result(repair.summarise(repair.repair(frame))) == expected(clean)


def test_empty_table(spark):
    assert result(repair.summarise(repair.repair(spark.createDataFrame([], SCHEMA)))) == {}


@pytest.mark.parametrize("size", [4, 2048])
def test_query_on_damaged_rows(spark, tmp_path, monkeypatch, size):
    """Every original conversation comes back, those without a row left too."""
    monkeypatch.setattr(repair, "FRAGMENT_ROWS", size)
    rows = unique_turns(made(11, 150, 12)) + [(c, 0, "user", "Alone.") for c in range(1000, 1060)]
    rows += [(None, 1, "user", "One."), (None, 2, None, "Two."), (None, None, "assistant", None)]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    want |= expected(damaged(rows))
    assert result(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == want
    assert any(v[6] == "" for v in want.values())


def test_query_on_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {**expected(damaged(rows))}.items() <= result(QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001")).items()
