"""Repair the structure of conversations: cheapest edits by Four-Russians block tables.

A conversation is a string over nine symbols, one per row: what its role begins
with, and whether the row must go or is cut short. Its cheapest repair is a
shortest path through four states (nothing yet, after a system, a user, an
assistant row). The costs from a place to the end form a vector of four
numbers; less their minimum only a few dozen vectors exist. So what a block of
BLOCK symbols does to every vector is worked out once for every possible block,
and a conversation is processed from its end a block at a time by lookup. For
the edits themselves each block is expanded backward from the vector behind it
and walked forward, the least letter first among equal costs, so ties always
fall the same way.

Rows are sorted by ranges of (conversation, turn), which splits a conversation
of any length. Pieces that hold a whole conversation are repaired where they
stand. Others become fragments: duplicates are settled by an aggregate of row
digests, blocks compose to one matrix per fragment, and only these matrices are
chained per conversation before all fragments are traced at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, stored

BLOCK = 4
FRAGMENT_ROWS = 2048
FRAGMENT_CHARS = 4 << 20
PREFIX = 32  # code points by which rows of one turn and role are ordered; a hash orders the rest

DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
GROWN = (USER, USER, ASSISTANT, USER)  # state after a row of the role that may follow
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
END = (0, 2 * INSERT, INSERT, 0)  # costs of ending in each state
FAR = 1 << 40
INITIALS = {"s": 1, "u": 2, "a": 3}
GONE, OTHER, SYMBOLS = 0, 4, 9  # 1 to 4 are whole rows, 5 to 8 the same cut short
LEGAL = ("su", "ua", "au")
BLANK = " \t\n\v\f\r"


def row_step(symbol: int, after: Sequence[int]) -> tuple[int, ...]:
    """Costs to the end in front of a row, from those behind it."""

    def through(state: int) -> int:
        costs = [DELETE + after[state]]
        if symbol != GONE:
            extra = CUT_SHORT if symbol > OTHER else 0
            kept = KEPT.get((state, symbol - OTHER if symbol > OTHER else symbol))
            costs.append(REROLE + extra + after[GROWN[state]])
            if kept is not None:
                costs.append(extra + after[kept])
        return min(min(costs), FAR)

    row = [through(state) for state in range(4)]
    user, assistant = min(row[USER], INSERT + row[ASSISTANT]), min(row[ASSISTANT], INSERT + row[USER])
    return min(row[START], INSERT + user), min(row[SYSTEM], INSERT + user), user, assistant


def _normal(costs: Sequence[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(FAR if c >= FAR else c - least for c in costs), least


@dataclass(frozen=True)
class Tables:
    """All normal vectors, and what each symbol and each block of symbols does to them."""

    vectors: tuple[tuple[int, ...], ...]
    places: dict[tuple[int, ...], int]
    steps: tuple[tuple[tuple[int, int], ...], ...]  # [vector][symbol]: vector in front, what it adds
    block_vector: list[list[int]]  # [vector][block]
    block_cost: list[list[int]]


def build_tables() -> Tables:
    units = [tuple(0 if i == q else FAR for i in range(4)) for q in range(4)]
    vectors = list(dict.fromkeys([_normal(END)[0], *units]))
    places = {v: i for i, v in enumerate(vectors)}
    steps: list[tuple[tuple[int, int], ...]] = []
    while len(steps) < len(vectors):
        own = []
        for symbol in range(SYMBOLS):
            vector, cost = _normal(row_step(symbol, vectors[len(steps)]))
            if vector not in places:
                places[vector] = len(vectors)
                vectors.append(vector)
            own.append((places[vector], cost))
        steps.append(tuple(own))
    to, cost = (np.array([[step[i] for step in own] for own in steps]) for i in range(2))
    block_vector = np.arange(len(vectors))[:, None]  # blocks of no symbol
    block_cost = np.zeros_like(block_vector)
    for _ in range(BLOCK):
        # One symbol more in front; the first symbol is the leading digit of a block's number.
        more = [(to[block_vector, s], block_cost + cost[block_vector, s]) for s in range(SYMBOLS)]
        block_vector = np.concatenate([m[0] for m in more], axis=1)
        block_cost = np.concatenate([m[1] for m in more], axis=1)
    return Tables(tuple(vectors), places, tuple(steps), block_vector.tolist(), block_cost.tolist())


class Solver:
    """Costs and edits of symbol strings; symbols are digits 0 to 8."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.expanded: dict[tuple[str, int, int], tuple[str, int]] = {}

    def borders(self, symbols: str, vector: int) -> tuple[list[int], int]:
        """Vectors in front of each block and behind the last, and the cost added from ``vector`` on."""
        tables, whole = self.tables, len(symbols) // BLOCK * BLOCK
        found, cost = [vector], 0
        for symbol in reversed(symbols[whole:]):
            vector, more = tables.steps[vector][int(symbol)]
            cost += more
        if whole < len(symbols):
            found.append(vector)
        for at in range(whole - BLOCK, -1, -BLOCK):
            block = int(symbols[at : at + BLOCK], SYMBOLS)
            cost += tables.block_cost[vector][block]
            vector = tables.block_vector[vector][block]
            found.append(vector)
        return found[::-1], cost

    def expand(self, block: str, behind: int, state: int) -> tuple[str, int]:
        """Edits of a block, least letter first among the cheapest, and the state behind it."""
        key = (block, behind, state)
        known = self.expanded.get(key)
        if known is not None:
            return known
        vectors, chain = self.tables.vectors, [(behind, 0)]
        for symbol in reversed(block):
            chain.append(self.tables.steps[chain[-1][0]][int(symbol)])
        chain.reverse()
        letters = []
        for i, symbol in enumerate(map(int, block)):
            here, after = [c + chain[i][1] for c in vectors[chain[i][0]]], vectors[chain[i + 1][0]]
            extra = CUT_SHORT if symbol > OTHER else 0
            while True:
                kept = KEPT.get((state, symbol - OTHER if symbol > OTHER else symbol))
                if here[state] == DELETE + after[state]:
                    letters.append("D")
                elif here[state] == INSERT + here[GROWN[state]]:
                    letters.append("I")
                    state = GROWN[state]
                    continue
                elif kept is not None and here[state] == extra + after[kept]:
                    letters.append("K")
                    state = kept
                else:
                    letters.append("R")
                    state = GROWN[state]
                break
        found = self.expanded[key] = "".join(letters), state
        return found

    def trace(self, symbols: str, borders: Sequence[int], state: int) -> tuple[str, int]:
        """Edits of all rows from an entry state, and the state behind the last row."""
        letters = []
        for k, at in enumerate(range(0, len(symbols), BLOCK)):
            own, state = self.expand(symbols[at : at + BLOCK], borders[k + 1], state)
            letters.append(own)
        return "".join(letters), state

    def solve(self, symbols: str) -> tuple[int, str]:
        """Cheapest cost and least edit string of a whole conversation."""
        borders, cost = self.borders(symbols, self.tables.places[END])
        edits, state = self.trace(symbols, borders, START)
        return cost + self.tables.vectors[borders[0]][START], edits + ending(state)

    def matrix(self, symbols: str) -> list[int]:
        """Cost from each state in front (rows) to each state behind, 16 numbers."""
        columns = []
        for q in range(4):
            borders, cost = self.borders(symbols, self.tables.places[tuple(0 if i == q else FAR for i in range(4))])
            columns.append([min(FAR, c + cost) for c in self.tables.vectors[borders[0]]])
        return [columns[q][p] for p in range(4) for q in range(4)]


def ending(state: int) -> str:
    """Edits behind the last row."""
    return "I" * (END[state] // INSERT)


def apply_edits(edits: str, rows: Iterable[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """Rows (role, text) that the edits leave, from an entry state."""
    rows, out = iter(rows), []
    for edit in edits:
        if edit == "I":
            state = GROWN[state]
            out.append((ROLES[state], ""))
            continue
        role, text = next(rows)
        if edit == "R":
            state = GROWN[state]
            out.append((ROLES[state], text))
        elif edit == "K":
            state = KEPT[(state, INITIALS[role[0]])]
            out.append((role, text))
    return out


def fault_of(text: str) -> int:
    """0 whole, 1 blank, 2 cut short."""
    end = text.rstrip(BLANK)[-1:]
    return 1 if not end else 0 if end in ".!?" else 2


@dataclass
class _Piece:
    """Rows of one conversation that follow each other, as one task sees them."""

    conv: object
    first: bool  # no row of the conversation stands in front of it, as far as the task knows
    roles: list
    texts: list
    turns: list
    chars: int = 0

    def record(self, part: int, whole: bool, solver: Solver) -> dict:
        seen, symbols, counts, digests = set(), [], [0, 0, 0], []
        for row in zip(self.roles, self.texts, strict=True):
            fault = fault_of(row[1])
            kind = INITIALS.get(row[0][:1], OTHER)
            if fault == 1:
                symbol, slot = GONE, 0
            elif row in seen:
                symbol, slot = GONE, 1
            else:
                symbol, slot = (kind + OTHER, 2) if fault == 2 else (kind, None)
            seen.add(row)
            symbols.append(str(symbol))
            if slot is not None:
                counts[slot] += 1
            if not whole:
                digests.append(hashlib.md5(f"{len(row[0])}:{row[0]}{row[1]}".encode("utf-8", "surrogatepass")).digest())
        known = [t for t in self.turns if t is not None]
        initials = [role[:1] for role in self.roles]
        made = {
            "conv_id": self.conv,
            "part": part,
            "whole": whole,
            "n_rows": len(self.roles),
            "blank": counts[0],
            "duplicate": counts[1],
            "truncated": counts[2],
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first_turn": known[0] if known else None,
            "last_turn": known[-1] if known else None,
            "n_turns": len(set(known)),
            "first_initial": initials[0],
            "last_initial": initials[-1],
            "symbols": "".join(symbols),
        }
        if whole:
            cost, audit = solver.solve(made["symbols"])
            repaired = apply_edits(audit, zip(self.roles, self.texts, strict=True), START)
            return made | {"cost": cost, "audit": audit, "repaired": repaired, "rows": [], "digests": []}
        rows = list(zip(self.roles, self.texts, strict=True))
        return made | {"cost": None, "audit": None, "repaired": None, "rows": rows, "digests": digests}


_ROW = pa.struct([("role", pa.string()), ("text", pa.string())])
_FIELDS = [
    ("part", pa.int64()),
    ("whole", pa.bool_()),
    ("n_rows", pa.int64()),
    ("blank", pa.int64()),
    ("duplicate", pa.int64()),
    ("truncated", pa.int64()),
    ("illegal", pa.int64()),
    ("first_turn", pa.int64()),
    ("last_turn", pa.int64()),
    ("n_turns", pa.int64()),
    ("first_initial", pa.string()),
    ("last_initial", pa.string()),
    ("symbols", pa.string()),
    ("cost", pa.int64()),
    ("audit", pa.string()),
    ("repaired", pa.list_(_ROW)),
    ("rows", pa.list_(_ROW)),
    ("digests", pa.list_(pa.binary())),
]
_SQL_FIELDS = (
    "part bigint, whole boolean, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_turn bigint, last_turn bigint, n_turns bigint, first_initial string, last_initial string, symbols string, "
    "cost bigint, audit string, repaired array<struct<role:string,text:string>>, "
    "rows array<struct<role:string,text:string>>, digests array<binary>"
)


def _pairs(rows: list) -> list[dict] | None:
    return None if rows is None else [{"role": role, "text": text} for role, text in rows]


def _pieces(turns: DataFrame, tables) -> DataFrame:
    """One row per piece of a conversation: repaired if whole, else with its rows."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).withColumns(
        {
            "_prefix": F.substring("text", 1, PREFIX),
            "_hash": F.xxhash64("text"),
            "_same": F.monotonically_increasing_id(),  # spreads equal rows, which may stand in any order
        }
    )
    order = [
        F.asc_nulls_first("conv_id"),
        F.asc_nulls_first("turn"),
        *[F.asc(c) for c in ("role", "_prefix", "_hash", "_same")],
    ]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")

    def run(batches):
        solver = Solver(tables.value)
        base = TaskContext.get().partitionId() << 32
        number, piece, made, size = 0, None, [], 0

        def close(last: bool):
            nonlocal number, size
            made.append(piece.record(base + number, piece.first and last, solver))
            number += 1
            size += piece.chars

        def batch_of(conv_type):
            nonlocal size
            columns = [pa.array([r["conv_id"] for r in made], conv_type)]
            for name, field_type in _FIELDS:
                pairs = name in ("repaired", "rows")
                columns.append(pa.array([_pairs(r[name]) if pairs else r[name] for r in made], field_type))
            made.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *[n for n, _ in _FIELDS]])

        conv_type, begun = None, False
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        close(last=True)
                    piece = _Piece(conv, begun, [], [], [])
                    begun = True
                elif len(piece.roles) >= FRAGMENT_ROWS or piece.chars >= FRAGMENT_CHARS:
                    close(last=False)
                    piece = _Piece(conv, False, [], [], [])
                piece.roles.append(role)
                piece.texts.append(text)
                piece.turns.append(turn)
                piece.chars += len(text)
                if len(made) >= 1000 or size >= FRAGMENT_CHARS:
                    yield batch_of(conv_type)
        if piece is not None:
            close(last=False)
        if made:
            yield batch_of(conv_type)

    return ordered.mapInArrow(run, f"conv_id {kind}, {_SQL_FIELDS}")


def _settled(open_: DataFrame) -> DataFrame:
    """Open pieces with their symbols, counts and digests corrected for rows seen in earlier pieces."""
    keys = open_.select("_conv", "part", F.explode(F.array_distinct("digests")).alias("digest"))
    first = keys.groupBy("_conv", "digest").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    again = keys.join(first.filter("low < high").select("_conv", "digest", "low"), ["_conv", "digest"]).filter("part > low")
    again = again.groupBy("_conv", "part").agg(F.collect_list("digest").alias("again"))  # at most a piece's rows
    narrow = open_.select("_conv", "part", "symbols", "duplicate", "truncated", "digests").join(
        again, ["_conv", "part"], "left"
    )

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for symbols, duplicate, truncated, digests, again in zip(*columns[2:], strict=True):
                repeated = set(again or ())
                fixed = list(symbols)
                for i, digest in enumerate(digests):
                    if fixed[i] != "0" and digest in repeated:
                        truncated -= int(fixed[i]) > OTHER
                        duplicate += 1
                        fixed[i] = "0"
                out.append(("".join(fixed), duplicate, truncated))
            more = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *more], ["_conv", "part", "symbols", "duplicate", "truncated"]
            )

    return narrow.mapInArrow(run, "_conv string, part bigint, symbols string, duplicate bigint, truncated bigint")


def _chained(rows: DataFrame, descending: bool, run, schema: str) -> DataFrame:
    """Narrow rows, one per piece, of each conversation in order, streamed through ``run``."""
    order = F.desc("part") if descending else F.asc("part")
    return rows.repartition("_conv").sortWithinPartitions("_conv", order).mapInArrow(run, schema)


def _traced(settled: DataFrame, tables) -> DataFrame:
    """(_conv, part, cost, state, audit, exit) of each open piece: its cost to the end, entry state, edits and exit state."""

    def matrices(batches):
        solver = Solver(tables.value)
        for batch in batches:
            found = [solver.matrix(s) for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["_conv", "part"]).columns, pa.array(found, pa.list_(pa.int64()))], ["_conv", "part", "matrix"]
            )

    def backward(batches):
        """The vector behind each piece, from those of the pieces after it."""
        conv, costs = None, END
        for batch in batches:
            behind, front = [], []
            for own, _, matrix in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != conv:
                    conv, costs = own, END
                behind.append(costs)
                costs = tuple(min(matrix[4 * p + q] + costs[q] for q in range(4)) for p in range(4))
                front.append(costs[START])
            numbers = [pa.array(behind, pa.list_(pa.int64())), pa.array(front, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers], ["_conv", "part", "behind", "cost"])

    def choices(batches):
        """Edits and exit state of each piece for each state it may be entered in."""
        solver = Solver(tables.value)
        for batch in batches:
            edits, exits = [], []
            for symbols, behind in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True):
                borders, _ = solver.borders(symbols, solver.tables.places[_normal(behind)[0]])
                found = [solver.trace(symbols, borders, state) for state in range(4)]
                edits.append([letters for letters, _ in found])
                exits.append([state for _, state in found])
            more = [pa.array(edits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["_conv", "part", "cost"]).columns, *more], ["_conv", "part", "cost", "edits", "exits"]
            )

    def forward(batches):
        """The state each piece is entered in."""
        conv, state = None, START
        for batch in batches:
            states = []
            for own, _, exits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != conv:
                    conv, state = own, START
                states.append(state)
                state = exits[state]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(states, pa.int32())], ["_conv", "part", "state"])

    key = ["_conv", "part"]
    narrow = settled.select(*key, "symbols").mapInArrow(matrices, "_conv string, part bigint, matrix array<bigint>")
    behind = _chained(narrow, True, backward, "_conv string, part bigint, behind array<bigint>, cost bigint")
    each = settled.select(*key, "symbols").join(behind, key)
    schema = "_conv string, part bigint, cost bigint, edits array<string>, exits array<int>"
    chosen = stored(each.mapInArrow(choices, schema), "edits")
    states = _chained(chosen.select(*key, "exits"), False, forward, "_conv string, part bigint, state int")
    own = [F.get(c, F.col("state")).alias(name) for c, name in (("edits", "audit"), ("exits", "exit"))]
    return chosen.join(states, key).select(*key, "cost", "state", *own)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations of rows (conv_id, turn, role, text), in parts.

    A part is a run of rows of one conversation, in order of ``part``; nearly
    all conversations are one part (``whole``), long ones several of at most
    FRAGMENT_ROWS rows. Columns: conv_id, part, whole, n_rows, blank, duplicate,
    truncated (rows by first fault), illegal (neighbours inside the part),
    first_turn, last_turn, n_turns, first_initial, last_initial, cost (of the
    edits from this part to the end), audit (one letter per edit: Keep, Rerole,
    Delete, Insert), repaired (roles and texts). ``summarise`` puts parts
    together. The edits are the cheapest for the whole conversation, the least
    in ASCII order among these.

    Rows go by turn, null turns first; rows of one turn by role, the first
    PREFIX code points of the text, and a hash of it. A null role or text counts
    as one space. Null conv_ids are one conversation. Equal rows are duplicates
    of the first. Texts of any length are kept whole, other columns are not
    read. An empty table gives an empty result. Roles count by their first
    character, as it is written.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    tables = spark.sparkContext.broadcast(build_tables())  # fixed size
    pieces = stored(_pieces(turns, tables), "pieces")
    columns = [c for c in pieces.columns if c not in ("symbols", "rows", "digests")]
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    open_ = pieces.filter("NOT whole").withColumn("_conv", conv)
    settled = stored(_settled(open_), "settled")
    edited = _traced(settled, tables).join(settled.drop("symbols"), ["_conv", "part"])
    left = open_.drop("duplicate", "truncated", "cost", "audit", "repaired").join(edited, ["_conv", "part"])
    last = open_.groupBy("_conv").agg(F.max("part").alias("_last"))
    left = left.join(last, "_conv").withColumn("_ends", F.col("part") == F.col("_last"))

    def run(batches):
        for batch in batches:
            audits, repaired = [], []
            own = [batch.column(c).to_pylist() for c in ("rows", "audit", "state", "exit", "_ends")]
            for rows, audit, state, behind, ends in zip(*own, strict=True):
                edits = audit + ending(behind) if ends else audit
                audits.append(edits)
                repaired.append(_pairs(apply_edits(edits, [(r["role"], r["text"]) for r in rows], state)))
            made = {"audit": pa.array(audits, pa.string()), "repaired": pa.array(repaired, pa.list_(_ROW))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return pieces.filter("whole").select(*columns).union(left.mapInArrow(run, pieces.select(*columns).schema))


def repaired_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


SUMMARY = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def summarise(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: gaps, counts of faults, cost, audit and repaired_sha256.

    ``gaps`` are the turn numbers missing between the least and the greatest,
    nulls apart (0 without any); repaired_sha256 is that of the repaired rows as
    ``role:text``, joined by newlines. Parts of a long conversation are put
    together in their order, one at a time.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    missing = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("bigint"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = parts.filter("whole").select(
        "conv_id", missing.alias("gaps"), *counts, F.sha2(repaired_text(F.col("repaired")), 256).alias("repaired_sha256")
    )
    text = F.when(F.size("repaired") > 0, repaired_text(F.col("repaired"))).alias("text")
    edges = ["first_turn", "last_turn", "n_turns", "first_initial", "last_initial"]
    rest = parts.filter("NOT whole").withColumn("_conv", F.col("conv_id").cast("string"))
    ordered = rest.repartition("_conv").sortWithinPartitions("_conv", "part").select("conv_id", *counts, *edges, text)
    names = ["conv_id", "gaps", *counts, "repaired_sha256"]

    def run(batches):
        open_, conv_type = None, None
        for batch in batches:
            done, conv_type = [], batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if open_ is None or row["conv_id"] != open_.conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Whole(row["conv_id"])
                open_.add(row)
            yield _summary_batch(done, conv_type, names)
        if open_ is not None:
            yield _summary_batch([open_.row()], conv_type, names)

    return whole.union(ordered.mapInArrow(run, f"conv_id {kind}, {SUMMARY}"))


def _summary_batch(rows: list[tuple], conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


class _Whole:
    """A conversation put together part by part."""

    def __init__(self, conv):
        self.conv, self.cost, self.low, self.high, self.turns = conv, None, None, None, 0
        self.counts, self.last, self.audit = [0, 0, 0, 0], None, []
        self.digest, self.written = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[name]
        if self.last is None:
            self.cost = row["cost"]
        else:
            self.counts[3] += self.last + row["first_initial"] not in LEGAL
        self.last = row["last_initial"]
        if row["first_turn"] is not None:
            self.turns += row["n_turns"] - (row["first_turn"] == self.high)
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]
        self.audit.append(row["audit"])
        if row["text"] is not None:
            self.digest.update((("\n" if self.written else "") + row["text"]).encode("utf-8", "surrogatepass"))
            self.written = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.counts, self.cost, "".join(self.audit), self.digest.hexdigest()


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, chosen by a checksum of conversation and turn.

    0 of 20 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats
    it, 4 makes it the user's. Nulls count as one space.
    """
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    fault = F.crc32(name) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (
        turns.filter(fault != 0)
        .withColumn("_copies", F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(role).alias("role"),
            F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode("_copies"),
        )
        .drop("col")
    )
