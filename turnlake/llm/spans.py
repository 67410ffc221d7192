"""Spans of pattern matches as Spark expressions.

Spark's functions give matches but not where they stand. The pieces between
matches do: both come from the same left-to-right search, so the start of a
match is the length of everything before it. All offsets are code points, ends
exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, use) -> Column:
    """``use`` applied to ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Running sums of an int array: sums inside blocks of sqrt(n), then offsets of the blocks."""

    def sums(values: Column) -> Column:
        empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

        def add(state: Column, x: Column) -> Column:
            total = state["sum"] + x
            return F.struct(total.alias("sum"), F.concat(state["out"], F.array(total)).alias("out"))

        return F.aggregate(values, empty, add, lambda s: s["out"])

    def blocks(width: Column) -> Column:
        count = F.ceil(F.size(numbers) / width).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: sums(F.slice(numbers, i * width + 1, width))
        )

    def joined(parts: Column) -> Column:
        empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out"))

        def add(state: Column, part: Column) -> Column:
            moved = F.transform(part, lambda x: x + state["sum"])
            return F.struct(
                (state["sum"] + F.element_at(part, -1)).alias("sum"),
                F.concat(state["out"], F.array(moved)).alias("out"),
            )

        return F.aggregate(parts, empty, add, lambda s: F.flatten(s["out"]))

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers)))).cast("int")
    filled = bound(width, lambda w: bound(blocks(w), joined))
    return F.when(F.size(numbers) > 0, filled).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<start int, end int, value string>> of the leftmost non-overlapping matches.

    ``gate`` is a cheap necessary condition; texts that fail it are not searched.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(found: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
            return bound(
                running_sums(lengths),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value")
                    ),
                ),
            )

        searched = bound(F.split(text, pattern, -1), with_pieces)
        return F.when(F.size(found) > 0, searched).otherwise(none)

    searched = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return searched if gate is None else F.when(gate, searched).otherwise(none)


def of_kind(found: Column, kind: int) -> Column:
    """Matches as spans (start, kind, end), which sort by start, then kind."""
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )


def written(spans: Column, names: Sequence[str]) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    table = F.array(*[F.lit(n) for n in names])
    text = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(table, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def replaced(text: Column, spans: Column, names: Sequence[str]) -> Column:
    """``text`` with each sorted span replaced by its kind in brackets; a span that starts inside another goes with it."""
    table = F.array(*[F.lit(f"[{n.upper()}]") for n in names])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct(
            s["end"].alias("at"), F.concat(state["out"], F.array(piece, F.get(table, s["kind"]))).alias("out")
        )
        inside = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(inside)

    whole = F.aggregate(
        spans,
        start,
        cut,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text) - s["at"])),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def blanked(text: Column, found: Column, filler: str = " ") -> Column:
    """``text`` with each sorted span turned into as many fillers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        blanks = F.repeat(F.lit(filler), s["end"] - F.greatest(state["at"], s["start"]))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.array(kept, blanks)).alias("out")
        )

    return F.aggregate(
        found,
        start,
        cut,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text) - s["at"])),
    )
