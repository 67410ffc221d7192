"""Ordered operations inside groups that may be arbitrarily large.

A window partitioned by the group alone sorts a whole group in one task, and
one group may hold a third of the table. ``cut`` first checks, from the column
statistics of the scan, whether any group can be longer than one slice. If none
can, a plain window is safe and is used. Otherwise every group is cut into
slices of bounded size along its order: windows run inside a slice, and what
has to cross a slice border (the neighbouring row, the running count) is
computed on one summary row per slice and joined back on (group, slice), the
partitioning the window already has.

The functions below take either form; rows with a ``_slice`` column are sliced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.session import cut_lineage

SLICE_BITS = 12  # 4096 positions per slice
SLICE = "_slice"
TASK_BYTES = 16 << 20  # of text in one task: the counts of its words take some twenty times as much memory
SMALL_BYTES = 1 << 20


def text_bytes(rows: DataFrame, text: Column) -> int:
    """Bytes of a text column; one pass over it."""
    return rows.agg(F.sum(F.octet_length(text))).first()[0] or 0


def tasks_for(size: int, spark: SparkSession) -> int:
    """Tasks over texts of ``size`` bytes, so that each has at most about TASK_BYTES.

    Left to itself AQE joins partitions up to a compressed size, and their
    number has an upper limit, so a task would grow with the table.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // TASK_BYTES), min(usual, -(-size // SMALL_BYTES)))


def cut(rows: DataFrame, position: str) -> DataFrame:
    """Slice groups by a non-negative integer position, if any group needs it.

    (group, position) is unique, so a slice never exceeds 2**SLICE_BITS rows.
    The check is a pushed-down ``position >= bound`` filter with limit 1: where
    no group is long, the scan skips every row group by its statistics.
    """
    if rows.filter(F.col(position) >= (1 << SLICE_BITS)).isEmpty():
        return rows
    return rows.withColumn(SLICE, F.shiftright(F.col(position).cast("bigint"), SLICE_BITS))


def cut_by_range(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Slice groups by sampled ranges of (group, order).

    For orders without integer positions. Spark's range partitioning keeps each
    slice to a fair share of the table whatever the distribution. Rows are
    checkpointed because sampled borders may differ between two evaluations, so
    pass narrow rows (keys and metadata, no texts).
    """
    ranged = rows.repartitionByRange(*group, *order)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")))


def is_sliced(rows: DataFrame) -> bool:
    return SLICE in rows.columns


def _inside(rows: DataFrame, group: Sequence[str], order: Sequence[str]):
    keys = [*group, SLICE] if is_sliced(rows) else list(group)
    return Window.partitionBy(*keys).orderBy(*order)


def _slices_of(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(SLICE)


def _long_groups_only(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of groups with several slices; only these have borders to cross."""
    spans = rows.groupBy(*group).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi"))
    return rows.join(spans.filter("_lo < _hi").select(*group), list(group), "left_semi")


def _neighbour(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str], prefix: str, forward: bool
) -> DataFrame:
    window = _inside(rows, group, order)
    shift = F.lead if forward else F.lag
    if not is_sliced(rows):
        return rows.withColumns({f"{prefix}{f}": shift(f).over(window) for f in fields})

    # The outermost row of a slice, addressed to the neighbouring slice.
    pick = F.min_by if forward else F.max_by
    outer = _long_groups_only(rows, group).groupBy(*group, SLICE).agg(
        *[pick(f, F.struct(*order)).alias(f"_edge_{f}") for f in fields]
    )
    target = (F.lag if forward else F.lead)(SLICE).over(_slices_of(group))
    edges = outer.withColumn("_to", target).drop(SLICE).withColumnRenamed("_to", SLICE)

    inside = rows.withColumns(
        {"_has": shift(F.lit(True)).over(window), **{f"_in_{f}": shift(f).over(window) for f in fields}}
    )
    joined = inside.join(edges.filter(F.col(SLICE).isNotNull()), [*group, SLICE], "left")
    return joined.select(
        *rows.columns,
        *[
            F.when(F.col("_has"), F.col(f"_in_{f}")).otherwise(F.col(f"_edge_{f}")).alias(f"{prefix}{f}")
            for f in fields
        ],
    )


def with_next(rows: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Add ``next_<field>`` of the following row of the group (NULL at the end)."""
    return _neighbour(rows, group, order, fields, "next_", forward=True)


def with_previous(rows: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Add ``prev_<field>`` of the preceding row of the group (NULL at the start)."""
    return _neighbour(rows, group, order, fields, "prev_", forward=False)


def with_running_sum(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, name: str
) -> DataFrame:
    """Add the sum of ``amount`` over the group up to and including the row."""
    window = _inside(rows, group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not is_sliced(rows):
        return rows.withColumn(name, F.sum(amount).over(window).cast("bigint"))

    totals = _long_groups_only(rows, group).groupBy(*group, SLICE).agg(F.sum(amount).alias("_total"))
    earlier = _slices_of(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, SLICE, F.sum("_total").over(earlier).alias("_offset"))
    joined = rows.withColumn("_sum", F.sum(amount).over(window)).join(offsets, [*group, SLICE], "left")
    total = F.col("_sum") + F.coalesce(F.col("_offset"), F.lit(0))
    return joined.select(*rows.columns, total.cast("bigint").alias(name))


def with_row_number(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position of the row in its group."""
    return with_running_sum(rows, group, order, F.lit(1), name)


def attach(rows: DataFrame, attributes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join one attribute row per group without gathering a hot group.

    For sliced rows the attribute row is repeated once per slice of its group
    and the join key is (group, slice).
    """
    if not is_sliced(rows):
        return rows.join(attributes, list(group), "left")
    occupied = rows.select(*group, SLICE).distinct()
    return rows.join(occupied.join(attributes, list(group)), [*group, SLICE], "left")


def cut_large_groups(rows: DataFrame, group: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """``cut_by_range`` when some group has more than ``limit`` rows, else ``rows``."""
    largest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    return rows if largest <= limit else cut_by_range(rows, group, order)
