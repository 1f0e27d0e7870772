"""Ordered per-key work in two levels, so that a key with a large share of all rows spreads over many tasks.

A key's line is cut into cells of `width` ticks. Sums over cells are combined before they shuffle and run along
each key; every cell then gets one lead row with what its neighbours hold, sorted ahead of its own rows, and the
window runs inside the cell. The rows themselves shuffle once. Null keys form a key, as in any window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.shared import Scratch

CELL, LEAD = "_cell", "_lead"


def in_cells(df: DataFrame, at: str, width: int) -> DataFrame:
    """Adds the cell that holds each row."""
    return df.withColumn(CELL, F.floor(F.col(at) / width).cast("long"))


def with_leads(rows: DataFrame, by: Sequence[str], sums: Sequence[Column], carried: Sequence[Callable[[Sequence[str]], Column]]) -> DataFrame:
    """Rows of cells together with a lead row for each cell. sums: aggregates of a cell; carried: columns of the lead
    row, built on `earlier(...)` or `later(...)` of these sums. Lead rows have LEAD 0, others 1 and null carried columns."""
    tops = rows.groupBy(*by, CELL).agg(*sums)
    leads = tops.select(*by, CELL, *[c(by) for c in carried], F.lit(0).alias(LEAD))
    return rows.withColumn(LEAD, F.lit(1)).unionByName(leads, allowMissingColumns=True)


def earlier(total, name: str, alias: str | None = None):
    """A lead column: `total` (F.max, F.sum) of `name` over the key's earlier cells."""
    return lambda by: total(name).over(Window.partitionBy(*by).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)).alias(alias or name)


def later(total, name: str, alias: str | None = None):
    """A lead column: `total` (F.min) of `name` over the key's later cells."""
    return lambda by: total(name).over(Window.partitionBy(*by).orderBy(CELL).rowsBetween(1, Window.unboundedFollowing)).alias(alias or name)


def inside(by: Sequence[str], *order: str) -> WindowSpec:
    """A cell's rows in order, its lead row first."""
    return Window.partitionBy(*by, CELL).orderBy(LEAD, *order)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, width: int, name: str) -> DataFrame:
    """Adds the sum of `value` over the key's rows up to each by `order`, whose first column is cut into cells of `width`."""
    rows = in_cells(df.withColumn("_v", value.cast("long")), order[0], width)
    rows = with_leads(rows, by, [F.sum("_v").alias("_v")], [earlier(F.sum, "_v")])
    total = F.sum("_v").over(inside(by, *order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, total).where(f"{LEAD} = 1").drop("_v", CELL, LEAD)


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, width: int, name: str) -> DataFrame:
    """Adds the largest `value` over the key's rows up to each by `order`; cells as in running_sum."""
    rows = in_cells(df.withColumn("_v", value), order[0], width)
    rows = with_leads(rows, by, [F.max("_v").alias("_v")], [earlier(F.max, "_v")])
    top = F.max("_v").over(inside(by, *order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, top).where(f"{LEAD} = 1").drop("_v", CELL, LEAD)


def ordinals(df: DataFrame, by: Sequence[str], order: Sequence[str], width: int, name: str = "i") -> DataFrame:
    """Adds each row's place from 0 in its key by `order`."""
    return running_sum(df, by, order, F.lit(1), width, name).withColumn(name, F.col(name) - 1)


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int) -> DataFrame:
    """Adds prev_<column>: the values of the key's row before, by `order`; null for its first."""
    rows = in_cells(df, order[0], width).withColumn("_row", F.struct(*order, *[F.col(c).alias(f"prev_{c}") for c in columns]))
    rows = with_leads(rows, by, [F.max("_row").alias("_row")], [earlier(F.max, "_row")])
    rows = rows.withColumn("_before", F.lag("_row").over(inside(by, *order))).where(f"{LEAD} = 1")
    return rows.withColumns({f"prev_{c}": F.col(f"_before.prev_{c}") for c in columns}).drop("_row", "_before", CELL, LEAD)


def following(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], width: int) -> DataFrame:
    """Adds next_<column>: the values of the key's row after, by `order`; null for its last."""
    rows = in_cells(df, order[0], width).withColumn("_row", F.struct(*order, *[F.col(c).alias(f"next_{c}") for c in columns]))
    rows = with_leads(rows, by, [F.min("_row").alias("_row")], [later(F.min, "_row", "_on")])
    ahead = F.coalesce(F.lead("_row").over(inside(by, *order)), F.max("_on").over(Window.partitionBy(*by, CELL)))
    rows = rows.withColumn("_after", ahead).where(f"{LEAD} = 1")
    return rows.withColumns({f"next_{c}": F.col(f"_after.next_{c}") for c in columns}).drop("_row", "_on", "_after", CELL, LEAD)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """Adds `name`: each row's place from 0 in its key by `order`, or the sum of `weight` of the rows before it; and
    `total`: the key's rows or weights in all.

    Rows are sorted once in range partitions of (key, order), so a key with most rows spreads over many tasks. They
    are written with their places inside the partition, and each (key, partition) gets what lies before it. Null
    keys form a key."""
    scratch = Scratch(df.sparkSession, "positions")
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    names = [*by, *[f"_k{i}" for i in range(len(order))]]
    # One run of one plan numbers the rows: partitions may differ between two runs.
    rows = scratch.keep(keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_m", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    tops = rows.groupBy(*by, "_p").agg(F.min("_m").alias("_first"), (F.sum(weight) if weight else F.count("*")).alias("_n"))
    every = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_first", before.alias("_before"), F.sum("_n").over(every).alias("_all"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy(*by, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.col("_m") - F.col("_first")
    out = rows.join(tops, same).withColumn("_at", F.col("_before") + inside)
    return out.select(*df.columns, F.col("_at").alias(name), *([F.col("_all").alias(total)] if total else []))
