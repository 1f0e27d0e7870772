"""Joins beyond equality: bucketed range and overlap joins, as-of neighbours, first match, coverage audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import CELL, LEAD, earlier, in_cells, inside, later, with_leads


def _buckets(s: Column, last: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(s / width), F.floor(last / width)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, width: int, ends: tuple[str, str] = ("s", "e")) -> DataFrame:
    """Each (point, interval) with s <= t < e under equal keys (`ends` names s and e). Time is cut into buckets of `width` ticks which
    join the keys, so a key with many rows spreads over as many partitions as it has buckets."""
    left = points.withColumn("_b", F.floor(F.col(t) / width))
    s, e = (F.col(c) for c in ends)
    right = intervals.where(s < e).withColumn("_b", _buckets(s, e - 1, width))
    return left.join(right, [*by, "_b"]).where((F.col(t) >= s) & (F.col(t) < e)).drop("_b")


def overlapping(a: DataFrame, b: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Pairs of a (s, e) and b (s2, e2) that share ticks under equal keys, each pair once: it belongs to the bucket
    where the later of the two starts lies."""
    left = a.where("s < e").withColumn("_b", _buckets(F.col("s"), F.col("e") - 1, width))
    right = b.where("s2 < e2").withColumn("_b", _buckets(F.col("s2"), F.col("e2") - 1, width))
    own = F.floor(F.greatest("s", "s2") / width)
    return left.join(right, [*by, "_b"]).where((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & (F.col("_b") == own)).drop("_b")


def neighbours(df: DataFrame, by: Sequence[str], at: str, marked: Column, value: Column | None = None, width: int | None = None) -> DataFrame:
    """Adds prev and next: `value` (default: the position) of the nearest marked rows at or before, at or after.
    width: ticks of a cell, for keys that may be hot; without it a key's rows are sorted in one task."""
    value = F.col(at) if value is None else value
    before, after = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    if width is None:
        w, hit = Window.partitionBy(*by).orderBy(at), F.when(marked, value)
        return df.withColumns({"prev": F.last(hit, ignorenulls=True).over(w.rowsBetween(*before)), "next": F.first(hit, ignorenulls=True).over(w.rowsBetween(*after))})
    hit = F.when(marked & value.isNotNull(), F.struct(F.col(at).alias("t"), value.alias("v")))
    rows = in_cells(df.withColumn("_hit", hit), at, width)
    rows = with_leads(rows, by, [F.max("_hit").alias("_back"), F.min("_hit").alias("_on")], [earlier(F.max, "_back"), later(F.min, "_on")])
    w, cell = inside(by, at), Window.partitionBy(*by, CELL)
    prev = F.coalesce(F.last("_hit", ignorenulls=True).over(w.rowsBetween(*before)), F.max("_back").over(cell))
    next_ = F.coalesce(F.first("_hit", ignorenulls=True).over(w.rowsBetween(*after)), F.min("_on").over(cell))
    found = rows.withColumns({"_p": prev, "_q": next_}).where(f"{LEAD} = 1")
    return found.withColumns({"prev": F.col("_p.v"), "next": F.col("_q.v")}).drop("_hit", "_back", "_on", "_p", "_q", CELL, LEAD)


def nearest(df: DataFrame, at: str) -> DataFrame:
    """Adds source and distance from prev and next; a tie takes the earlier."""
    back, ahead = F.col(at) - F.col("prev"), F.col("next") - F.col(at)
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    return df.withColumn("source", pick).withColumn("distance", F.abs(F.col(at) - F.col("source")))


def first_match(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by `order`: a grouped minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_m")).select(*by, "_m.*")


def coverage_audit(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row: keys on both sides, only left, only right."""
    l, r = left.select(*by).distinct().withColumn("_l", F.lit(1)), right.select(*by).distinct().withColumn("_r", F.lit(1))  # noqa: E741
    both = l.join(r, list(by), "full")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("extra"))
