"""Scans along keys: ordinals, previous rows, segments and neighbouring marks, from one sort.

Keys that one task can sort are scanned by windows. Where a key is larger, rows are scanned in two levels: they are sorted once in range partitions of (key, order) and written; a key with most rows spreads over many of them.
What a slice (one key in one partition) has to tell the others is a summary of fixed size that composes: how many rows
and segments it holds, its last row, its first and last marks. Summaries run along each key, and each slice is then
finished on its own. Chained quantities (a segment number that needs previous rows, marks that need ordinals and
segments) share the one sort. Null keys form a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Scratch

WHOLE = 1 << 20

def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], previous: Sequence[str] = (), cut: Column | None = None, mark: Column | None = None, value: Column | None = None, whole: int = WHOLE) -> DataFrame:
    """Adds i, the row's place from 0 in its key by `order`; n, the rows of the key; and prev_<column> for each of
    `previous`, null in a key's first row.

    cut: a condition on the row, i, n and prev_ columns: a row begins a segment. Adds segment, how many rows have begun
    one up to here. mark: a condition likewise. Adds before and after: struct<i, segment, v> of the
    nearest marked row at or before, at or after this one in its key, v being `value` (default: i).
    whole: rows of a key that one task may sort; a larger key spreads, with the same result."""
    hit = F.struct("i", "segment", (F.col("i") if value is None else value).alias("v"))
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= whole:
        return _by_windows(df, by, order, previous, cut, mark, hit)
    return _by_slices(df, by, order, previous, cut, mark, hit)


def _by_windows(df: DataFrame, by: Sequence[str], order: Sequence[str], previous: Sequence[str], cut: Column | None, mark: Column | None, hit: Column) -> DataFrame:
    key = Window.partitionBy(*by)
    rows = df.withColumns({"i": F.row_number().over(key.orderBy(*order)).cast("long") - 1, **{f"prev_{c}": F.lag(c).over(key.orderBy(*order)) for c in previous}, "n": F.count("*").over(key)})
    if cut is None and mark is None:
        return rows
    along = key.orderBy("i")
    rows = rows.withColumn("segment", F.sum(F.when(cut, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)) if cut is not None else F.lit(0).cast("long"))
    if mark is None:
        return rows
    rows = rows.withColumn("_hit", F.when(mark, hit))
    before = F.last("_hit", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"before": before, "after": F.first("_hit", ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))}).drop("_hit")


def _by_slices(df: DataFrame, by: Sequence[str], order: Sequence[str], previous: Sequence[str], cut: Column | None, mark: Column | None, hit: Column) -> DataFrame:
    scratch = Scratch(df.sparkSession, "scan")
    names = [*by, *order]
    rows = scratch.keep(df.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_m", F.monotonically_increasing_id()), "rows")
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    slice_, along = [*by, "_p"], Window.partitionBy(*by).orderBy("_p")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    inside = Window.partitionBy(*slice_).orderBy("_m")

    last = [F.max_by(F.struct(*previous), "_m").alias("_row")] if previous else []
    tops = rows.groupBy(*slice_).agg(F.min("_m").alias("_first"), F.count("*").alias("_n"), *last)
    carried = [F.lag("_row").over(along).alias("_carried")] if previous else []
    tops = tops.select(*slice_, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"), F.sum("_n").over(Window.partitionBy(*by)).alias("n"), *carried)
    rows = _joined(rows, tops, slice_).withColumn("i", F.col("_begin") + F.col("_m") - F.col("_first"))
    if previous:
        own = F.when(F.col("_m") == F.col("_first"), F.col("_carried")).otherwise(F.lag(F.struct(*previous)).over(inside))
        rows = rows.withColumn("_back", own).withColumns({f"prev_{c}": F.col(f"_back.{c}") for c in previous}).drop("_back", "_carried")
    rows = rows.drop("_begin", "_first")
    if cut is None and mark is None:
        return rows.drop("_m", "_p")

    local = F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_cut", F.when(cut, 1).otherwise(0).cast("long") if cut is not None else F.lit(0).cast("long")).withColumn("segment", local)
    if mark is None:
        tops = rows.groupBy(*slice_).agg(F.sum("_cut").alias("_cuts"))
        tops = tops.select(*slice_, F.coalesce(F.sum("_cuts").over(earlier), F.lit(0)).alias("_base"))
        return _joined(rows, tops, slice_).withColumn("segment", F.col("_base") + F.col("segment")).drop("_m", "_p", "_cut", "_base")

    rows = rows.withColumn("_hit", F.when(mark, hit))
    tops = rows.groupBy(*slice_).agg(F.sum("_cut").alias("_cuts"), F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("i"))).alias("_top"), F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("i"))).alias("_low"))
    tops = tops.withColumn("_base", F.coalesce(F.sum("_cuts").over(earlier), F.lit(0)))
    lifted = lambda hit, base: F.when(hit.isNotNull(), hit.withField("segment", hit["segment"] + base))
    tops = tops.select(*slice_, "_base", lifted(F.col("_top"), F.col("_base")).alias("_top"), lifted(F.col("_low"), F.col("_base")).alias("_low"))
    tops = tops.select(*slice_, "_base", F.last("_top", ignorenulls=True).over(earlier).alias("_behind"), F.first("_low", ignorenulls=True).over(later).alias("_ahead"))
    rows = rows.withColumn("_up", F.last("_hit", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_on", F.first("_hit", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    rows = _joined(rows, tops, slice_).withColumn("segment", F.col("_base") + F.col("segment"))
    rows = rows.withColumn("before", F.coalesce(lifted(F.col("_up"), F.col("_base")), "_behind")).withColumn("after", F.coalesce(lifted(F.col("_on"), F.col("_base")), "_ahead"))
    return rows.drop("_m", "_p", "_cut", "_hit", "_up", "_on", "_base", "_behind", "_ahead")


def _joined(rows: DataFrame, tops: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the columns of their slice; summaries are sent to all tasks where Spark finds them small."""
    other = tops.withColumnsRenamed({c: f"_of{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    return rows.join(other, same).drop(*[f"_of{i}" for i in range(len(by))])


def nearest_mark(rows: DataFrame, within_segment: bool) -> DataFrame:
    """Adds source, the v of the nearest mark of a scan, and distance in places; a tie takes the earlier. within_segment:
    marks of other segments do not count."""
    kept = lambda c: F.when(F.col(f"{c}.segment") == F.col("segment"), F.col(c)) if within_segment else F.col(c)
    rows = rows.withColumn("_a", kept("before")).withColumn("_b", kept("after"))
    back, ahead = F.col("i") - F.col("_a.i"), F.col("_b.i") - F.col("i")
    near = F.when(F.col("_b").isNull() | (back <= ahead), F.col("_a")).otherwise(F.col("_b"))
    return rows.withColumn("_near", near).withColumn("source", F.col("_near.v")).withColumn("distance", F.abs(F.col("i") - F.col("_near.i"))).drop("_a", "_b", "_near")
