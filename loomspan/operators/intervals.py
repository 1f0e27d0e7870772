"""Half-open interval algebra over rows (keys..., s, e) in integer ticks.

Overlap, intersection and coverage come from one sweep: start and end points are netted per instant, a running
sum counts what is open, and the next instant closes the segment. That is a sort per key or cell, never a product of
the two sides, so a key with many intervals costs n log n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import CELL, LEAD, earlier, in_cells, inside, later, previous, with_leads


def merge(df: DataFrame, by: Sequence[str], gap: int = 0, strict: bool = False, width: int | None = None) -> DataFrame:
    """Union of intervals per key. Intervals join when s <= running end + gap; strict: only when s < it.

    width: ticks of a cell, for keys that may be hot; without it a key's rows are sorted in one task."""
    rows = df.select(*by, "s", "e")
    joins = lambda end: F.col("s") < end if strict else F.col("s") <= end + F.lit(gap)
    if width is None:
        w = Window.partitionBy(*by).orderBy("s", "e")
        flagged = rows.withColumn("_new", F.when(joins(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))), 0).otherwise(1))
        island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return flagged.withColumn("_g", island).groupBy(*by, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")
    w = inside(by, "s", "e")
    rows = with_leads(in_cells(rows, "s", width), by, [F.max("e").alias("e")], [earlier(F.max, "e")])
    end = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.when((F.col(LEAD) == 0) | joins(end), 0).otherwise(1))
    pieces = flagged.withColumn("_l", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(LEAD) == 1)
    pieces = pieces.groupBy(*by, CELL, "_l").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    pieces = pieces.withColumn("_last", F.max("_l").over(Window.partitionBy(*by, CELL)))
    # A cell's first piece may go on from earlier cells, its last into later ones: two rows a cell at most.
    edge = (F.col("_l") == 0) | (F.col("_l") == F.col("_last"))
    run = Window.partitionBy(*by).orderBy(CELL, "_l").rowsBetween(Window.unboundedPreceding, 0)
    stitched = pieces.where(edge).withColumn("_g", F.sum(F.least("_l", F.lit(1))).over(run))
    stitched = stitched.groupBy(*by, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return pieces.where(~edge).select(*by, "s", "e").union(stitched.select(*by, "s", "e"))


def sweep(df: DataFrame, by: Sequence[str], side: str | None = None, sides: Sequence = (), width: int | None = None) -> DataFrame:
    """Segments (by, s, e, c or c_<side>...) between consecutive end points, with how many intervals cover each.
    width: as in merge."""
    keep = [*by, *([side] if side else [])]
    points = df.select(*keep, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("p")).select(*keep, "p.t", "p.d")
    names = [f"c_{x}" for x in sides] if side else ["c"]
    sums = [F.sum(F.when(F.col(side) == x, F.col("d")).otherwise(0)).alias(n) for x, n in zip(sides, names, strict=True)] if side else [F.sum("d").alias("c")]
    net = points.groupBy(*by, "t").agg(*sums)
    if width is None:
        w, ahead = Window.partitionBy(*by).orderBy("t"), None
    else:
        net = with_leads(in_cells(net, "t", width), by, [*[F.sum(n).alias(n) for n in names], F.min("t").alias("_t")], [*[earlier(F.sum, n) for n in names], later(F.min, "_t")])
        w, ahead = inside(by, "t"), F.max("_t").over(Window.partitionBy(*by, CELL))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    end = F.lead("t").over(w) if ahead is None else F.coalesce(F.lead("t").over(w), ahead)
    own = [] if width is None else [LEAD]
    out = net.select(*by, *own, F.col("t").alias("s"), end.alias("e"), *[F.sum(n).over(run).alias(n) for n in names]).where("e is not null")
    return out.where(F.col(LEAD) == 1).drop(LEAD) if own else out


def covered(df: DataFrame, by: Sequence[str], k: int, width: int | None = None) -> DataFrame:
    """Maximal intervals covered by k intervals or more."""
    return merge(sweep(df, by, width=width).where(F.col("c") >= k), by, width=width)


def intersect(df: DataFrame, by: Sequence[str], side: str, a, b, width: int | None = None) -> DataFrame:
    """Maximal intervals that both sides cover."""
    return merge(sweep(df, by, side, (a, b), width).where(F.col(f"c_{a}") > 0).where(F.col(f"c_{b}") > 0), by, width=width)


def durations(df: DataFrame, by: Sequence[str], side: str, pred, truth, width: int | None = None) -> DataFrame:
    """(by, pd, td, tp): covered ticks of the prediction, of the truth and of both; keys with neither are absent."""
    p, t, size = F.col(f"c_{pred}") > 0, F.col(f"c_{truth}") > 0, F.col("e") - F.col("s")
    total = lambda c, n: F.sum(F.when(c, size).otherwise(0)).alias(n)
    return sweep(df, by, side, (pred, truth), width).groupBy(*by).agg(total(p, "pd"), total(t, "td"), total(p & t, "tp"))


def prf(df: DataFrame, policy: str) -> DataFrame:
    """precision, recall, f1 from (pd, td, tp). Empty cases: a: both empty is 1, b: 0, c: either empty is 0,
    d: undefined parts are null."""
    pd, td, tp = F.col("pd"), F.col("td"), F.col("tp")
    ratio = lambda n, d: F.try_divide(n.cast("double"), d.cast("double"))
    p, r, f = ratio(tp, pd), ratio(tp, td), ratio(2 * tp, pd + td)
    if policy == "d":
        return df.withColumns({"precision": p, "recall": r, "f1": f})
    both = {"a": 1.0, "b": 0.0, "c": 0.0}[policy]
    fill = lambda x: F.when((pd == 0) & (td == 0), both).otherwise(F.coalesce(x, F.lit(0.0)))
    return df.withColumns({"precision": fill(p), "recall": fill(r), "f1": fill(f)})


def complement(df: DataFrame, bounds: DataFrame, by: Sequence[str], width: int | None = None) -> DataFrame:
    """What the intervals leave of each key's [lo, hi). width: as in merge."""
    merged = merge(df, by, width=width)
    if width is None:
        merged = merged.withColumn("prev_e", F.lag("e").over(Window.partitionBy(*by).orderBy("s")))
    else:
        merged = previous(merged, by, ["s"], ["e"], width)
    before = merged.join(bounds, list(by)).select(*by, F.coalesce("prev_e", "lo").alias("a"), F.col("s").alias("b"))
    tail = bounds.join(merged.groupBy(*by).agg(F.max("e").alias("last")), list(by), "left").select(*by, F.coalesce("last", "lo").alias("a"), F.col("hi").alias("b"))
    return before.union(tail).select(*by, F.col("a").alias("s"), F.col("b").alias("e")).where("s < e")


def pad(df: DataFrame, lead: Column, tail: Column, lo: Column, hi: Column) -> DataFrame:
    """Grows each interval by lead and tail, inside [lo, hi)."""
    return df.withColumns({"s": F.greatest(F.col("s") - lead, lo), "e": F.least(F.col("e") + tail, hi)})


def clip(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The part of each interval inside [lo, hi); empty ones go."""
    return df.withColumns({"s": F.greatest("s", lo), "e": F.least("e", hi)}).where("s < e")


def partition_check(df: DataFrame, by: Sequence[str], side: str, sets: dict[str, str], width: int | None = None) -> DataFrame:
    """(by, ticks of each set, overlap, hole, tiles): whether the sets (side value -> column) tile each key's domain,
    which runs from the first start to the last end of all its rows. overlap: ground of two sets or more; hole: of none."""
    rest = df.withColumn("_side", F.when(F.col(side).isin(*sets), F.col(side)).otherwise("_rest"))
    x = sweep(rest, by, "_side", (*sets, "_rest"), width)
    many = sum((F.when(F.col(f"c_{k}") > 0, 1).otherwise(0) for k in sets), F.lit(0))
    size = lambda c: F.sum(F.when(c, F.col("e") - F.col("s")).otherwise(0))
    out = x.groupBy(*by).agg(*[size(F.col(f"c_{k}") > 0).alias(n) for k, n in sets.items()], size(many > 1).alias("overlap"), size(many == 0).alias("hole"))
    return out.withColumn("tiles", (F.col("overlap") == 0) & (F.col("hole") == 0))
