"""Boxes. Heights follow a target ratio; areas are compared in whole numbers, scaled by the ratio."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _meet(a: Column, a2: Column, b: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a, b))


def overlap_parts(a: Column, b: Column, tw: int, th: int) -> tuple[Column, Column]:
    """(intersection, union) of boxes {x, y, w} with h = w * th / tw, both scaled by tw: whole numbers."""
    num = lambda c: c.cast("long")
    ax, ay, aw, bx, by, bw = (num(c[k]) for c in (a, b) for k in ("x", "y", "w"))
    inter = _meet(ax, ax + aw, bx, bx + bw) * _meet(ay * tw, ay * tw + aw * th, by * tw, by * tw + bw * th)
    return inter, aw * aw * th + bw * bw * th - inter


def iou_ratio(a: Column, b: Column, tw: int, th: int) -> Column:
    inter, union = overlap_parts(a, b, tw, th)
    return F.try_divide(inter.cast("double"), union.cast("double"))


def iou_xywh(a: Column, b: Column) -> Column:
    """IoU of {x, y, w, h} boxes of whole numbers."""
    inter = _meet(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * _meet(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    return F.try_divide(inter.cast("double"), (a["w"] * a["h"] + b["w"] * b["h"] - inter).cast("double"))


def crop_width(width: Column, height: Column, tw: int, th: int) -> Column:
    """Largest whole width whose derived height fits: w <= width and w * th <= height * tw."""
    return F.least(width, F.floor(height * tw / F.lit(th)))


def legal(box: Column, width: Column, height: Column, tw: int, th: int) -> Column:
    x, y, w = box["x"], box["y"], box["w"]
    return (x >= 0) & (y >= 0) & (w > 0) & (x + w <= width) & (y * tw + w * th <= height * tw)


def half_even(num: Column, den: Column) -> Column:
    """num / den rounded half to even, exactly, in whole numbers (den > 0)."""
    rest = F.pmod(num, den)
    q = F.round((num - rest) / den).cast("long")  # a whole quotient
    return q + F.when((2 * rest > den) | ((2 * rest == den) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)


EXACT = "decimal(38,0)"  # whole numbers beyond long, as the products of a cubic's ratios are


def tangent(before: Column, after: Column, a: Column, b: Column) -> Column:
    """The slope of a monotone cubic at a support, as an exact ratio struct<n, m>: the weighted harmonic mean of the
    slopes a / before and b / after, or 0 where they do not agree in sign. Null where a gap or difference is."""
    before, after, a, b = (x.cast(EXACT) for x in (before, after, a, b))
    w1, w2 = 2 * after + before, after + 2 * before
    same = (a > 0) & (b > 0) | (a < 0) & (b < 0)
    top = F.when(a > 0, w1 + w2).otherwise(-(w1 + w2)) * F.abs(a) * F.abs(b)
    under = w1 * before * F.abs(b) + w2 * after * F.abs(a)
    zero = F.lit(0).cast(EXACT)
    return F.when(before.isNotNull() & after.isNotNull() & a.isNotNull() & b.isNotNull(), F.struct(F.when(same, top).otherwise(zero).cast(EXACT).alias("n"), F.when(same, under).otherwise(zero + 1).cast(EXACT).alias("m")))


def cubic(y1: Column, y2: Column, t1: Column, t2: Column, k: Column, h: int = 8) -> tuple[Column, Column]:
    """The cubic between two supports h apart with tangents t1 and t2, at k ticks after the first, as an exact ratio."""
    k, y1, y2 = k.cast(EXACT), y1.cast(EXACT), y2.cast(EXACT)
    at = (2 * k * k * k - 3 * h * k * k + h**3) * y1 + (3 * h * k * k - 2 * k * k * k) * y2
    lean = (k * k * k - 2 * h * k * k + h * h * k) * t1["n"] * t2["m"] + (k * k * k - h * k * k) * t2["n"] * t1["m"]
    both = t1["m"] * t2["m"]
    return (at * both + h * lean).cast(EXACT), (h**3 * both).cast(EXACT)


def pchip(z: list[Column], h0: Column, h2: Column, k: Column, h: int = 8) -> Column:
    """Monotone cubic through four whole-number supports with gaps h0, h, h2, at k ticks after the second, as a whole
    number rounded half to even. Supports up to 10^9 in size are exact."""
    t1, t2 = tangent(h0, F.lit(h), z[1] - z[0], z[2] - z[1]), tangent(F.lit(h), h2, z[2] - z[1], z[3] - z[2])
    return half_even(*cubic(z[1], z[2], t1, t2, k, h))


@dataclass(frozen=True)
class Gap:
    """A place k ticks after support p, which is followed by q: structs {i, y}; t1 and t2 are the tangents at both, null
    where the supports beyond are missing."""

    p: Column
    q: Column
    t1: Column
    t2: Column
    k: Column

    @property
    def width(self) -> Column:
        return self.q["i"] - self.p["i"]


#: Says where it applies, and its value there as an exact ratio (numerator, denominator).
Rule = Callable[[Gap], tuple[Column, Column, Column]]


def linear_rule(g: Gap) -> tuple[Column, Column, Column]:
    return F.lit(True), g.p["y"] * (g.width - g.k) + g.q["y"] * g.k, g.width


def cubic_rule(h: int = 8) -> Rule:
    """The monotone cubic, in gaps of h that have a support more on either side."""
    return lambda g: (g.t1.isNotNull() & g.t2.isNotNull() & (g.width == h), *cubic(g.p["y"], g.q["y"], g.t1, g.t2, g.k, h))


def interpolate(df: DataFrame, g: Gap, **rules: Rule) -> DataFrame:
    """Adds y, a whole number rounded half to even, and src, the name of the rule: ANCHOR on the support, else the first
    of the rules that applies, each the delegate of those before it."""
    num, den, name = F.when(g.k == 0, g.p["y"].cast(EXACT)), F.when(g.k == 0, F.lit(1).cast(EXACT)), F.when(g.k == 0, "ANCHOR")
    for label, rule in rules.items():
        where, n, d = rule(g)
        num, den, name = num.when(where, n.cast(EXACT)), den.when(where, d.cast(EXACT)), name.when(where, label.upper())
    # The ratio is made once, as columns, and rounded after.
    return df.withColumns({"_num": num, "_den": den, "src": name}).withColumn("y", half_even(F.col("_num"), F.col("_den"))).drop("_num", "_den")
