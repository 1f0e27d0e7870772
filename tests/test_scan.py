"""Scans of keys that one task sorts and of keys that spread, against a loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import geometry as geo
from loomspan.operators.builders import planned_windows
from loomspan.operators.scan import nearest_mark, scan


def looped(rows):
    by = {}
    for k, s, name in rows:
        by.setdefault(k, []).append((s, name))
    out = set()
    for k, own in by.items():
        own.sort()
        segment, found = 0, []
        for i, (s, name) in enumerate(own):
            segment += i == 0 or s - own[i - 1][0] > 3
            found.append((i, s, own[i - 1][0] if i else None, segment, name == "m"))
        marks = [(i, g) for i, _, _, g, m in found if m]
        for i, s, prev, g, _ in found:
            before = max((x for x in marks if x[0] <= i), default=None)
            after = min((x for x in marks if x[0] >= i), default=None)
            near = [x for x in (before, after) if x and x[1] == g]
            source = min(near, key=lambda x: (abs(x[0] - i), x[0]), default=(None,))[0]
            out.add((k, s, i, len(own), prev, g, before and before[0], after and after[0], source))
    return out


@pytest.mark.parametrize("whole", [1 << 20, 0])
def test_scans_match_a_loop(spark, whole):
    """A third of the rows have one key, and some none; few marks, so that they lie slices apart."""
    rng = random.Random(3)
    keys = ["hot"] * 400 + [rng.choice(["a", "b", None, *"cdefgh"]) for _ in range(500)]
    at = {}
    rows = []
    for k in keys:
        at[k] = at.get(k, 0) + rng.choice([1, 1, 2, 3, 4, 9])
        rows.append((k, at[k], "m" if rng.random() < 0.03 else "x"))
    df = spark.createDataFrame(rows, "k string, s long, name string").orderBy(F.rand(2))
    x = scan(df, ["k"], ["s"], ["s"], F.col("prev_s").isNull() | (F.col("s") - F.col("prev_s") > 3), F.col("name") == "m", whole=whole)
    got = nearest_mark(x, True).select("k", "s", "i", "n", "prev_s", "segment", F.col("before.v"), F.col("after.v"), "source")
    assert {tuple(r) for r in got.collect()} == looped(rows) and got.count() == len(rows)
    plain = scan(df, ["k"], ["s"], whole=whole)
    assert plain.columns[:3] == ["k", "s", "name"] and {(r.k, r.s, r.i, r.n) for r in plain.collect()} == {x[:4] for x in looped(rows)}
    assert {(r.k, r.s, r.segment) for r in scan(df, ["k"], ["s"], cut=F.col("i") % 5 == 0, whole=whole).collect()} == {(k, s, i // 5 + 1) for k, s, i, *_ in looped(rows)}
    marked = scan(df, ["k"], ["s"], mark=F.expr("i % 8 = 0 or i = n - 1"), value=F.col("s"), whole=whole)
    places = {(k, i): s for k, s, i, *_ in looped(rows)}
    for r in marked.collect():
        low, high = r.i if r.i == r.n - 1 else r.i // 8 * 8, r.i if r.i % 8 == 0 else min(r.i // 8 * 8 + 8, r.n - 1)
        assert (r.before.i, r.before.v, r.after.i, r.after.v) == (low, places[r.k, low], high, places[r.k, high])
    assert scan(df.limit(0), ["k"], ["s"], ["s"], F.col("s") > 0, F.col("s") > 0, whole=whole - 1).count() == 0


def test_a_hot_key_spreads_over_tasks(spark):
    """One key holds two thirds of the rows; no task of the scan's windows holds more than a fraction of them."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        x = scan(df.repartition(16), ["k"], ["s"], ["s"], F.col("prev_s").isNull(), F.col("s") % 1000 == 1, whole=1000)
        parts = [r["count"] for r in x.where("k = -1").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(parts) == 40_000 and len(parts) > 1 and max(parts) < 30_000


def test_cubics_beyond_long(spark):
    df = spark.createDataFrame([(0, 10_000, 20_500, 30_000, 3), (0, 10**9, 2 * 10**9 + 7, 3 * 10**9, 5)], "a long, b long, c long, d long, k long")
    got = [r[0] for r in df.select(geo.pchip([F.col(x) for x in "abcd"], F.lit(8), F.lit(8), F.col("k"))).collect()]
    from fractions import Fraction

    def exact(z, k):
        p, q, r = (Fraction(b - a, 8) for a, b in zip(z, z[1:], strict=False))
        t = [48 / (24 / x + 24 / y) for x, y in ((p, q), (q, r))]
        x = Fraction(k, 8)
        return round((1 + 2 * x) * (1 - x) ** 2 * z[1] + x * (1 - x) ** 2 * 8 * t[0] + x * x * (3 - 2 * x) * z[2] + x * x * (x - 1) * 8 * t[1])

    assert got == [exact((0, 10_000, 20_500, 30_000), 3), exact((0, 10**9, 2 * 10**9 + 7, 3 * 10**9), 5)]


def test_rules_are_delegates_in_order(spark):
    """A rule of one's own goes before the linear one; places on a support are the support's."""
    point = lambda i, y: F.struct(F.lit(i).alias("i"), F.lit(y).alias("y"))
    nothing = F.lit(None).cast("struct<n:decimal(38,0),m:decimal(38,0)>")
    df = spark.range(0, 9, 1, 1)
    gap = geo.Gap(point(0, 10), point(8, 90), nothing, nothing, F.col("id"))
    got = geo.interpolate(df, gap, pchip=geo.cubic_rule(), hold=lambda g: (g.k < 3, g.p["y"], F.lit(1)), linear=geo.linear_rule)
    assert [(r.y, r.src) for r in got.collect()] == [(10, "ANCHOR"), (10, "HOLD"), (10, "HOLD")] + [(10 + 10 * k, "LINEAR") for k in range(3, 9)]


def test_windows_of_a_builder_of_ones_own(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 2, 1), (None, 3, 1), ("b", None, 1), ("c", 0, 1)], "k string, end int, a int")
    got = planned_windows(df, "k", "end", lambda end: [(0, end), (end, end + 1)] if end else [])
    assert got.columns == ["k", "a", "b"] and sorted(map(tuple, got.collect()), key=str) == sorted([("a", 0, 5), ("a", 5, 6), ("a", 0, 2), ("a", 2, 3), (None, 0, 3), (None, 3, 4)], key=str)
