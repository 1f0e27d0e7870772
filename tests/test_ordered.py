"""Work in cells gives what one window per key gives."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import intervals as iv
from loomspan.operators import joins as jn
from loomspan.operators import ordered


@pytest.fixture(scope="module")
def table(spark):
    """A hot key, small keys, a null key, long and empty intervals, ties, gaps over many cells."""
    rows = [(1, (i * 37) % 400, (i * 37) % 400 + (i * 11) % 9, "ab"[i % 2]) for i in range(120)]
    rows += [(1, 50, 130, "a"), (1, 900, 905, "b"), (1, 905, 905, "a"), (1, 905, 905, "a"), (2, 7, 7, "a"), (2, -13, 95, "b"), (3, 10, 20, "a"), (3, 20, 30, "b"), (None, 5, 25, "a"), (None, 15, 16, "b"), (4, 0, 10, "a"), (4, 0, 10, "a")]
    return spark.createDataFrame(rows, "u long, s long, e long, k string").repartition(5)


def bag(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("width", [1, 64])
def test_cells_change_nothing(table, width):
    u = ["u"]
    assert bag(iv.merge(table, u, width=width)) == bag(iv.merge(table, u))
    assert bag(iv.merge(table, u, gap=3, width=width)) == bag(iv.merge(table, u, gap=3))
    assert bag(iv.merge(table, u, strict=True, width=width)) == bag(iv.merge(table, u, strict=True))
    assert bag(iv.sweep(table, u, width=width)) == bag(iv.sweep(table, u))
    assert bag(iv.intersect(table, u, "k", "a", "b", width)) == bag(iv.intersect(table, u, "k", "a", "b"))
    assert bag(iv.durations(table, u, "k", "a", "b", width)) == bag(iv.durations(table, u, "k", "a", "b"))


@pytest.mark.parametrize("width", [10])
def test_neighbours_and_ordinals(table, width):
    points = table.groupBy("u", "s").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("s") != 50, F.col("n")))
    for value in (None, F.col("n") * 10):
        plain = jn.neighbours(points, ["u"], "s", F.col("s") % 5 == 0, value)
        assert bag(jn.neighbours(points, ["u"], "s", F.col("s") % 5 == 0, value, width)) == bag(plain)
    got = ordered.ordinals(points, ["u"], ["s"], width).collect()
    for key in {r.u for r in got}:
        own = sorted((r.s, r.i) for r in got if r.u == key)
        assert [i for _, i in own] == list(range(len(own)))


def test_empty(spark, table):
    none = table.where("s is null")
    assert iv.merge(none, ["u"], width=5).count() == iv.sweep(none, ["u"], width=5).count() == ordered.ordinals(none, ["u"], ["s"], 5).count() == 0


def test_previous_and_complement(table):
    rows = table.groupBy("u", "s").agg(F.max("e").alias("e")).withColumn("e", F.when(F.col("s") != 50, F.col("e")))
    plain = rows.withColumn("prev_e", F.lag("e").over(Window.partitionBy("u").orderBy("s")))
    assert bag(ordered.previous(rows, ["u"], ["s"], ["e"], 10)) == bag(plain)
    bounds = table.where("u is not null").groupBy("u").agg((F.min("s") - 5).alias("lo"), (F.max("e") + 5).alias("hi"))
    assert bag(iv.complement(table, bounds, ["u"], 10)) == bag(iv.complement(table, bounds, ["u"]))
