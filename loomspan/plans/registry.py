"""Registry of named queries. A query gets the tables of one folder and returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL_TICKS = 86_400_000_000  # a day of microseconds: what one task sorts of a hot key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def intervals(self) -> DataFrame:
        """events as intervals: u user, id, k type, s, e microseconds, v value; value times ten minutes long."""
        s = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.events.select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), F.col("event_type").alias("k"), s.alias("s"), (s + F.floor(F.col("value") * 600000000)).alias("e"), F.col("value").alias("v"))

    def sides(self) -> DataFrame:
        return self.intervals().where("e > s and k in ('click', 'purchase')")

    def boxes(self) -> DataFrame:
        """lineitem as boxes of frames: o order, f line, x, y, w, and what orders repeated frames."""
        return self.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("f"), (F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") % 200).alias("y"), (100 + F.floor("l_quantity") * 4).alias("w"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("sk"), F.col("l_returnflag").alias("flag"))

    def clock(self) -> DataFrame:
        """Intervals with each user's ordinal i from 0 by (s, id)."""
        return self.intervals().withColumn("i", F.row_number().over(Window.partitionBy("u").orderBy("s", "id")) - 1)


EV = "ev as (select user_id u, event_id id, event_type k, epoch_us(ts)::bigint s, (epoch_us(ts) + floor(value * 600000000))::bigint e, value v from events)"
SIDES = f"{EV}, sd as (select * from ev where e > s and k in ('click', 'purchase'))"
CLOCK = f"{EV}, ck as (select *, row_number() over (partition by u order by s, id) - 1 i from ev)"
BOX = "bx as (select l_orderkey o, l_linenumber f, l_partkey % 400 x, l_suppkey % 200 y, (100 + floor(l_quantity) * 4)::bigint w, l_extendedprice price, l_partkey p, l_suppkey sk, l_returnflag flag from lineitem)"


def islands(src: str, by: str, joins: str = "s <= p_") -> str:
    """SQL: the union of intervals of src per key."""
    return f"select {by}, min(s) s, max(e) e from (select *, sum(case when {joins} then 0 else 1 end) over (partition by {by} order by s, e rows unbounded preceding) g_ from (select *, max(e) over (partition by {by} order by s, e rows between unbounded preceding and 1 preceding) p_ from {src})) group by {by}, g_"


def query(sql: str | None = None):
    """Registers f(tables) under its name, with DuckDB SQL for the same rows where SQL can say it."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
