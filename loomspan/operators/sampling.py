"""Reproducible sampling: salted SHA-256 order instead of random state."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluate import salted
from .ordered import positions


def hash_sample(df: DataFrame, salt: str, key: Sequence[str], n: int) -> DataFrame:
    """The n rows of smallest salted hash: each partition sends its first n only."""
    return df.orderBy(salted(salt, *key), *key).limit(n)


def group_pick(df: DataFrame, by: str, salt: str, key: Sequence[str]) -> DataFrame:
    """One row per group, of smallest salted hash."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(salted(salt, *key), *key)).alias("_m")).select(by, "_m.*")


def largest_remainder(strata: DataFrame, by: str, total: int) -> DataFrame:
    """(by, n, quota): quotas in proportion to n that sum to total; ties of the remainder go by name."""
    every = Window.partitionBy()  # strata, not rows
    q = strata.withColumn("_t", F.sum("n").over(every)).withColumn("_q", F.expr(f"{total} * n div _t")).withColumn("_r", F.expr(f"{total} * n % _t"))
    short = total - F.sum("_q").over(every)
    extra = F.when(F.row_number().over(every.orderBy(F.desc("_r"), by)) <= short, 1).otherwise(0)
    return q.select(by, "n", (F.col("_q") + extra).alias("quota"))


def stratified_split(df: DataFrame, by: str, salt: str, key: Sequence[str], total: int) -> DataFrame:
    """Adds split: the first quota rows of each stratum by salted hash are dev, the next as many confirm."""
    quota = largest_remainder(df.groupBy(by).agg(F.count("*").alias("n")), by, total).select(by, "quota")
    x = positions(df, [by], [salted(salt, *key)], "_r").join(quota, by)
    return x.withColumn("split", F.when(F.col("_r") < F.col("quota"), "dev").when(F.col("_r") < 2 * F.col("quota"), "confirm").otherwise("train")).drop("_r", "quota")


def global_rank(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Adds the 1-based position in the total order of `keys`."""
    return positions(df, [], keys, name).withColumn(name, F.col(name) + 1)


def percentiles(df: DataFrame, by: Sequence[str], value: str, **picks: tuple[str, float]) -> DataFrame:
    """Per key, values at positions of the sorted column without nulls, found over counts of distinct values.

    picks: name=(rule, p). Rules, for n values: index, round(p * (n - 1)) half to even; rank, ceil(p * n) from 1;
    upper, floor(p * n) from 0; linear, between the neighbours of p * (n - 1)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    x = positions(counts, by, [F.col(value)], "_lo", "_c", "_total")

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_lo")) & (place < F.col("_lo") + F.col("_c")), F.col(value)))

    def pick(rule: str, p: float) -> Column:
        n = F.col("_total")
        if rule == "linear":
            h = F.lit(p) * (n - 1)
            low, high, share = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
            return low + (high - low) * share
        return at({"index": F.bround(F.lit(p) * (n - 1)), "rank": F.greatest(F.ceil(F.lit(p) * n), F.lit(1)) - 1, "upper": F.floor(F.lit(p) * n)}[rule])

    found = [pick(*spec).alias(c) for c, spec in picks.items()]
    return x.groupBy(*by).agg(*found) if by else x.agg(*found)


def greedy_distinct(df: DataFrame, salt: str, most: int) -> DataFrame:
    """Columns stratum, key, id. Strata in name order take rows by salted hash of the id, skip keys that are taken,
    and stop at `most`; no back-fill.

    Only a bounded part can matter: of each stratum and key the first row, and of each stratum as many as all
    strata together may take. That part, at most strata^2 * most rows, is walked in one small task."""
    h = salted(salt, "id")
    x = df.groupBy("stratum", "key").agg(F.min(F.struct(h.alias("h"), "id")).alias("m")).select("stratum", "key", "m.h", "m.id")
    n = x.select("stratum").distinct().agg((F.count("*") * most).alias("n"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("h"))).join(F.broadcast(n)).where("r <= n")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for stratum, rows in frame.sort_values(["stratum", "h"]).groupby("stratum", sort=True):
            left = most
            for key, row in zip(rows["key"], rows["id"], strict=True):
                if left and key not in taken:
                    taken.add(key)
                    out.append((stratum, key, row))
                    left -= 1
        return pd.DataFrame(out, columns=["stratum", "key", "id"])

    return x.groupBy(F.lit("all")).applyInPandas(walk, "stratum string, key long, id long")
