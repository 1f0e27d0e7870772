"""Scores over groups: joint box F, bootstrap intervals, ranks, salted hashes for reproducible draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou_ratio
from .joins import first_match
from .ordered import positions


def hash_index(n: Column | int, *parts: Column | str) -> Column:
    """A number in [0, n) from the MD5 of the parts: the same in any engine."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") % n


def salted(salt: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *parts), 256)


def joint_f(pred: DataFrame, truth: DataFrame, index: DataFrame, video: str, frame: str, order: Sequence[str], ratio: tuple[int, int]) -> DataFrame:
    """Per video of the index: n_pred, n_truth, score = 2 * sum of IoU / (n_pred + n_truth); both empty: 1.

    A repeated frame's first prediction by `order` is matched; the others still count in n_pred."""
    key = [video, frame]
    first = first_match(pred.select(*key, *order, "x", "y", "w"), key, order)
    gold = truth.select(*key, F.struct("x", "y", "w").alias("g"))
    box = F.struct("x", "y", "w")
    hit = first.join(gold, key).select(video, iou_ratio(box, F.col("g"), *ratio).alias("iou")).groupBy(video).agg(F.sum("iou").alias("iou"))
    out = index.join(pred.groupBy(video).agg(F.count("*").alias("n_pred")), video, "left").join(truth.groupBy(video).agg(F.count("*").alias("n_truth")), video, "left").join(hit, video, "left")
    out = out.fillna(0, ["n_pred", "n_truth"]).fillna(0.0, ["iou"])
    n = F.col("n_pred") + F.col("n_truth")
    return out.withColumn("score", F.when(n == 0, 1.0).otherwise(F.try_divide(2 * F.col("iou"), n)))


def bootstrap(groups: DataFrame, draws: int, columns: Sequence[str], seed: str) -> DataFrame:
    """Sums of `columns` for each draw of as many groups as there are, with replacement.

    groups: (i long dense from 0, columns...). Slot j of draw d takes group hash(seed, d, j) % n; slots meet groups
    in a join on the index, so nothing is gathered."""
    n = groups.agg(F.count("*").alias("n"))
    slots = groups.sparkSession.range(draws).select(F.col("id").alias("draw")).join(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    slots = slots.select("draw", hash_index(F.col("n"), F.lit(seed), "draw", "j").alias("i"))
    return slots.join(groups, "i").groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("n"))


def tied_ranks(counts: DataFrame, by: Sequence[str], value: str, count: str, name: str) -> DataFrame:
    """(by, value, name, total): the rank from 1 of each distinct value, ties averaged, from counts of values."""
    x = positions(counts, by, [F.col(value)], "_lo", count, "total")
    return x.select(*by, value, (F.col("_lo") + (F.col(count) + 1) / F.lit(2.0)).alias(name), "total")


def rank_correlation(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """(by, rho): Spearman's correlation with ties averaged; null where a side is constant. Rows with a
    null key or value are left out.

    Ranks belong to distinct values, and rows only count for their (a, b): three small grouped counts."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("_c"))

    def ranks(value: str, name: str) -> DataFrame:
        counts = both.groupBy(*by, value).agg(F.sum("_c").alias("_n"))
        x = tied_ranks(counts, by, value, "_n", name)
        return x.select(*by, value, (F.col(name) - (F.col("total") + 1) / F.lit(2.0)).alias(name))  # from the middle

    x = both.join(ranks(a, "_ra"), [*by, a]).join(ranks(b, "_rb"), [*by, b])
    total = lambda p, q: F.sum(F.col("_c") * F.col(p) * F.col(q))
    rho = F.try_divide(total("_ra", "_rb"), F.sqrt(total("_ra", "_ra")) * F.sqrt(total("_rb", "_rb")))
    return x.groupBy(*by).agg(rho.alias("rho"))
