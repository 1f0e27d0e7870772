"""One-to-one matching of overlapping intervals, where no join expresses the assignment."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge
from .joins import overlapping, points_in_intervals

Pair = tuple[int, int]


def assign(shares: dict[Pair, Fraction]) -> list[Pair]:
    """The one-to-one choice among candidate (prediction, truth) pairs with the most pairs, then the largest sum of
    shares, then the smallest pairs in order.

    Every pair weighs (1, share, a power of two that falls along the pairs' order), compared in that order and
    exactly, so the best choice is unique. It grows by augmenting paths: each round relaxes the gain of reaching
    each truth over alternating paths until nothing improves, and takes the path that gains the most."""
    gain_of = {p: (1, shares[p], 1 << (len(shares) - 1 - r)) for r, p in enumerate(sorted(shares))}
    truths: dict[int, list[int]] = {}
    for i, j in sorted(shares):
        truths.setdefault(i, []).append(j)
    chosen: dict[int, int] = {}  # truth -> prediction
    while True:
        taken = set(chosen.values())
        start = {i: (0, Fraction(0), 0) for i in truths if i not in taken}
        reached: dict[int, tuple] = {}  # truth -> gain of the best path to it
        via: dict[int, int] = {}
        front = dict(start)
        while front:
            ahead: dict[int, tuple] = {}
            for i, gain in front.items():
                for j in truths[i]:
                    if chosen.get(j) == i:
                        continue
                    total = tuple(a + b for a, b in zip(gain, gain_of[i, j], strict=True))
                    if j not in reached or total > reached[j]:
                        reached[j], via[j] = total, i
                        if j in chosen:
                            back = chosen[j]
                            ahead[back] = tuple(a - b for a, b in zip(total, gain_of[back, j], strict=True))
            front = ahead
        ends = [j for j in reached if j not in chosen]
        if not ends:
            return sorted((i, j) for j, i in chosen.items())
        j = max(ends, key=reached.__getitem__)
        held = {i: j for j, i in chosen.items()}
        while j is not None:
            i = via[j]
            chosen[j], j = i, held.get(i)


def match_one_to_one(pred: DataFrame, truth: DataFrame, by: Sequence[str], width: int, least: tuple[int, int] = (1, 2)) -> DataFrame:
    """(keys, pred_id, truth_id, iou). Both inputs: keys, id, s, e. Intervals of a group are ordered by (s, e, id).

    Pairs whose IoU reaches `least` (numerator, denominator) come from a bucketed join. A pair's two intervals cover
    one stretch, and pairs that share an interval overlap, so the union of the stretches cuts a group into islands
    that match on their own: a group with a third of all rows is one task no more."""
    p, q = least
    schema = ", ".join(f"{k} long" for k in by) + ", pred_id long, truth_id long, iou double"
    other = pred.select(*by, F.col("id").alias("pred_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = overlapping(truth.select(*by, F.col("id").alias("truth_id"), "s", "e"), other, by, width)
    common, both = F.least("e", "e2") - F.greatest("s", "s2"), F.greatest("e", "e2") - F.least("s", "s2")
    pairs = pairs.withColumns({"common": common, "both": both, "lo": F.least("s", "s2"), "hi": F.greatest("e", "e2")}).where(q * F.col("common") >= p * F.col("both"))
    islands = merge(pairs.select(*by, F.col("lo").alias("s"), F.col("hi").alias("e")), by, strict=True, width=width)
    dealt = points_in_intervals(pairs, islands.select(*by, F.col("s").alias("from"), F.col("e").alias("to")), by, "lo", width, ("from", "to"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        place: dict[str, dict[int, int]] = {}
        for name, order in (("pred_id", ["s2", "e2", "pred_id"]), ("truth_id", ["s", "e", "truth_id"])):
            ids = frame.drop_duplicates(name).sort_values(order)[name].tolist()
            place[name] = {x: r for r, x in enumerate(ids)}
        rows = list(zip(frame["pred_id"].tolist(), frame["truth_id"].tolist(), frame["common"].tolist(), frame["both"].tolist(), strict=True))
        found = {(place["pred_id"][a], place["truth_id"][b]): (a, b, c, d) for a, b, c, d in rows}
        chosen = [found[x] for x in assign({x: Fraction(c, d) for x, (_, _, c, d) in found.items()})]
        return pd.DataFrame([(*key[: len(by)], a, b, round(c / d, 9)) for a, b, c, d in chosen], columns=[*by, "pred_id", "truth_id", "iou"])

    return dealt.groupBy(*by, "from").applyInPandas(run, schema)
