"""Leakage audits: keys in several splits, near-equal binary codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, pairwise
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch


def split_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, n) of groups whose rows lie in more than one split."""
    x = df.groupBy(group).agg(F.count("*").alias("n"), F.min(split).alias("_a"), F.max(split).alias("_b"))
    return x.where("_a != _b").select(group, "n")


WIDEST = 62  # bits of a band, whose value is a long
CELL = 512  # codes of a cell beyond which it is cut again


@dataclass(frozen=True)
class Bands:
    """Stretches of bits (first, bits). Codes that differ in so many bits as were asked for differ in at most `radius`
    of them in one of the bands."""

    parts: tuple[tuple[int, int], ...]
    radius: int

    @classmethod
    def fit(cls, first: int, bits: int, most: int, codes: int) -> Bands:
        """The bands in which so many random codes send and meet the fewest rows: wide ones for many codes, so that few
        share a value, and narrow ones, which need no probes around a value, for few."""
        least = -(-bits // WIDEST)
        cost = lambda m: m * sum(comb(-(-bits // m), i) for i in range(most // m + 1)) * (1 + codes / 2.0 ** (bits // m))
        m = min(range(least, max(least, min(bits, most + 1)) + 1), key=cost)
        cut = [first + bits * i // m for i in range(m + 1)]
        return cls(tuple((a, b - a) for a, b in pairwise(cut)), most // m)

    def values(self, words: list[Column], near: bool) -> Column:
        """An array of (band, value); near: of all values within the radius."""

        def of(i: int, part: tuple[int, int]) -> Column:
            flips = [sum(1 << b for b in pick) for r in range(self.radius + 1 if near else 1) for pick in combinations(range(part[1]), r)]
            return F.transform(F.lit(flips).cast("array<long>"), lambda f: F.struct(F.lit(i).alias("band"), bits_of(words, part).bitwiseXOR(f).alias("v")))

        return F.flatten(F.array(*[of(i, p) for i, p in enumerate(self.parts)]))

    def first(self, differ: list[Column]) -> Column:
        """The first band in which two codes, whose differing bits are given, lie within the radius."""
        return F.coalesce(*[F.when(F.bit_count(bits_of(differ, p)) <= self.radius, i) for i, p in enumerate(self.parts)])


def bits_of(words: list[Column], part: tuple[int, int]) -> Column:
    first, n = part
    word, shift = divmod(first, 64)
    value = F.shiftrightunsigned(words[word], shift)
    if shift + n > 64:
        value = value.bitwiseOR(F.shiftleft(words[word + 1], 64 - shift))
    return value.bitwiseAND(F.lit((1 << n) - 1))


def sign_words(vector: str, dims: int) -> list[Column]:
    """The signs of a vector's components as longs of 64 bits; a missing or null value is 0."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i % 64 if i % 64 < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    return [reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(w, min(w + 64, dims))]) for w in range(0, dims, 64)]


def meeting(reps: DataFrame, words: Sequence[str], dims: int, most: int, cell: int = CELL) -> DataFrame:
    """(a, b, distance) of codes that meet: all pairs at distance `most` or less, each once, and some others.
    reps: (id, words), each code once.

    Codes meet in cells, a value of a band. A cell of more than `cell` codes is cut again, by bands of the bits before
    and after its own, within which the codes must be as near."""
    scratch = Scratch(reps.sparkSession, "codes")
    reps = scratch.keep(reps, "reps")
    x, y = list(words), [f"_{w}" for w in words]
    bands = Bands.fit(0, dims, most, reps.count())
    other = reps.toDF("id2", *y)
    asks = reps.select("id", *x, F.explode(bands.values([F.col(c) for c in x], True)).alias("k")).select("id", *x, "k.*")
    owns = other.select("id2", *y, F.explode(bands.values([F.col(c) for c in y], False)).alias("k")).select("id2", *y, "k.*")
    sizes = owns.groupBy("band", "v").count().where(F.col("count") > cell)
    large = scratch.keep(sizes.select("band", "v", F.col("count").alias("size")), "large")
    differ = [F.col(a).bitwiseXOR(F.col(b)) for a, b in zip(x, y, strict=True)]
    apart = reduce(lambda a, b: a + b, map(F.bit_count, differ))
    once = (F.col("id") < F.col("id2")) & (F.col("band") == bands.first(differ))
    found = asks.join(large, ["band", "v"], "left_anti").join(owns.join(large, ["band", "v"], "left_anti"), ["band", "v"]).where(once)
    found = found.select(F.col("id").alias("a"), F.col("id2").alias("b"), apart.alias("distance"))
    largest = large.groupBy("band").agg(F.max("size").alias("size")).collect()  # a row for each band at most
    for band, size in sorted((r.band, r.size) for r in largest):
        first, bits = bands.parts[band]
        rest = [(0, first), (first + bits, dims - first - bits)]
        # The larger stretch beside the band is cut: what lies in it differs in `most` bits at most.
        at, n = max(rest, key=lambda p: p[1])
        if not n:
            continue
        inner = Bands.fit(at, n, most, size)
        part = large.where(F.col("band") == band).select("band", "v")
        keyed = lambda df, cols, near: df.join(part, ["band", "v"]).withColumn("k", F.explode(inner.values([F.col(c) for c in cols], near))).select("*", F.col("k.band").alias("band2"), F.col("k.v").alias("v2")).drop("k")  # noqa: E731, B023
        pairs = keyed(asks, x, True).join(keyed(owns, y, False), ["band", "v", "band2", "v2"]).where(once & (F.col("band2") == inner.first(differ)))
        found = found.union(pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), apart.alias("distance")))
    return found


def near_codes(df: DataFrame, key: str, vector: str, most: int, dims: int | None = 64, cell: int = CELL) -> DataFrame:
    """(a, b, distance) of different sign codes of `dims` components at Hamming distance `most` or less; a code stands
    for all its rows by its smallest key. dims: any number of components, None for those of the longest vector; a
    vector of another length is then an error. Missing or null components, and null vectors, count as 0."""
    if dims is None:
        dims = max(1, df.agg(F.max(F.size(vector))).first()[0] or 1)
    fits = F.when(F.col(vector).isNull() | (F.size(vector) == dims), F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors must have {dims} components")).cast(dict(df.dtypes)[vector]))
    rows = df.select(F.col(key).alias("id"), fits.alias("_v"))
    words = [f"w{i}" for i in range(-(-dims // 64))]
    reps = rows.select("id", *[c.alias(n) for c, n in zip(sign_words("_v", dims), words, strict=True)]).groupBy(*words).agg(F.min("id").alias("id"))
    return meeting(reps.select("id", *words), words, dims, most, cell).where(F.col("distance") <= most)


def content_leaks(a: DataFrame, b: DataFrame, content: str) -> DataFrame:
    """(sha, n_a, n_b, first_a, first_b) of byte contents on both sides, by their SHA-256; inputs: id, content."""
    side = lambda df, x: df.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("sha")).agg(F.count("*").alias(f"n_{x}"), F.min("id").alias(f"first_{x}"))
    return side(a, "a").join(side(b, "b"), "sha")
