"""Near-equal codes of any width against brute force, and how the rows that meet grow."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import leakage as lk


def vectors(spark, codes, dims):
    return spark.createDataFrame([(i, [1.0 if c >> b & 1 else -1.0 for b in range(dims)]) for i, c in codes.items()], "id long, v array<double>")


@pytest.mark.parametrize(("dims", "most", "cell"), [(64, 6, 512), (128, 5, 4), (200, 9, 1), (64, 3, 2), (20, 6, 3), (64, 0, 1)])
def test_near_codes_of_any_width(spark, dims, most, cell):
    """Families of codes a few bits apart, and a crowd that shares half of its bits, so that cells are cut again."""
    rng = random.Random(dims + most)
    base = [rng.getrandbits(dims) for _ in range(6)]
    codes = {i: base[i % 6] ^ sum(1 << b for b in rng.sample(range(dims), rng.randrange(most + 4))) for i in range(120)}
    half = rng.getrandbits(dims // 2)
    codes |= {i: half | rng.getrandbits(dims - dims // 2) << dims // 2 for i in range(120, 220)}
    first = {}
    for i, c in codes.items():
        first.setdefault(c, i)
    want = {(i, j, (a ^ b).bit_count()) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= most}
    got = lk.near_codes(vectors(spark, codes, dims), "id", "v", most, None, cell).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_bands_widen_with_the_codes():
    widths = [min(n for _, n in lk.Bands.fit(0, 64, 6, n).parts) for n in (100, 10_000, 10**6, 10**9)]
    assert widths == sorted(widths) and widths[0] < widths[-1] and len(set(widths)) > 2
    assert all(n <= lk.WIDEST for _, n in lk.Bands.fit(0, 1000, 2, 10).parts)
    for most in range(9):
        b = lk.Bands.fit(5, 90, most, 1000)
        assert sum(n for _, n in b.parts) == 90 and len(b.parts) * (b.radius + 1) > most


def test_rows_that_meet_grow_with_the_codes(spark):
    """Random codes, 1, 4 and 16 times as many: what meets stays a small share of all pairs, and grows far less than they."""
    met = []
    for n in (2000, 8000, 32_000):
        reps = spark.range(n).select("id", F.xxhash64("id").alias("w0"))
        met.append(lk.meeting(reps, ["w0"], 64, 6).count())
    assert met[2] < 16 * 8 * max(met[0], 2000) and met[2] < 32_000**2 / 2 / 500


def test_nulls_and_wrong_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0] * 64), (3, [0.0] * 63 + [1.0]), (4, [None] * 64)], "id long, v array<double>")
    assert {tuple(r) for r in lk.near_codes(df, "id", "v", 1).collect()} == {(1, 3, 1)}
    assert lk.near_codes(df.limit(0), "id", "v", 1).count() == 0
    with pytest.raises(Exception, match="must have 64"):
        lk.near_codes(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), "id", "v", 1).collect()
