"""Every registered query against its SQL, and hand-made cases of the interval, join and box operators."""

import hashlib
import itertools
import random
from fractions import Fraction

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan import plans
from loomspan.functions import geometry as geo
from loomspan.operators import intervals as iv
from loomspan.operators import joins as jn
from loomspan.operators.leakage import near_codes
from loomspan.operators.matching import assign, match_one_to_one
from loomspan.operators.ordered import positions
from loomspan.operators.sampling import global_rank, percentiles
from loomspan.plans.registry import Tables
from loomspan.sources import archive
from loomspan.sources.manifest import content_rows, stem_index

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(v, 8) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, sf, db, name):
    df = plans.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = db.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def rows(spark, spans, key=1):
    return spark.createDataFrame([(key, s, e) for s, e in spans], "u long, s long, e long")


def spans(df):
    return sorted((r.s, r.e) for r in df.collect())


def test_merge_and_bridge(spark):
    assert spans(iv.merge(rows(spark, [(0, 3), (2, 4), (4, 5)]), ["u"])) == [(0, 5)]
    assert spans(iv.merge(rows(spark, [(0, 3), (2, 4), (4, 5)]), ["u"], strict=True)) == [(0, 4), (4, 5)]
    assert spans(iv.merge(rows(spark, [(0, 8), (12, 16), (21, 24)]), ["u"], gap=4)) == [(0, 16), (21, 24)]


def test_intersection_is_not_the_envelope(spark):
    both = rows(spark, [(0, 2), (8, 10)]).selectExpr("*", "'p' k").union(rows(spark, [(0, 10)]).selectExpr("*", "'t' k"))
    r = iv.prf(iv.durations(both, ["u"], "k", "p", "t"), "a").first()
    assert r.f1 == pytest.approx(4 / 7) and r.precision == 1.0
    assert spans(iv.intersect(both, ["u"], "k", "p", "t")) == [(0, 2), (8, 10)]


def test_nearest_tie_takes_the_earlier(spark):
    df = spark.createDataFrame([(1, i, i in (8, 12)) for i in range(6, 15)], "u long, i long, m boolean")
    got = {r.i: (r.source, r.distance) for r in jn.nearest(jn.neighbours(df, ["u"], "i", df["m"]), "i").collect()}
    assert got[10] == (8, 2) and got[11] == (12, 1) and got[6] == (8, 2) and got[14] == (12, 2)


def test_iou_third(spark):
    df = spark.sql("select named_struct('x', 0, 'y', 0, 'w', 96) a, named_struct('x', 0, 'y', 27, 'w', 96) b")
    assert df.select(geo.iou_ratio(df["a"], df["b"], 16, 9)).first()[0] == pytest.approx(1 / 3)


def shares(pred, truth, least):
    found = {(i, j): Fraction(min(b, d) - max(a, c), max(b, d) - min(a, c)) for i, (a, b) in enumerate(pred) for j, (c, d) in enumerate(truth)}
    return {p: v for p, v in found.items() if v >= least}


def test_reassignment():
    assert assign(shares([(0, 3), (0, 2)], [(0, 2), (1, 3)], Fraction(1, 2))) == [(0, 1), (1, 0)]
    assert assign({}) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=14), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=14))
def test_overlaps_in_buckets_match_a_plain_join(spark, a, b):
    left, right = rows(spark, [(s, s + n) for s, n in a]), rows(spark, [(s, s + n) for s, n in b]).toDF("u", "s2", "e2")
    got = sorted((r.s, r.e, r.s2, r.e2) for r in jn.overlapping(left, right, ["u"], 4).collect())
    assert got == sorted((s, s + n, q, q + m) for s, n in a for q, m in b if n and m and s < q + m and q < s + n)


def test_greedy_distinct_walks_strata_in_order(spark, sf):
    rows = [(r.event_type, r.user_id, r.event_id) for r in Tables(spark, sf).events.select("event_type", "user_id", "event_id").collect()]
    taken, want = set(), set()
    for kind in sorted({r[0] for r in rows}):
        left = 2
        for _, user, event in sorted((r for r in rows if r[0] == kind), key=lambda r: (hashlib.sha256(f"s5:{r[2]}".encode()).hexdigest(), r[2])):
            if left and user not in taken:
                taken.add(user)
                want.add((kind, user, event))
                left -= 1
    assert {(r.stratum, r.key, r.id) for r in plans.QUERIES["greedy_distinct"](spark, sf).collect()} == want


def test_event_match_is_the_best_assignment(spark, sf):
    groups = {}
    for r in Tables(spark, sf).sides().collect():
        groups.setdefault((r.u, r.s // 86_400_000_000), {}).setdefault(r.k, []).append((r.s, r.e, r.id))
    want = set()
    for (u, day), sides in groups.items():
        pred, truth = sorted(sides.get("click", [])), sorted(sides.get("purchase", []))
        for i, j in exact_pairs([p[:2] for p in pred], [p[:2] for p in truth], Fraction(1, 2)):
            want.add((u, day, pred[i][2], truth[j][2]))
    got = plans.QUERIES["event_match_1to1"](spark, sf).collect()
    assert {(r.u, r.day, r.pred_id, r.truth_id) for r in got} == want and all(0.5 <= r.iou <= 1 for r in got)


def test_one_group_splits_into_islands(spark):
    """3,000 pairs under one key: islands match on their own."""
    rows = [(1, i, 10 * i, 10 * i + 8) for i in range(3000)]
    pred = spark.createDataFrame(rows, "u long, id long, s long, e long")
    truth = spark.createDataFrame([(u, i, s + 1, e) for u, i, s, e in rows], "u long, id long, s long, e long")
    got = match_one_to_one(pred, truth, ["u"], 500).collect()
    assert len(got) == 3000 and all(r.pred_id == r.truth_id and r.iou == 0.875 for r in got)


def test_positions_of_a_hot_key(spark):
    """Every row keeps one place whatever adaptive execution does to the partitions."""
    df = spark.range(500_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"), "id")
    x = positions(df, ["k"], [F.col("v"), F.col("id")], "at", total="n")
    got = x.groupBy("k").agg(F.count("*").alias("c"), F.min("at").alias("a"), F.max("at").alias("b"), F.count_distinct("at").alias("d"), F.max("n").alias("n")).collect()
    assert sum(r.c for r in got) == 500_000 and all(r.a == 0 and r.b == r.c - 1 and r.d == r.c == r.n for r in got)
    ranked = global_rank(df, [F.col("v"), F.col("id")], "r")
    out = [r.id for r in ranked.orderBy("r").select("id").limit(1000).collect()]
    assert out == [r.id for r in df.orderBy("v", "id").select("id").limit(1000).collect()]
    assert ranked.agg(F.count_distinct("r")).first()[0] == 500_000


def test_percentile_rules(spark):
    df = spark.createDataFrame([(None, 5.0)] + [("a", v) for v in (4.0, 1.0, 1.0, 3.0)] + [("b", None)], "k string, v double")
    rules = {"i": ("index", 0.5), "n": ("rank", 0.5), "u": ("upper", 0.5), "l": ("linear", 0.5)}
    got = {r.k: (r.i, r.n, r.u, r.l) for r in percentiles(df, ["k"], "v", **rules).collect()}
    assert got == {None: (5.0,) * 4, "a": (3.0, 1.0, 3.0, 2.0)}


def test_partition_check_of_tiling_sets(spark):
    df = spark.createDataFrame([(1, "a", 0, 4), (1, "b", 4, 6), (1, "c", 6, 9), (2, "a", 0, 4), (2, "b", 3, 6), (2, "x", 0, 8)], "u long, k string, s long, e long")
    got = {r.u: r for r in iv.partition_check(df, ["u"], "k", {"a": "keep", "b": "no", "c": "unknown"}).collect()}
    assert got[1].tiles and (got[1].keep, got[1].no, got[1].unknown) == (4, 2, 3)
    assert not got[2].tiles and (got[2].overlap, got[2].hole) == (1, 2)


def test_pchip_is_exact(spark):
    rng = random.Random(5)
    cases = [(*(rng.randrange(-900, 900) for _ in range(4)), rng.randrange(1, 9), rng.randrange(1, 9), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(cases, "a long, b long, c long, d long, h0 long, h2 long, k long")
    got = [r[0] for r in df.select(geo.pchip([F.col(x) for x in "abcd"], F.col("h0"), F.col("h2"), F.col("k"))).collect()]

    def tangent(before, after, p, q):
        return Fraction(0) if p * q <= 0 else Fraction(3 * (before + after)) / (Fraction(2 * after + before) / p + Fraction(after + 2 * before) / q)

    for (a, b, c, d, h0, h2, k), y in zip(cases, got, strict=True):
        p, q, r = Fraction(b - a, h0), Fraction(c - b, 8), Fraction(d - c, h2)
        x = Fraction(k, 8)
        want = (1 + 2 * x) * (1 - x) ** 2 * b + x * (1 - x) ** 2 * 8 * tangent(h0, 8, p, q) + x * x * (3 - 2 * x) * c + x * x * (x - 1) * 8 * tangent(8, h2, q, r)
        assert y == round(want)


def test_near_codes_match_brute_force(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    codes = {i: base[i % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for i in range(150)}
    df = spark.createDataFrame([(i, [1.0 if c >> b & 1 else -1.0 for b in range(64)]) for i, c in codes.items()], "id long, v array<double>")
    first = {}
    for i, c in codes.items():
        first.setdefault(c, i)
    want = {(i, j, (a ^ b).bit_count()) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= 6}
    assert {tuple(r) for r in near_codes(df, "id", "v", 6).collect()} == want
    with pytest.raises(Exception, match="must have 64"):
        near_codes(spark.createDataFrame([(1, [1.0] * 65)], "id long, v array<double>"), "id", "v", 6).collect()


def test_packages_are_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(m, f"{m} line {i}") for i in range(20) for m in ("a", "b", "c")], "m string, x string")
    for folder in ("one", "two"):
        archive.write_packages(df.orderBy(F.rand()), str(tmp_path / folder), "m", "x", 2)
    names = sorted(p.name for p in (tmp_path / "one").iterdir())
    assert all((tmp_path / "one" / n).read_bytes() == (tmp_path / "two" / n).read_bytes() for n in names)
    assert sorted((r.member, r.content.count(b"\n")) for r in archive.members(spark, str(tmp_path / "one")).collect()) == [("a.jsonl", 20), ("b.jsonl", 20), ("c.jsonl", 20)]


def test_stems_end_at_the_last_dot(spark, tmp_path):
    for name in ("a.b.mp4", "plain", ".hidden", "x.JSON"):
        (tmp_path / name).write_text("abc")
    got = stem_index(spark, str(tmp_path)).collect()
    assert {(r.stem, r.suffix) for r in got} == {("a.b", "mp4"), ("plain", ""), ("x", "json")}  # Spark lists no hidden files


def test_content_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    assert [(r.size, r.sha[:8]) for r in content_rows(spark, str(tmp_path)).collect()] == [(3, "ba7816bf")]


def exact_pairs(pred, truth, least):
    """Every matching, the best by (most pairs, most summed IoU, smallest pairs), in fractions."""
    share = {(i, j): Fraction(min(b, d) - max(a, c), max(b, d) - min(a, c)) for i, (a, b) in enumerate(pred) for j, (c, d) in enumerate(truth)}
    found = [()]
    for i in range(len(pred)):
        found += [(*m, (i, j)) for m in found for j in range(len(truth)) if share[i, j] >= least and all(j != x[1] for x in m)]
    return list(min(found, key=lambda m: (-len(m), -sum(share[p] for p in m), m)))


def test_assignment_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(400):
        pred, truth = ([(a := rng.randrange(6), a + rng.randrange(1, 8)) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        assert assign(shares(pred, truth, Fraction(1, 4))) == exact_pairs(pred, truth, Fraction(1, 4))


def test_equal_values_leave_the_first_event_as_worst(spark, tmp_path):
    """Ties, nulls on either side, NaN and zeros of both signs: as the SQL says on one thread, over rows by id."""
    nan = float("nan")
    rows = [(i, i % 7, (7.5, 7.5, 3.0)[i // 7 % 3]) for i in range(210)] + [(210, 7, None), (211, 7, 1.0), (212, 7, 1.0), (213, 8, -0.0), (214, 8, 0.0), (215, 9, None), (216, 10, nan), (217, 10, nan), (218, 10, 9.0), (219, None, 2.0), (220, None, 2.0), (None, 11, 5.0), (222, 11, 4.0), (223, 11, 4.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect(config={"threads": 1})
    db.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(map(repr, db.execute(plans.ORACLES["policy_delete"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in plans.QUERIES["policy_delete"](spark, str(tmp_path)).collect()) == want
    spread = events.repartition(16, "value", "event_id").write.mode("overwrite")
    spread.parquet(str(tmp_path / "spread" / "events.parquet"))
    assert sorted(repr(tuple(r)) for r in plans.QUERIES["policy_delete"](spark, str(tmp_path / "spread")).collect()) == want


def test_slots_of_a_bootstrap_are_not_broadcast(spark, sf):
    """Exploded slots look few to the planner; no broadcast may hold them where the rows are too many for one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        df = plans.QUERIES["bootstrap_within"](spark, sf)
        df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and "Generate explode" in plan
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.splitlines()]
    for i, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x, d=depth: x[0] > d, lines[i + 1 :])
            assert not any("Generate" in x for _, x in below)
