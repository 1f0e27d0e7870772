"""State of streams over several batches and restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomspan import plans
from loomspan.sources.shared import shared_path
from loomspan.streaming import jobs
from loomspan.streaming.journal import Conflict, Journal
from loomspan.streaming.ledger import STORE, admit, close_leases

ROW = "ledger string, id long, job string, reserve long, charge long, at long"


def parts(spark, *rows, shape=ROW):
    return [spark.createDataFrame(r, shape) for r in rows]


def test_admission_keeps_its_ledger_over_restarts(spark):
    first = [("x", 1, "a", 10, 5, 1), ("x", 2, "a", 1, 1, 2), ("y", 3, "a", 95, 1, 3), (None, 4, "n", 1, 1, 4)]
    second = [("x", 6, "c", 96, 1, 20), ("x", 5, "b", 60, 60, 10), ("x", 7, "c", 30, 30, 30), ("x", 8, "a", 0, 0, 40), (None, 9, "n", 1, 1, 50)]
    got = jobs.run_parts(parts(spark, first, second), lambda s: admit(s, opening=0, teardown=5, limit=100), ["id"], "admit", "append", STORE)
    assert {r.id: (r.state, r.prior, r.charged) for r in got.collect()} == {
        1: ("ACCEPTED", 0, 5), 2: ("DUPLICATE_JOB", 5, 0), 3: ("ACCEPTED", 0, 1), 4: ("ACCEPTED", 0, 1),
        5: ("ACCEPTED", 5, 60), 6: ("OVER_BUDGET", 65, 0), 7: ("ACCEPTED", 65, 30), 8: ("DUPLICATE_JOB", 95, 0), 9: ("DUPLICATE_JOB", 1, 0),
    }


def test_names_of_closed_jobs_are_free_after_their_time(spark):
    """A name is held until the watermark has passed it; its charge stays."""
    second = 1_000_000
    rows = [[("x", 1, "a", 1, 7, 1 * second)], [("x", 2, "a", 1, 7, 2 * second)], [("y", 3, "b", 1, 1, 100 * second)], [("x", 4, "a", 1, 7, 101 * second)], [("x", 5, "a", 1, 7, 102 * second)]]

    def build(s):
        return admit(s.withColumn("when", F.timestamp_micros("at")).withWatermark("when", "0 seconds"), opening=0, teardown=0, limit=1000, keep_ms=10_000)

    got = jobs.run_parts(parts(spark, *rows), build, ["id"], "expire", "append", STORE)
    assert {r.id: (r.state, r.prior) for r in got.collect()} == {1: ("ACCEPTED", 0), 2: ("DUPLICATE_JOB", 7), 3: ("ACCEPTED", 0), 4: ("ACCEPTED", 7), 5: ("DUPLICATE_JOB", 14)}


def test_leases_close_with_their_last_consumer(spark):
    shape = "lease long, consumers array<string>, consumer string"
    rows = [[(1, None, "b"), (2, ["z"], None), (3, [], None)], [(1, ["a", "b"], None), (1, None, "q")], [(1, None, "a"), (1, None, "a"), (2, ["y"], None)]]
    got = jobs.run_parts(parts(spark, *rows, shape=shape), close_leases, ["lease"], "leases", "update", STORE)
    assert {r.lease: (r.registered, r.accepted, r.released, r.repeated, r.strange, r.again) for r in got.collect()} == {1: (2, 2, True, 1, 1, 0), 2: (1, 0, False, 0, 0, 1), 3: (0, 0, False, 0, 0, 0)}


def loop_over(batches):
    """The newest state of each lease, row by row."""
    named, said, out = {}, {}, {}
    for batch in batches:
        again = dict.fromkeys((r[0] for r in batch), 0)
        for lease in again:
            lists = sorted(c for k, c, _ in batch if k == lease and c is not None)
            full = [c for c in lists if c]
            again[lease] = len(lists) if lease in named else max(0, len(full) - 1)
            if full:
                named.setdefault(lease, set(full[0]))
        for lease, c, consumer in batch:
            if c is None:
                said.setdefault(lease, []).append(consumer)
        for lease, n in again.items():
            names, heard = named.get(lease, set()), said.get(lease, [])
            got = set(heard)
            out[lease] = (len(names), len(names & got), bool(names) and names <= got, len(heard) - len(got), len(got - names), n)
    return out


def test_leases_are_followed_without_a_call_for_each(spark):
    """Hand-made batches, and drawn ones with null keys and consumers, doubled names and a hot lease: as a loop says, and
    with thousands of leases in the time of a few."""
    shape = "lease long, consumers array<string>, consumer string"
    rows = [[(1, None, "b"), (2, ["z"], None), (3, [], None)], [(1, ["a", "b"], None), (1, None, "q")], [(1, None, "a"), (1, None, "a"), (2, ["y"], None)]]
    got = jobs.follow_leases(parts(spark, *rows, shape=shape))
    assert {r.lease: (r.registered, r.accepted, r.released, r.repeated, r.strange, r.again) for r in got.collect()} == {1: (2, 2, True, 1, 1, 0), 2: (1, 0, False, 0, 0, 1), 3: (0, 0, False, 0, 0, 0)}
    rng = random.Random(3)
    batches = []
    for _ in range(4):
        drawn = [(rng.choice([None, 0, 0, 0, *range(40)]), rng.choice([None, None, [], [rng.choice("abcd") for _ in range(3)]]), rng.choice(["a", "b", "c", "d", "e", None])) for _ in range(150)]
        batches.append([(k, c, None if c is not None else v) for k, c, v in drawn])
    got = jobs.follow_leases(parts(spark, *batches, shape=shape))
    assert {r.lease: (r.registered, r.accepted, r.released, r.repeated, r.strange, r.again) for r in got.collect()} == loop_over(batches)


def test_many_leases_take_little_time(spark, tmp_path):
    """30,000 leases: about two minutes where each is a call to the state store."""
    lines = spark.range(90_000).select((F.col("id") % 30_000).alias("l_orderkey"), (F.col("id") / 30_000 + 1).cast("int").alias("l_linenumber"), F.when(F.col("id") % 7 == 0, "N").otherwise("R").alias("l_returnflag"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    began = time.monotonic()
    got = plans.QUERIES["stream_leases"](spark, str(tmp_path)).agg(F.count("*"), F.sum("registered"), F.sum("accepted"), F.count_if("released"), F.sum("repeated")).first()
    want = lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n")).agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 3)).first()
    assert tuple(got) == (want[0], 90_000, want[1], want[2], 0)
    assert time.monotonic() - began < 60


def test_late_points_of_a_hot_key(spark):
    """One key with most rows, nulls and ties, over three batches: as a loop over the rows says."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", None]), rng.choice([None, *range(3 * i, 3 * i + 40)])) for i in range(600)]
    high, want = {}, {}
    for i, k, v in rows:
        want[i] = v is not None and (high.get(k) is None or v > high[k])
        if v is not None:
            high[k] = max(v, high.get(k, v))
    df = spark.createDataFrame(rows, "i long, k string, v long").orderBy(F.rand(1))
    got = jobs.reject_late(jobs.in_parts(df, "i", 3), "k", "v", "i", 16)
    assert {r.i: r.accepted for r in got.collect()} == want and got.columns == ["i", "k", "v", "accepted"]


def test_parts_hold_every_row_once(spark):
    df = spark.range(10).select(F.when(F.col("id") > 1, F.col("id")).alias("v"))
    assert [sorted((r.v or 0) for r in p.collect()) for p in jobs.in_parts(df, "v", 3)] == [[0, 0, 2, 3, 4], [5, 6, 7], [8, 9]]
    assert sum(p.count() for p in jobs.in_parts(df.limit(0), "v", 3)) == 0


def test_a_journal_takes_each_batch_once(spark):
    journal = Journal(spark, shared_path(spark, "journal"))
    one = spark.createDataFrame([(1, "a", {"k": 1}), (1, "a", {"k": 1}), (2, None, None)], "i int, s string, m map<string,int>")
    assert journal.append(one, 0) and not journal.append(one.orderBy(F.desc("i")), 0) and journal.append(one, 1)
    assert Journal(spark, journal.path).append(one.limit(0), 2)
    for other in (one.limit(2), one.union(one), one.withColumn("i", F.lit(9)), one.withColumnRenamed("i", "j"), one.limit(0)):
        with pytest.raises(Conflict):
            journal.append(other, 0)
    assert journal.read(one.schema).count() == 6
