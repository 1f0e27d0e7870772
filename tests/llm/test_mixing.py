"""The mix against a recomputation from its slots, and its odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, row string, pieces int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", 1) for i, t, s in rows], SCHEMA)


def corpus(rng):
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 70))), f"s{min(3, i % 7)}") for i in range(400)]
    rows += [(1000 + i, "a few words of a rare source", "rare") for i in range(3)] + [(None, "no id", "s1")] * 30 + [(None, None, None)] * 40
    return rows + [(5, rows[5][1], rows[5][2])] * 3 + [(6, "another text", "s0"), (6, "another text", "s1"), (2000, "", "s2"), (2001, " \t", None)]


def test_taken_words_follow_from_the_slots(spark):
    rows = corpus(random.Random(1))
    mix = mixing.Mix(table(spark, rows), block_words=8, shard_slots=64)
    slots = mix.slots.collect()
    total = int(mix.quota.sum())
    assert sorted(r.shard * 64 + r.position for r in slots) == list(range(total))
    # Each source has its quota, and its blocks come equally often.
    for k, (quota, blocks) in enumerate(zip(mix.quota.tolist(), mix.blocks.tolist(), strict=True)):
        seen = Counter(r.block for r in slots if r.k == k)
        assert sum(seen.values()) == quota and seen.keys() <= set(range(blocks))
        assert not blocks or max(seen.values(), default=0) - min((seen[b] for b in range(blocks)), default=0) <= 1
    # Shards hold what they drew, but for the slots that pass from sources drawn too often to those drawn too seldom.
    share = mix.quota / total
    drawn = [np.random.default_rng([mixing.SEED, s]).multinomial(min(64, total - 64 * s), share) for s in range(-(-total // 64))]
    held = Counter((r.shard, r.k) for r in slots)
    moved = sum(max(0, n - held[s, k]) for s, counts in enumerate(drawn) for k, n in enumerate(counts.tolist()))
    assert moved == np.maximum(0, np.sum(drawn, axis=0) - mix.quota).sum()
    # A document's words taken are those of its blocks.
    times = Counter((r.k, r.block) for r in slots)
    want = []
    for r in mix.rows.collect():
        words = range(r.start, r.start + r["size"]) if r["size"] else ()
        want.append((r.doc_id or -1, r["size"], sum(times[r.k, w // 8] for w in words)))
    got = [(r.doc_id or -1, r["size"], r.taken) for r in mix.taken().collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows)
    starts = sorted((r.k, r.start, r.start + r["size"]) for r in mix.rows.collect() if r["size"])
    assert all(a[2] == b[1] for a, b in zip(starts, starts[1:]) if a[0] == b[0])
    for k, (_, size, target) in enumerate(mix.plan):
        taken = sum(t for (_, _, t), r in zip(want, mix.rows.collect(), strict=True) if r.k == k)
        assert abs(taken - target) <= 8 + 0.02 * size


def test_documents_of_the_mix_hold_the_words_taken(spark):
    rows = corpus(random.Random(2))
    out = mixing.mixed_documents(table(spark, rows), block_words=8, shard_slots=64)
    assert out.columns == table(spark, []).columns
    found = out.collect()
    taken = Counter()
    for r in mixing.mix_sources(table(spark, rows), block_words=8, shard_slots=64).collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    for r in found:
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
        assert r.n_chars == len(r.text) and r.name == "x"
    assert +words == +taken
    again = mixing.mixed_documents(table(spark, rows).repartition(5), block_words=8, shard_slots=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


@pytest.mark.parametrize("rows", [[], [(1, None, "s")], [(1, "one", "s")], [(None, "x y z", None)]])
def test_tiny_tables(spark, rows):
    df = table(spark, [*rows, (9, "drop", "s")]).where("doc_id is null or doc_id <> 9")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r.taken == r["size"] for r in got)
    assert mixing.mixed_documents(df).count() == sum(r["size"] > 0 for r in got)


def test_the_plan_starts_no_rdd_workers(spark, monkeypatch):
    """A plan made from a list of rows would be decoded by executors' Python workers of their own kind, beside the others."""
    docs = table(spark, corpus(random.Random(2))).localCheckpoint()

    def refused(*_, **__):
        raise AssertionError("an RDD of Python rows")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    mix = mixing.Mix(docs, block_words=8, shard_slots=64)
    assert mix.rows.where("source is null").count() == 41 and mix.rows.select("target").distinct().count() > 1
