"""Held-out accuracy of the classifiers, and the shrinkage against a recomputation."""

import random
from collections import defaultdict

import numpy as np
import pytest

from loomspan.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, host string, path string, e string, q string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y", None, "z") for i, t, lang, s in rows], SCHEMA)


def words(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_held_out_accuracy(spark, sf):
    base = f"{sf}/../sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, half).join(labels.where("doc_id % 2 = 1").toDF("doc_id", "q", "t"), "doc_id").collect()
    good, bad = [r for r in got if r.q and not r.t], [r for r in got if not r.q]
    assert np.mean([(r.quality >= 0.5) == bool(r.q) for r in got]) > 0.97
    assert np.mean([r.posterior >= 0.5 for r in good]) > 0.98 and np.mean([r.posterior < 0.5 for r in bad]) > 0.9
    toxic = [r for r in got if r.t and r.q]  # toxic junk is rejected for its quality
    assert len(toxic) > 100 and np.mean([r.toxic >= 0.5 for r in toxic]) > 0.98
    assert np.mean([not r.keep for r in got if r.t]) > 0.98
    assert np.mean([r.toxic < 0.5 for r in got if not r.t]) > 0.99


def test_words_are_evidence(spark):
    """Shape says nothing here: only one word in each document tells good from bad."""
    rng = random.Random(1)
    rows = [(i, words(rng, 30) + (" solid" if i % 2 else " flimsy") + " " + words(rng, 20), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.posterior for r in quality.classify(table(spark, rows), labels).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in range(200, 400)]) > 0.98


def test_shrinkage_follows_the_moments(spark):
    rng = np.random.default_rng(3)
    groups = defaultdict(list)
    for h in range(30):
        host = rng.normal(0.5, 1.0)
        for p in range(rng.integers(1, 6)):
            path = host + rng.normal(0, 0.5)
            groups[f"h{h}" if h else None, f"p{p}"] += (path + rng.normal(0, 2, rng.integers(1, 60))).tolist()
    rows = [(h, p, len(v), float(sum(v)), float(sum(x * x for x in v))) for (h, p), v in groups.items()]
    sites, mean = quality.shrunken_sites(spark.createDataFrame(rows, "host string, path string, n long, s double, ss double"))
    n = sum(map(len, groups.values()))
    hosts = defaultdict(list)
    for (h, _), v in groups.items():
        hosts[h].append(v)
    flat = lambda v: [x for y in v for x in y]
    m = np.mean(flat(groups.values()))
    inside = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (n - len(groups))
    own = sum(len(v) * (np.mean(v) - np.mean(flat(vs))) ** 2 for vs in hosts.values() for v in vs)
    nn = sum(sum(len(v) ** 2 for v in vs) / len(flat(vs)) for vs in hosts.values())
    of_paths = (own - (len(groups) - len(hosts)) * inside) / (n - nn)
    between = sum(len(flat(vs)) * (np.mean(flat(vs)) - m) ** 2 for vs in hosts.values())
    pp = sum(len(v) ** 2 for v in groups.values())
    of_hosts = (between - (len(hosts) - 1) * inside - of_paths * (nn - pp / n)) / (n - sum(len(flat(vs)) ** 2 for vs in hosts.values()) / n)
    assert mean == pytest.approx(m) and 0.1 < of_paths < 1 and 0.4 < of_hosts < 2
    got = {(r.host, r.path): r for r in sites.collect()}
    assert len(got) == len(groups)
    for (h, p), v in groups.items():
        vs = flat(hosts[h])
        k = inside / of_hosts
        assert got[h, p].host_mean == pytest.approx((sum(vs) + k * m) / (len(vs) + k))
        assert got[h, p].strength == pytest.approx(inside / of_paths) and got[h, p].n == len(v)


def test_site_and_posterior_of_a_document(spark):
    """A bad site lowers its documents, by what the others of the site show; labels of the site count."""
    rng = random.Random(2)
    rows = [(i, words(rng, 40), "en" if i % 2 else "de", f"host{i % 5}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 != 3), 0) for i in range(250)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table(spark, rows), labels).collect()}
    assert len(got) == 300
    assert np.mean([got[i].site for i in range(250, 300) if i % 5 == 3]) < np.mean([got[i].site for i in range(250, 300) if i % 5 != 3]) - 1
    assert all(got[i].posterior < got[j].posterior for i in range(253, 300, 5) for j in (251, 252, 254))


def test_sparse_sites_shrink_to_the_mean(spark):
    rows = [(i, "good prose of several different words here " + words(random.Random(i), 40), "en", "big") for i in range(60)] + [(900, "### $$$ %%% &&& ***", "en", "tiny")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(900, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table(spark, rows), labels).collect()}
    assert not got[900].keep and got[5].keep
