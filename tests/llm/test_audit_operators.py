"""Hard negatives, source divergence and language identification against brute force and held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from loomspan.llm import divergence, entry, hard_negatives, language_id


def brute_negatives(rows, step=100, k=5, m=5, scale=256):
    own = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        x = (label, [math.floor(scale * c) for c in vector])
        own[i] = min(own.get(i, x), x)
    score = lambda a, b: sum(p * q for p, q in zip(own[a][1], own[b][1], strict=False))
    out = set()
    for a in (i for i in own if i % step == 0):
        by = sorted((-score(a, b), b) for b in own if b != a)
        for p, i in [x for x in by if own[x[1]][0] == own[a][0]][:k]:
            fits = [x for x in by if own[x[1]][0] != own[a][0] and 80 * -p <= 100 * -x[0] <= 100 * -p][:m]
            out |= {(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fits)}
    return out


SHAPE = "vec_id long, embedding array<double>, label int, v string, q int, place int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SHAPE).repartition(parts)


@pytest.mark.parametrize(("n", "dims", "gathered", "cells"), [(600, 8, 1, 1 << 17), (600, 8, 64, 24), (400, 3, 1, 12), (300, 1, 5, 1 << 17)])
def test_negatives_match_brute_force(spark, n, dims, gathered, cells):
    """A third of the rows are one vector, so that scores tie beyond what is gathered and ids are cut by digits."""
    rng = np.random.default_rng(n + dims)
    v = rng.normal(size=(n, dims)) + 1
    v[: n // 3] = v[0]
    ids = rng.choice(10 * n, n, replace=False)
    ids[::20] = ids[::20] // 100 * 100
    rows = [(int(i), x.tolist(), int(c)) for i, x, c in zip(ids, v, rng.integers(0, 3, n), strict=True)]
    want = brute_negatives(rows)
    got = {tuple(r) for r in hard_negatives.mine(vectors(spark, rows), chunk_cells=cells, gathered=gathered).collect()}
    assert got == want and len(want) > 50


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 1), (3, None, 1), (4, [1.0, None], 2), (5, [math.nan, 1.0], 2), (6, [math.inf], 2), (7, [1.0, 2.0], None), (None, [1.0], 2),
        (8, [0.9, 1.9], 2), (8, [0.9, 1.9], 2), (8, [0.1, 0.1], 3), (9, [-1.0, -2.0], 1), (100, [0.5, 1.0], 2), (-100, [1.0, 1.0], 1), (1 << 62, [1.0, 1.9], 2), (-(1 << 62), [1.0, 1.9], 2),
    ]
    got = {tuple(r) for r in hard_negatives.mine(vectors(spark, rows), gathered=1).collect()}
    assert got == brute_negatives(rows) and got
    assert hard_negatives.mine(vectors(spark, rows[1:8])).count() == 0
    assert hard_negatives.mine(vectors(spark, [], 1)).columns == [c.split()[0] for c in hard_negatives.FOUND.split(", ")]
    with pytest.raises(ValueError, match="long"):
        hard_negatives.mine(vectors(spark, [(0, [1e18], 1), (1, [1e18], 1)]))


def test_large_components_stay_exact(spark):
    """Products beyond 2^53 are summed in whole numbers, not in doubles."""
    big = float(1 << 19)
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, 1.0 - 1 / 256], 2), (3, [big, 1.0 - 2 / 256], 2)]
    got = {tuple(r) for r in hard_negatives.mine(vectors(spark, rows)).collect()}
    assert got == brute_negatives(rows) and len(got) == 2


def brute_audit(rows, least=3, top=200):
    docs = defaultdict(Counter)
    counts, groups = defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        counts[lang, source].update(found)
        docs[lang].update(found.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        own = sorted(s for g, s in groups if g == lang)
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in own}
        q = share(sum((counts[lang, s] for s in own), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)}
    return out


TEXTS = "text string, lang string, source string, term string, n int, all int, band int"


@pytest.mark.parametrize("sizes", [{}, {"block_terms": 3, "band": 2}, {"block_terms": 1, "band": 1}])
def test_divergence_matches_brute_force(spark, sizes, monkeypatch):
    rng = random.Random(3)
    words = ["The", "the", "der", "été", "ÉTÉ", "naïve", "x1y", "ab-cd", "日本", "\U0001f600", "zz", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(9), rng.randrange(9))}") for _ in range(160)]
    rows += [(None, "en", "quiet"), ("", "en", None), ("rare", "xx", "a"), ("rare", "xx", "b"), ("\x00\n..", "xx", None)] + [("the same", "en", "s0")] * 30
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TEXTS).repartition(4)
    got = divergence.audit(df, **sizes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute_audit(rows)
    assert {tuple(r) for r in divergence.audit(df, top_terms=2, min_docs=1, **sizes).collect()} == brute_audit(rows, 1, 2)
    assert divergence.audit(df.limit(0), **sizes).count() == 0


def test_pieces_and_tables_hold_whole_terms(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    texts = ["abcdefghijklmnop é b c", "A b C d E f g h", "", "été " * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s"] * 4), pa.array(texts)], names=["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for x in divergence._count(iter([batch])):
        for r in x.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert n == {None: 0, "abcdefghijklmnop": 1, "é": 1, "b": 2, "c": 2, "a": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, "été": 9}
    assert docs["été"] == 1 and docs["b"] == 2


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randrange(1, 1 << rng.randrange(1, 53))
        n = rng.randrange(1, total + 1)
        assert divergence.share(np.array([n]), np.array([total]))[0] == 1 + Fraction(n * 10**9, total).__floor__()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_source_divergence"])
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.execute(entry.ORACLES[name])
    names = [d[0] for d in want.description]
    got = entry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


DOCS = "doc_id long, text string, lang string, best double, total int"


def test_language_is_told_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(truth)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held) > 200


def test_nothing_is_learned_from_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    other = docs.withColumn("lang", language_id.F.when(language_id.held_out(docs["doc_id"]), "zz").otherwise(docs["lang"])).withColumn("source", language_id.F.lit(None))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in df.collect())
    assert key(language_id.identify(docs)) == key(language_id.identify(other))


def test_many_languages_in_blocks(spark):
    """Blocks of languages give the posterior that one block gives."""
    rng = random.Random(2)
    letters = {f"l{i}": rng.sample("abcdefghijklmnopqrstuvwxyzäöüß", 6) for i in range(7)}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=4)) for _ in range(3)), lang, 1.0, 1) for i, lang in enumerate(sorted(letters) * 20)]
    rows += [(1000, None, "l1", 0.0, 1), (1001, "", "l1", 0.0, 1), (1002, "12 .. 5", "l2", 0.0, 1), (None, "abc", "zz", 0.0, 1), (1003, "abc", None, 0.0, 1), (1, rows[1][1], "l1", 0.0, 1), (2000, "q" * 200_000 + " " + "w x " * 50_000, "l3", 0.0, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    key = lambda x: sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in x.collect())
    one, many = key(language_id.identify(df)), key(language_id.identify(df, lang_block=2))
    assert one == many and len(one) == len(rows)
    told = {r[0]: r for r in one}
    assert all(told[i][2:] == ("und", 0.0) for i in (1000, 1001, 1002)) and told[-1][1] is False
    assert "zz" not in {r[2] for r in one}
    right = sum(told[i][2] == lang for i, _, lang, *_ in rows[:140])
    assert right > 100  # of 140, with few letters each; chance is 20
    assert {r[2:] for r in key(language_id.identify(df.withColumn("lang", language_id.F.lit(None).cast("string"))))} == {("und", 0.0)}
    assert language_id.identify(df.limit(0)).count() == 0


def test_scores_do_not_depend_on_neighbours_or_slices(monkeypatch):
    rng = np.random.default_rng(4)
    table = np.vstack([rng.normal(size=(language_id.BUCKETS, 3)), np.zeros(3)])
    texts = [language_id.characters(t) for t in ("Abc déf", "x", "", "a b c d " * 50, "ß" * 300)]
    alone = np.vstack([language_id.score_texts([t], table, np.zeros(3)) for t in texts])
    assert np.allclose(language_id.score_texts(texts, table, np.zeros(3)), alone)
    monkeypatch.setattr(language_id, "SLICE", 64)
    pieces = list(language_id._pieces(texts[3]))
    assert len(pieces) > 5 and all(p[0] == 32 and p[-1] == 32 for p in pieces) and sum(map(len, pieces)) - len(pieces) + 1 == len(texts[3])
    assert np.concatenate([p[:-1] for p in language_id._pieces(texts[4])]).tolist() == texts[4][:-1].tolist()
