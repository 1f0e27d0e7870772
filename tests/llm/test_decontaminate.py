"""Recall of the semantic search against a look at every window, and the block-wise scan."""

import random

import numpy as np
import pytest

from loomspan.llm import decontaminate as dc
from loomspan.llm.common import Scratch

SCHEMA = "doc_id long, text string, h string, item_ids string, item_id long"


def words(rng, n, pool, skew):
    return [f"w{int(pool * rng.random() ** skew)}" for _ in range(n)]


def edited(rng, item, share):
    out = []
    for w in item:
        kind = rng.random()
        if kind < share / 2:
            continue
        out.append(f"new{rng.randrange(10**6)}" if kind < share else w)
    return out


def every_window(index, codes):
    """item -> best share, over all passages and all places."""
    out = {}
    for j, item in enumerate(index.items):
        step = int(index.step[j])
        for begin in range(0, max(1, len(codes)), step):
            share = index.share(j, codes[begin : begin + 6 * step].tolist())
            if share > out.get(item, 0.0):
                out[item] = share
    return out


@pytest.mark.parametrize("skew", [1.0, 2.0, 4.0])
def test_recall_against_every_window(spark, skew):
    rng = random.Random(int(skew * 10))
    items = [(i, words(rng, rng.randrange(8, 60), 2500, skew)) for i in range(150)]
    rows = []
    for i, (_, item) in enumerate(items[:100]):
        text = words(rng, rng.randrange(20, 200), 2500, skew) + edited(rng, item, (0, 0.1, 0.2, 0.3)[i % 4]) + words(rng, 60, 2500, skew)
        rows.append((i, " ".join(text), "x", "y", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    passages = [(i, w, a) for i, t in items for w, a in dc.passages_of(" ".join(t) + ".")]
    _, index = dc.build_index(docs.selectExpr("doc_id", "xxhash64(text) h", "text"), passages, 64, Scratch(spark, "t"))
    got = index.hits([index.fit.codes(dc.words_of(r[1])) for r in rows])
    want = [every_window(index, index.fit.codes(dc.words_of(r[1]))) for r in rows]
    right = sum(len(w.keys() & g.keys()) for w, g in zip(want, got, strict=True))
    assert right >= 0.9 * sum(map(len, want)), (right, sum(map(len, want)))
    assert all(g.keys() <= w.keys() for w, g in zip(want, got, strict=True))
    assert all(i in got[i] for i in range(0, 100, 4))  # whole copies, all of them


def test_blocks_find_what_one_scan_finds(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 20, 800, 1.5))) for i in range(40)] + [(7, " ".join(words(rng, 150, 800, 1.5)))]
    rows = [(i, " ".join(words(rng, 50, 800, 1.5) + items[i][1].split() + words(rng, 50, 800, 1.5)), "x", "y", 1) for i in range(41)]
    rows += [rows[0], (None, rows[1][1], None, None, None), (1, rows[2][1], "x", "y", 1), (90, None, "x", "y", 1), (91, "", "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    one = dc.find_contamination(docs, bench).collect()
    many = dc.find_contamination(docs, bench, block_passages=9).collect()
    assert len(one) == len(many) == len(rows)
    for found in (one, many):
        for r, (i, *_) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.item_ids)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
            assert i is None or i > 40 or r.doc_id == i and ((7 if i == 40 else i) in r.item_ids or i == 1)
        assert [1] in [r.item_ids for r in found if r.doc_id is None] and [[]] * 2 == [r.item_ids for r in found if (r.doc_id or 0) >= 90]


def test_long_texts_are_searched_in_stretches(monkeypatch):
    monkeypatch.setattr(dc, "STRETCH_CHARS", 50)
    text = " ".join(f"w{i}" for i in range(5000))
    parts = list(dc.stretches(text))
    assert len(parts) > 100 and sum(parts, []) == dc.words_of(text)


def test_svd_finds_the_leading_space():
    rng = np.random.default_rng(1)
    left, right = np.linalg.qr(rng.normal(size=(300, 80)))[0], np.linalg.qr(rng.normal(size=(80, 80)))[0]
    a = left * (0.7 ** np.arange(80)) @ right.T
    found = dc.randomised_svd(lambda x: a.T @ (a @ x), 80, 10, 6)
    assert found.shape == (80, 10)
    assert np.abs(np.abs((found * right[:, :10]).sum(axis=0)) - 1).max() < 1e-3


def test_passages_hold_every_word():
    for n in (1, 4, 64, 65, 68, 129, 700):
        text = " ".join(f"w{i}" for i in range(n))
        parts = dc.passages_of(text)
        assert sum((w for w, _ in parts), []) == dc.words_of(text) and all(len(w) <= 64 for w, _ in parts)
        assert max(len(w) for w, _ in parts) - min(len(w) for w, _ in parts) <= 1
    assert dc.passages_of(None) == [] and dc.passages_of(" . ") == []


def indexed(items):
    """The index of some passages, with a basis of all words."""
    passages = [(i, w, a) for i, t in enumerate(items) for w, a in dc.passages_of(" ".join(t) + ".")]
    fit = dc.Fit(passages)
    return dc.Index(passages, fit, dc.weights({-1: 100}, len(fit.code)), np.eye(len(fit.code) + 1, dtype=np.float32))


def test_repeated_words_are_told_apart_before_sequences_are_compared(monkeypatch):
    """A text that repeats a few words of a passage is like it by its cosine and by the count of places, but does not hold
    enough of its words: no window of it goes to the comparison of sequences."""
    rng = random.Random(11)
    item = [f"w{i}" for i in range(40)]
    index, looked = indexed([item]), []
    share = dc.Index.share
    monkeypatch.setattr(dc.Index, "share", lambda *a: looked.append(1) or share(*a))
    texts = [[rng.choice(item[:12]) for _ in range(2000)], [*item[:10], *[rng.choice(item[:10]) for _ in range(50)]]]
    assert index.hits([index.fit.codes([w.encode() for w in t]) for t in texts]) == [{}, {}] and not looked
    assert index.hits([index.fit.codes([w.encode() for w in ["x", *item, "y"]])]) == [{0: 1.0}] and looked


def test_no_window_that_holds_a_passage_is_left_out(monkeypatch):
    """What the count of words drops, the comparison of sequences refuses."""
    rng = random.Random(12)
    items = [words(rng, rng.randrange(8, 64), 60, 2.0) for _ in range(30)]
    index = indexed(items)
    texts = [[w for _ in range(4) for w in words(rng, rng.randrange(0, 30), 60, 2.0) + edited(rng, rng.choice(items), 0.3)] for _ in range(40)]
    seen, enough = [0, 0], dc.Index._enough

    def checked(self, steps, begin, end, j, b):
        out = enough(self, steps, begin, end, j, b)
        for i in np.flatnonzero(b > begin).tolist():
            region = steps[b[i] - 1 : min(b[i] + 5, end[i])].reshape(-1).tolist()
            held = self.share(int(j[i]), region) > 0
            seen[0] += held
            seen[1] += not out[i]
            assert out[i] or not held
        return out

    monkeypatch.setattr(dc.Index, "_enough", checked)
    index.hits([index.fit.codes([w.encode() for w in t]) for t in texts])
    assert min(seen) > 100
