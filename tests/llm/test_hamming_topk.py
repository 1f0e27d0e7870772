"""Exact top-k search against brute force: wide codes, clusters larger than a block, few codes."""

import numpy as np
import pytest

from loomspan.llm import hamming_topk as ht


def brute(codes, ids, k=10, step=20):
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    out = set()
    for row, i in enumerate(ids):
        if i % step == 0:
            far = (bits != bits[row]).sum(axis=1)
            near = sorted((int(d), j) for d, j in zip(far, ids, strict=True) if j != i)[:k]
            out |= {(i, r + 1, j, d) for r, (d, j) in enumerate(near)}
    return out


def vectors(spark, codes, ids):
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    return spark.createDataFrame([(int(i), (2.0 * b - 1).tolist(), "x", 1) for i, b in zip(ids, bits, strict=True)], "vec_id long, embedding array<double>, code string, least int")


@pytest.mark.parametrize(("words", "n", "block"), [(1, 3000, 256), (2, 1500, 128), (1, 40, 16_384), (3, 300, 64)])
def test_random_and_clustered_codes(spark, words, n, block):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 63, (n, words)).astype(np.uint64)
    # A third lies around one code, within a few bits, in its last word only.
    codes[: n // 3] = codes[0]
    codes[: n // 3, -1] ^= np.uint64(1) << rng.integers(0, 64, n // 3).astype(np.uint64)
    codes[: n // 3, -1] ^= np.uint64(1) << rng.integers(0, 64, n // 3).astype(np.uint64)
    ids = rng.permutation(10 * n)[:n].tolist()
    got = {tuple(r) for r in ht.top_k(vectors(spark, codes, ids), query_block=32, code_block=block).collect()}
    assert got == brute(codes, ids)


def test_every_component_counts(spark):
    base = [1.0] * 128
    rows = [(i, base[:64] + [1.0 if j < i else -1.0 for j in range(64)]) for i in range(0, 60, 3)]
    got = {(r.query_id, r.vec_id): r.distance for r in ht.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()}
    assert got[0, 3] == 3 and got[0, 6] == 6 and got[0, 9] == 9
    with pytest.raises(ValueError, match="128 components"):
        ht.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=64)


def test_a_task_sees_blocks_only(spark, monkeypatch):
    """20,000 members of one cell: no task gets more codes or queries than the blocks allow, give or take the hash."""
    rng = np.random.default_rng(1)
    codes = np.full((20_000, 1), 0x0123456789ABCDEF, np.uint64)
    codes[:, 0] ^= np.uint64(1) << rng.integers(0, 16, 20_000).astype(np.uint64)
    codes[:, 0] ^= rng.integers(0, 1 << 14, 20_000).astype(np.uint64)
    codes = np.unique(codes, axis=0)
    ids = list(range(0, 20 * len(codes), 20))[: len(codes) // 20] + list(range(1, 20 * len(codes), 20))[len(codes) // 20 :]
    search = ht._search

    def watched(*a):
        run = search(*a)

        def both(key, queries, block):
            assert queries.num_rows <= 2 * 200 and block.num_rows <= 2 * 1000
            return run(key, queries, block)

        return both

    monkeypatch.setattr(ht, "_search", watched)
    got = {tuple(r) for r in ht.top_k(vectors(spark, codes, ids), query_block=200, code_block=1000).collect()}
    assert got == brute(codes, ids)
