"""Keyed permutations of [0, n): a balanced Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

from .common import mix64, step

ROUNDS = 6


def permute(x: np.ndarray, n: int, key: int | np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The image of each x under the permutation of range(n) that the key names; an array gives each x its own key."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(x).astype(np.uint64)
    own = key.astype(np.uint64) if isinstance(key, np.ndarray) else np.full(len(out), key & 0xFFFFFFFFFFFFFFFF, np.uint64)
    keys = [mix64(own + step(i + 1)) for i in range(rounds)]
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k[todo]) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)
