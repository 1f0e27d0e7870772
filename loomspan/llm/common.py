"""Helpers that several operators share: word hashing, integer mixing, and the scratch tables of the library."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, shared_dir

__all__ = ["GOLDEN", "Scratch", "mix64", "row_hash", "shared_dir", "step", "word_hashes", "words_of"]

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WRAP = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def step(j: int) -> np.uint64:
    """j steps of the splitmix64 counter."""
    return np.uint64((j * int(GOLDEN)) & _WRAP)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 arrays."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+` of a text, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def row_hash(df: DataFrame) -> Column:
    """A hash of all values of a row; maps and variants, which have no hash of their own, go by their JSON."""
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    return F.xxhash64(*[df[f"`{f.name}`"] if plain(f) else F.to_json(F.struct(df[f"`{f.name}`"].alias("v"))) for f in df.schema.fields])
