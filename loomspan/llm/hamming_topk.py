"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become sign codes; equal codes fold into one entry that keeps its k + 1 smallest ids, so a very common
vector is one row. A code is cut into m segments of about log2(codes) bits, and every segment is an index of its own:
a segment's values are cut into cells by their leading bits, and a query visits the cells within the search radius of
its own value, where bucket tables give the codes whose segment lies that near. After radius r in all segments every
code within m * (r + 1) - 1 bits has been seen (the pigeonhole principle). Radii grow round by round, and a query
leaves once its kth verified distance is provably covered.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

TOP = 10
QUERY_STEP = 20
QUERY_BLOCK = 16_384  # queries that one task answers; codes are sent once for each block of them
CODE_BLOCK = 16_384  # codes that one task searches
SEGMENT_BITS = (8, 32)  # least and most bits of a segment


def sign_code(vector: Column, dims: int) -> Column:
    """The signs as an array of longs, 64 bits each; a missing or null value is 0."""
    value = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i % 64 if i % 64 < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    words = [reduce(lambda a, b: a.bitwiseOR(b), [value(i) for i in range(w, min(w + 64, dims))]) for w in range(0, max(1, dims), 64)]
    return F.array(*words)


@lru_cache(64)
def flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in pick) for pick in combinations(range(bits), radius)], np.int64)


class Segments:
    """How codes of `dims` bits are cut: m places (first bit, bits), and the leading bits that name a cell."""

    def __init__(self, dims: int, codes: int, code_block: int):
        least, most = SEGMENT_BITS
        bits = min(dims, max(least, min(most, codes.bit_length() - 1)))
        self.m = max(1, round(dims / bits))
        cut = np.linspace(0, dims, self.m + 1).astype(int)
        self.places = list(zip(cut[:-1].tolist(), np.diff(cut).tolist(), strict=True))
        self.lead = min(min(bits for _, bits in self.places), max(0, (codes // code_block).bit_length()))
        self.widest = max(bits for _, bits in self.places)

    def values(self, codes: np.ndarray, s: int) -> np.ndarray:
        """Segment s of (n, words) uint64 codes."""
        first, bits = self.places[s]
        word, shift = divmod(first, 64)
        value = codes[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | codes[:, word + 1] << np.uint64(64 - shift)
        return (value & np.uint64((1 << bits) - 1)).astype(np.int64)

    def cells(self, code: Column) -> Column:
        """An array of (segment, cell) of a code."""
        out = []
        for s, (first, bits) in enumerate(self.places):
            word, shift = divmod(first, 64)
            value = F.shiftrightunsigned(code[word], shift)
            if shift + bits > 64:
                value = value.bitwiseOR(F.shiftleft(code[word + 1], 64 - shift))
            value = F.shiftrightunsigned(value.bitwiseAND(F.lit((1 << bits) - 1)), bits - self.lead)
            out.append(F.struct(F.lit(s).alias("segment"), value.cast("long").alias("cell")))
        return F.array(*out)


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).view(np.uint64)


FOUND = "q array<long>, code array<long>, least long, distance int"


def _search(cut: Segments, low: int, high: int, k: int):
    """Answers a block of queries from the codes of one cell: those whose segment differs in more than `low` and at
    most `high` bits, and that no earlier round or segment has brought; the k first of each query."""

    def run(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        s, cell = key[0].as_py(), key[1].as_py()
        out: list[tuple] = []
        if queries.num_rows and block.num_rows:
            own, least, texts = _words(block.column("code")), np.array(block.column("least").to_pylist(), np.int64), block.column("code").to_pylist()
            rest = cut.places[s][1] - cut.lead
            parts = [cut.values(own, i) for i in range(cut.m)]
            small = parts[s] & ((1 << rest) - 1)
            order = np.argsort(small, kind="stable")
            start = np.searchsorted(small[order], np.arange((1 << rest) + 1)) if rest <= 20 else None
            asked = _words(queries.column("code"))
            values = [cut.values(asked, i) for i in range(cut.m)]
            for row, (code, bound) in enumerate(zip(queries.column("code").to_pylist(), queries.column("bound").to_pylist(), strict=True)):
                value = int(values[s][row])
                ahead = ((value >> rest) ^ cell).bit_count()
                probes = [flips(rest, r) for r in range(max(0, low + 1 - ahead), min(rest, high - ahead) + 1)]
                if not probes or start is None or sum(map(len, probes)) > len(own):
                    apart = np.bitwise_count(parts[s] ^ value)
                    found = np.flatnonzero((apart > low) & (apart <= high))
                else:
                    bucket = (value & ((1 << rest) - 1)) ^ np.concatenate(probes)
                    size = start[bucket + 1] - start[bucket]
                    bucket, size = bucket[size > 0], size[size > 0]
                    found = order[np.repeat(start[bucket] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(bucket) else bucket
                far = np.bitwise_count(own[found] ^ asked[row]).sum(axis=1, dtype=np.int64)
                good = far <= bound
                for i in range(cut.m):
                    if i != s:
                        good &= np.bitwise_count(parts[i][found] ^ values[i][row]) > (high if i < s else low)
                found, far = found[good], far[good]
                best = np.lexsort((least[found], far))[:k]
                out += [(code, texts[i], int(least[i]), int(d)) for i, d in zip(found[best].tolist(), far[best].tolist(), strict=True)]
        q, c, m, d = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"q": pa.array(q, pa.list_(pa.int64())), "code": pa.array(c, pa.list_(pa.int64())), "least": pa.array(m, pa.int64()), "distance": pa.array(d, pa.int32())})

    return run


def nearest_codes(questions: DataFrame, codes: DataFrame, dims: int, k: int, scratch: Scratch, query_block: int = QUERY_BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """(q, code, least, distance): the k codes first by (distance, least) for each code in questions (code).
    codes: (code, least), each code once."""
    total = codes.count()
    cut = Segments(dims, total, code_block)
    index = codes.select("code", "least", F.explode(cut.cells(F.col("code"))).alias("x")).select("code", "least", "x.*")
    sizes = index.groupBy("segment", "cell").agg(F.ceil(F.count("*") / code_block).cast("long").alias("blocks"))
    sizes = scratch.keep(sizes, "cells")
    best, low, high, number = None, -1, min(2, cut.widest), 0
    active = scratch.keep(questions.select("code", F.lit(dims).alias("bound")), "active")
    while True:
        near = [m for r in range(min(cut.lead, high) + 1) for m in flips(cut.lead, r).tolist()] or [0]
        visits = active.select("code", "bound", F.explode(cut.cells(F.col("code"))).alias("x")).select("code", "bound", "x.segment", F.explode(F.transform(F.lit(near).cast("array<long>"), lambda f: F.col("x.cell").bitwiseXOR(f))).alias("cell"))
        visits = visits.join(sizes, ["segment", "cell"])
        turns = visits.groupBy("segment", "cell").agg(F.ceil(F.count("*") / query_block).cast("long").alias("turns"))
        visits = visits.join(turns, ["segment", "cell"]).select("code", "bound", "segment", "cell", F.pmod(F.xxhash64("code"), F.col("turns")).alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        held = index.join(sizes.join(turns, ["segment", "cell"]), ["segment", "cell"]).select("code", "least", "segment", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.pmod(F.xxhash64("code"), F.col("blocks")).alias("block"))
        key = ["segment", "cell", "turn", "block"]
        found = visits.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_search(cut, low, high, k), FOUND)
        found = found if best is None else found.union(best)
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "least"))).where(F.col("r") <= k).drop("r")
        best = scratch.keep(found, f"best-{number}")
        scratch.drop(f"best-{number - 1}")
        # A query leaves when its kth distance is covered, or every code has been met.
        if high >= cut.widest:
            return best
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        n = F.coalesce("n", F.lit(0))
        covered = (n >= total) | (n >= k) & (F.coalesce("far", F.lit(dims)) <= cut.m * (high + 1) - 1)
        state = active.join(state, active["code"] == state["q"], "left").where(~covered)
        active = scratch.keep(state.select("code", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(dims)).alias("bound")), f"active-{number}")
        if active.isEmpty():
            return best
        low, high, number = high, min(cut.widest, high + max(2, high // 2)), number + 1


def top_k(vectors: DataFrame, k: int = TOP, query_step: int = QUERY_STEP, dims: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, code_block: int = CODE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest other rows of each query, by (distance, vec_id).

    Queries are the rows whose id divides by `query_step`; all rows with an id are searched. dims: components of a
    vector, by default those of the longest; with dims given, a longer vector is an error. Missing or null components
    count as 0, so a null vector has the all-zero code. Rows with a null id are no query and no answer. Repeated rows
    of an id count once, with their smallest code. With fewer than k other ids, all are returned. An empty table gives
    no rows. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "hamming")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    if dims is not None and longest > dims:
        raise ValueError(f"a vector has {longest} components; dims is {dims}")
    dims = max(1, longest if dims is None else dims)
    coded = rows.select("vec_id", sign_code(F.col("vector"), dims).alias("code"))
    coded = scratch.keep(coded.groupBy("vec_id").agg(F.min("code").alias("code")), "coded")
    # Each distinct code with its k + 1 smallest ids; a common code is ranked in salted parts first.
    salted = Window.partitionBy("code", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    ranked = coded.withColumn("r", F.row_number().over(salted)).where(f"r <= {k + 1}")
    codes = scratch.keep(ranked.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids")), "codes")
    asked = coded.where(F.pmod("vec_id", F.lit(query_step)) == 0)
    found = nearest_codes(asked.select("code").distinct(), codes.select("code", F.col("ids")[0].alias("least")), dims, k + 1, scratch, query_block, code_block)
    # A query code's ids share its neighbours; each leaves out its own id.
    near = found.join(codes, "code").select("q", F.explode("ids").alias("vec_id"), "distance").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).where(f"r <= {k + 1}")
    near = near.groupBy(F.col("q").alias("code")).agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))).alias("near"))
    out = asked.join(near, "code").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.distance")
