"""Mixing sources to target weights.

A source's words, documents in a fixed hash order, pack into blocks of fixed length. The mix has one slot for each
block drawn. Every output shard draws multinomial counts of the sources; the draws of a source, numbered over the
shards, run through pseudorandom permutations of its block numbers, a new one for each pass, and slots meet blocks in
a join by (source, block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from .common import Scratch, row_hash
from .feistel import permute

BLOCK_WORDS = 64
SHARD_SLOTS = 8192
REPEATS = 3
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"
SLOTS = "shard long, position int, k int, block long"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), repeats: float = REPEATS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in code-point order, null last. Weights repeat along that order; targets
    share the sum of sizes, stop at `repeats` times their source's size, and pass on the excess by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    out, open_, rest = [0.0] * len(order), set(range(len(order))), float(sum(n for _, n in order))
    while open_:
        unit = rest / sum(weight[i] for i in open_)
        full = {i for i in open_ if unit * weight[i] > repeats * order[i][1]}
        for i in full:
            out[i] = float(repeats * order[i][1])
            rest -= out[i]
        open_ -= full
        if not full:
            for i in open_:
                out[i] = unit * weight[i]
            break
    return [(s, n, t) for (s, n), t in zip(order, out, strict=True)]


class Mix:
    """rows: doc_id, size, h, source, copy, k, start, source_size, target. draws: shard, k, begin, count, offset, drawn.
    slots: shard, position, k, block. segments: the rows' parts by block, with how often the mix takes each."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = docs.sparkSession
        self.scratch = scratch = Scratch(spark, "mixing")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
        # Rows that agree in all that counts are one row with copies, so that none of them crowds a place in the order.
        base = scratch.keep(base.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")), "base")
        sums = base.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).collect()  # a row for each source
        self.plan = plan = targets([(r["source"], r["size"]) for r in sums])
        self.blocks = blocks = np.array([-(-n // block_words) for _, n, _ in plan], np.int64)
        self.quota = quota = np.array([round(t * int(b) / n) if n else 0 for (_, n, t), b in zip(plan, blocks, strict=True)], np.int64)
        # As Arrow: rows from a list would start Python workers of another kind on the executors.
        kinds = (("k", pa.int32()), ("name", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()))
        table = spark.createDataFrame(pa.Table.from_pylist([{"k": k, "name": s, "source_size": n, "target": t} for k, (s, n, t) in enumerate(plan)], pa.schema(kinds)))
        rows = base.join(F.broadcast(table), base["source"].eqNullSafe(table["name"])).drop("name").withColumn("words", F.col("size") * F.col("copies"))
        full = positions(rows.where("size > 0"), ["k"], [F.xxhash64("doc_id", "h", F.lit(seed)), F.col("doc_id"), F.col("size"), F.col("h")], "start", weight="words")
        rows = full.unionByName(rows.where("size = 0").withColumn("start", F.lit(-1).cast("long"))).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        self.rows = scratch.keep(rows.withColumn("start", F.when(F.col("size") > 0, F.col("start") + F.col("copy") * F.col("size"))).drop("copies", "words"), "rows")

        self.draws = self._draw(shard_slots, seed)
        self.slots = self._slots(shard_slots, seed)
        times = self.slots.groupBy("k", "block").agg(F.count("*").alias("times"))
        parts = self.rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
        lo = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))
        hi = F.least("size", (F.col("block") + 1) * block_words - F.col("start"))
        # The slots are many more than the rows they come from let the planner think: no broadcast.
        self.segments = parts.withColumn("first", lo).withColumn("words", hi - F.col("first")).join(times.hint("merge"), ["k", "block"])

    def _draw(self, shard_slots: int, seed: int) -> DataFrame:
        """Each shard's multinomial counts of the sources, where they begin in the shard, and how many draws of the source
        earlier shards hold."""
        total = int(self.quota.sum())
        shards = -(-total // shard_slots)
        share = self.quota / max(1, total)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    counts = np.random.default_rng([seed, shard]).multinomial(min(shard_slots, total - shard * shard_slots), share)
                    k = np.flatnonzero(counts)
                    begin = np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(k.astype(np.int32)), pa.array(begin[k]), pa.array(counts[k])], names=["shard", "k", "begin", "count"])

        drawn = self.rows.sparkSession.range(0, shards, 1, max(1, min(-(-shards // 16), 10_000))).mapInArrow(draw, "shard long, k int, begin long, count long")
        drawn = self.scratch.keep(drawn, "drawn")
        return self.scratch.keep(positions(drawn, ["k"], [F.col("shard")], "offset", weight="count", total="drawn"), "draws")

    def _slots(self, shard_slots: int, seed: int) -> DataFrame:
        """Every slot's block. The draws of a source number its slots; those beyond its total go, in order, to the sources
        that were drawn too seldom, so that totals are met. A source's numbers run through a permutation of its blocks,
        a new one for each pass."""
        blocks, quota, total = self.blocks, self.quota, int(self.quota.sum())
        drawn = np.zeros(len(quota), np.int64)
        for r in self.draws.groupBy("k").agg(F.max("drawn").alias("n")).collect():
            drawn[r["k"]] = r["n"]
        spare, short = np.cumsum(np.r_[0, np.maximum(0, drawn - quota)]), np.cumsum(np.r_[0, np.maximum(0, quota - drawn)])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    own = batch.slice(at, 256)
                    shard, k, begin, count, offset = (own.column(i).to_numpy() for i in range(5))
                    which = np.repeat(np.arange(len(k)), count)
                    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    source, rank = k[which].astype(np.int64), offset[which] + inside
                    over = np.flatnonzero(rank >= quota[source])
                    extra = spare[source[over]] + rank[over] - quota[source[over]]
                    source[over] = np.searchsorted(short, extra, side="right") - 1
                    rank[over] = drawn[source[over]] + extra - short[source[over]]
                    turn, block = np.divmod(rank, blocks[source])
                    for s in np.unique(source):
                        mine = np.flatnonzero(source == s)
                        block[mine] = permute(block[mine], int(blocks[s]), seed * 1_000_003 + int(s) * 64 + turn[mine])
                    # A shard's slots are shuffled among themselves.
                    place = begin[which] + inside
                    size = np.minimum(shard_slots, total - shard * shard_slots)[which]
                    for n in np.unique(size).tolist():  # the last shard may be shorter
                        mine = np.flatnonzero(size == n)
                        place[mine] = permute(place[mine], n, seed * 7_368_787 + shard[which][mine])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[which]), pa.array(place.astype(np.int32)), pa.array(source.astype(np.int32)), pa.array(block)], names=["shard", "position", "k", "block"])

        return self.draws.select("shard", "k", "begin", "count", "offset").mapInArrow(deal, SLOTS)

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for every input row."""
        got = self.segments.groupBy("k", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.rows.join(got, ["k", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row for each input row with what the mix takes of it.

    A null text has size 0 and is never taken; null sources form one source, the last. Rows that repeat an
    id count each with its own words. An empty table, or one without words, gives taken 0. Two runs agree,
    whatever the partitioning. Other columns are ignored. The list of sources, a row for each, is held by the driver
    and by tasks.
    """
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of `docs`, one row for each document and repeat, whose text is the
    words that repeat takes (runs of whole blocks, joined by a newline); n_chars, where there is such a column, its
    length. Documents that are not taken have no row, so null and blank texts have none, and an empty table gives
    none. Rows that agree in id, text and source go as one, with the columns of the row whose values hash lowest, and
    as many repeats as all of them take. Columns may have any names.
    """
    mix = Mix(docs, **options)
    pieces = mix.segments.groupBy("doc_id", "size", "h", "source").agg(F.sort_array(F.collect_list(F.struct("copy", "first", "words", "times"))).alias("pieces"))
    pieces = pieces.select(F.struct("doc_id", "size", "h", "source").alias("name"), "pieces")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h"), F.col("source").cast("string").alias("source"))
    named = docs.select(name.alias("name"), F.struct(*docs.columns).alias("row"), row_hash(docs).alias("place"))
    joined = named.join(pieces, "name").groupBy("name").agg(F.min_by(F.struct("row", "pieces"), "place").alias("x")).select("x.*")
    taken = joined.withColumn("part", F.explode(F.udf(_slices, "array<string>", useArrow=True)(F.col("row.text"), F.col("pieces"))))
    own = {"text": F.col("part"), "n_chars": F.length("part").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return taken.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _slices(text: str, pieces: list) -> list[str]:
    """One text for each copy and repeat; the words' own spacing is kept inside a run of blocks."""
    at = [m.span() for m in re.finditer(WORD, text)]
    out = []
    for copy in sorted({p["copy"] for p in pieces}):
        own = sorted((p for p in pieces if p["copy"] == copy), key=lambda p: p["first"])
        for turn in range(max(p["times"] for p in own)):
            runs: list[list[int]] = []
            for p in own:
                if p["times"] > turn:
                    if runs and runs[-1][1] == p["first"]:
                        runs[-1][1] = p["first"] + p["words"]
                    else:
                        runs.append([p["first"], p["first"] + p["words"]])
            out.append("\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs))
    return out
