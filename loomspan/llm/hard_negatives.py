"""Hard-negative mining by distributed radix selection.

Scores are whole numbers, so the k first rows of a window of scores are found without sorting rows: every task counts
its scores into equal buckets of each window, the sums say which bucket holds the kth row, and the next round cuts that
bucket again, digit by digit; rows of one score are cut by their ids in the same way. Once few rows are left, a last
pass gathers those that qualify. The same selection finds an anchor's positives (one window of all scores of its label)
and the negatives of each anchor and positive.

Anchors are taken in chunks of bounded size that are broadcast; the rows stay where they are and are read once for each
round of a chunk. Only counts and qualifying rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

PER_ANCHOR = PER_POSITIVE = 5
ANCHOR_STEP = 100
SCALE = 256
LEAST, MOST = 80, 100  # a negative's score, in hundredths of the positive's
CHUNK_CELLS = 1 << 17  # anchors times components that are broadcast at once
SCORE_CELLS = 1 << 20  # scores that a task holds at once
BUCKETS = 256  # of a round's histogram
GATHERED = 64  # rows of a window that are gathered rather than cut again, unless it takes more
EXACT = 1 << 53  # below it sums of products are exact in doubles

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def flipped(id_col: Column, label: Column, step: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id divides by `step`."""
    return F.when(id_col % step == 0, (label + 1) % labels).otherwise(label)


def _rows(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return x.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("long")))


@dataclass
class Windows:
    """Windows of scores, several for an anchor, and how far each has been cut. The kth row lies among the scores from
    `low` to `high` and, where these are one score, among the ids from `first` to `last`; `done` rows come before
    those, `left` are among them. same: rows of the anchor's label take part, else those of other labels."""

    anchor: np.ndarray
    place: np.ndarray
    top: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    done: np.ndarray
    left: np.ndarray
    same: bool

    @classmethod
    def of(cls, anchor: np.ndarray, place: np.ndarray, low: np.ndarray, top: np.ndarray, ids: tuple[int, int], same: bool) -> Windows:
        full = lambda v: np.full(len(anchor), v, np.int64)
        return cls(anchor, place, top, low.copy(), top.copy(), full(ids[0]), full(ids[1]), full(0), full(np.iinfo(np.int64).max), same)

    def only(self, at: np.ndarray) -> Windows:
        return replace(self, **{f.name: getattr(self, f.name)[at] for f in fields(self) if f.name != "same"})

    def width(self) -> np.ndarray:
        """Of a bucket, as uint64: of ids where one score is left, else of scores."""
        size = np.where(self.low < self.high, self.high.view(np.uint64) - self.low.view(np.uint64), self.last.view(np.uint64) - self.first.view(np.uint64))
        return size // np.uint64(BUCKETS) + np.uint64(1)

    def open(self, gathered: int) -> np.ndarray:
        many = (self.left > gathered) | (self.done + np.minimum(self.left, gathered) > gathered)
        return many & ((self.low < self.high) | (self.first < self.last))

    def cut(self, at: np.ndarray, bucket: np.ndarray, before: np.ndarray, count: np.ndarray) -> None:
        """Narrows the windows `at` to a bucket of theirs."""
        width = self.width()[at]
        step, width = (bucket.astype(np.uint64) * width).view(np.int64), width.view(np.int64)
        scored = self.low[at] < self.high[at]
        s, i = at[scored], at[~scored]
        self.high[s] -= step[scored]
        self.low[s] = np.maximum(self.low[s], self.high[s] - (width[scored] - 1))
        self.first[i] += step[~scored]
        self.last[i] = np.minimum(self.last[i], self.first[i] + (width[~scored] - 1))
        self.done[at] += before
        self.left[at] = count


@dataclass
class Anchors:
    """A chunk of anchors, of bounded size."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def _pairs(blocks: Iterator[pa.RecordBatch], anchors: Anchors, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, id) for rows whose score may lie in a window, a bounded block at a time. A row is never its own
    partner."""
    n, dims = anchors.vectors.shape
    lowest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(lowest, windows.anchor, windows.low)
    order = np.argsort(windows.anchor, kind="stable")
    start = np.searchsorted(windows.anchor[order], np.arange(n + 1))
    most = float(np.abs(anchors.vectors).max(initial=0)) * dims
    for batch in blocks:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = batch.column(2).flatten().to_numpy().reshape(-1, dims)
        kind = np.float64 if most * float(np.abs(rows).max(initial=0)) < EXACT else np.int64
        turned = anchors.vectors.T.astype(kind)
        step = max(1, SCORE_CELLS // max(1, n))
        for at in range(0, len(ids), step):
            own = ids[at : at + step]
            scores = (rows[at : at + step].astype(kind) @ turned).astype(np.int64)
            row, anchor = np.nonzero((scores >= lowest) & ((labels[at : at + step, None] == anchors.labels) == windows.same) & (own[:, None] != anchors.ids))
            score, size = scores[row, anchor], start[anchor + 1] - start[anchor]
            pair = np.repeat(np.arange(len(anchor)), size)
            w = order[start[anchor][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)]
            yield w, score[pair], own[row[pair]]


def _counted(windows: Windows, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in each bucket of each window, summed over the task."""
    total, width = np.zeros(len(windows.anchor) * BUCKETS, np.int64), windows.width()
    for w, score, row in found:
        tied = windows.low[w] == windows.high[w]
        good = (score >= windows.low[w]) & (score <= windows.high[w]) & (~tied | (row >= windows.first[w]) & (row <= windows.last[w]))
        w, score, row, tied = w[good], score[good], row[good], tied[good]
        far = np.where(tied, row.view(np.uint64) - windows.first[w].view(np.uint64), windows.high[w].view(np.uint64) - score.view(np.uint64))
        total += np.bincount(w * BUCKETS + (far // width[w]).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    w = at // BUCKETS
    yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(total[at]), pa.array(k - windows.done[w])], names=["w", "bucket", "n", "need"])


def _qualifying(anchors: Anchors, windows: Windows, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for w, score, row in found:
        good = (score <= windows.top[w]) & ((score > windows.low[w]) | (score == windows.low[w]) & ((windows.low[w] < windows.high[w]) | (row <= windows.last[w])))
        w = w[good]
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[windows.anchor[w]]), pa.array(windows.place[w], pa.int32()), pa.array(score[good]), pa.array(row[good])], names=["anchor_id", "place", "score", "id"])


def select_first(rows: DataFrame, anchors: Anchors, windows: Windows, k: int, scratch: Scratch, name: str, gathered: int = GATHERED) -> DataFrame:
    """(anchor_id, place, r, score, id): the k first rows of every window by (score descending, id).
    rows: (vec_id, label, v), all v of the same size."""
    gathered = max(gathered, k)

    def run(part: Windows, each: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((anchors, part))

        def task(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, held = sent.value
            return each(own, held, _pairs(blocks, own, held))

        return rows.mapInArrow(task, schema)

    while (again := np.flatnonzero(windows.open(gathered))).size:
        counts = run(windows.only(again), lambda _, part, found: _counted(part, found, k), "w int, bucket int, n long, need long")
        counts = counts.groupBy("w", "bucket").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        running = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).where("before < need")
        # The bucket of the kth row, or the last one; a row for each window of the chunk comes to the driver.
        kth = counts.groupBy("w").agg(F.max_by(F.struct("bucket", "before", "n"), "bucket").alias("x")).select("w", "x.*").toArrow()
        windows.left[again] = 0
        w, bucket, before, n = (kth.column(c).to_numpy().astype(np.int64) for c in ("w", "bucket", "before", "n"))
        windows.cut(again[w], bucket, before, n)
    first = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    found = run(windows, _qualifying, "anchor_id long, place int, score long, id long").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return scratch.keep(found, name)


def mine(vectors: DataFrame, anchor_step: int = ANCHOR_STEP, positives: int = PER_ANCHOR, negatives: int = PER_POSITIVE, scale: int = SCALE, least: int = LEAST, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk_cells: int = CHUNK_CELLS, gathered: int = GATHERED) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id divides by `anchor_step`. A row's score is its inner product with the anchor, of
    components floor(scale * x). An anchor's positives are the `positives` first other rows of its label; each positive
    gets the first `negatives` rows of other labels whose score lies between `least` and `most` hundredths of its own.
    Rows come by score, the highest first, then by id.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Rows that repeat an id count
    once, with their smallest (label, vector). Missing components of shorter vectors, or empty ones, count as 0.
    Positives without such negatives have no rows, nor has an empty table. Scores that do not fit into a long are an
    error. Other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    rows = _rows(vectors, scale, id_col, vector_col, label_col).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    rows = scratch.keep(rows, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    size = rows.agg(F.max(F.size("v")), F.min(F.size("v")), F.max(norm), F.min("vec_id"), F.max("vec_id"), F.count_if(F.col("vec_id") % anchor_step == 0)).first()
    longest, shortest, reach, first, last, n = size
    if not n:
        return spark.createDataFrame([], FOUND)
    if reach * reach >= 1 << 55:  # times 100 it is still a long
        raise ValueError("scores do not fit into a long")
    dims = max(1, longest)
    if shortest < dims:
        rows = rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0).cast("long"))))
    asked = scratch.keep(rows.where(F.col("vec_id") % anchor_step == 0), "anchors")
    chunks = -(-n * dims // chunk_cells)
    out = []
    for number in range(chunks):
        table = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(chunks)) == number).toArrow()
        if not table.num_rows:
            continue
        table = table.sort_by("vec_id")
        own = Anchors(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims))
        bound = np.ceil(np.linalg.norm(own.vectors.astype(np.float64), axis=1) * reach * (1 + 1e-9)).astype(np.int64) + 1
        every = np.arange(len(own.ids))
        near = select_first(rows, own, Windows.of(every, np.zeros_like(every), -bound, bound, (first, last), True), positives, scratch, f"positives-{number}", gathered)
        found = near.select("anchor_id", "r", "score").toArrow()
        score = found.column("score").to_numpy()
        low, top = -(-score * least // 100), score * most // 100
        full = low <= top
        windows = Windows.of(np.searchsorted(own.ids, found.column("anchor_id").to_numpy())[full], found.column("r").to_numpy()[full], low[full], top[full], (first, last), False)
        if not full.any():
            continue
        far = select_first(rows, own, windows, negatives, scratch, f"negatives-{number}", gathered)
        far = far.select("anchor_id", F.col("place").alias("r"), F.col("r").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        out.append(far.join(near.select("anchor_id", "r", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "r"]))
    if not out:
        return spark.createDataFrame([], FOUND)
    names = [c.split()[0] for c in FOUND.split(", ")]
    if len(out) == 1:
        return out[0].select(*names)
    for number, part in enumerate(out):
        part.select(*names).write.parquet(scratch.path(f"found/n={number}"))
    return spark.read.schema(FOUND).option("recursiveFileLookup", "true").parquet(scratch.path("found"))
