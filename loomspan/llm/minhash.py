"""Near-duplicate detection: SuperMinHash signatures, banding, verification, union-find grouping.

Plan: one Arrow pass makes a signature, band keys and a byte sketch for each document. Documents with
equal shingle sets fold into one class by a grouped minimum. Band buckets link their members to the
bucket's smallest member (never all pairs), candidates are confirmed on full shingle sets, and the
confirmed links are grouped. In buckets that still hold several components, the members outside the largest meet
the others block by block, sketches first and full sets where those come near; a pair is looked at in the first of
the buckets that it shares. What is lost is lost by the signatures alone: at a similarity of 0.75 a pair shares no
bucket once in 190,000 times and has a sketch below the floor once in 70,000 times, less at higher ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, mix64, step, word_hashes, words_of
from .components import connected_components

SHINGLE_WORDS = 5
REGISTERS = 128
BAND_ROWS = 4
CHUNK = 120_000
SKETCH_FLOOR = 0.58  # about 4.5 standard errors of a 128-register estimate below 0.75
BLOCK = 2048
LOAD = 1 << 21  # shingles that one side of a block brings to the last comparison
SALTS = 32
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = mix64(np.arange(1, 9, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence when it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    k = min(SHINGLE_WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h += mix64(w[i : len(w) - k + 1 + i] + _SPREAD[i]) * _SPREAD[i]
    return np.unique(mix64(h))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, k: int = REGISTERS) -> np.ndarray:
    """(n, k) registers of n sets. Each element gives register p[j] the value j + r[j], where p is the
    element's own random permutation (drawn step by step) and r[j] is uniform in [0, 1). A set leaves as
    soon as its largest register is below the next step, when no later value could lower any."""
    flat = np.full(n * k, _FULL, np.uint64)
    e, d, perm = elements, owner, None
    for j in range(k):
        if j:
            live = (flat.reshape(n, k).max(axis=1) >> np.uint64(32) >= j)[d]
            if not live.any():
                break
            if perm is None:
                e, d, first = e[live], d[live], first[live]
                perm = np.tile(np.arange(k, dtype=np.uint8 if k <= 256 else np.uint16), (len(e), 1))
                rows = np.arange(len(e))
                perm[rows, first], perm[:, 0] = 0, first
            elif not live.all():
                e, d, perm = e[live], d[live], perm[live]
                rows = np.arange(len(e))
        u = mix64(e + step(j + 1))
        q = j + ((u >> np.uint64(33)) % np.uint64(k - j)).astype(np.int64)
        if perm is None:
            first = at = q
        else:
            at, old = perm[rows, q], perm[rows, j]
            perm[rows, q], perm[rows, j] = old, at
        np.minimum.at(flat, d * k + at, np.uint64(j << 32) | (u & np.uint64(0xFFFFFFFF)))
    return flat.reshape(n, k)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, bands) keys; the band's number is part of the key."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // BAND_ROWS, BAND_ROWS)
    key = np.broadcast_to(mix64(np.arange(k // BAND_ROWS, dtype=np.uint64) + GOLDEN), parts.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = mix64(key + parts[:, :, i] * _SPREAD[i])
    return key.astype(np.int64)


SIGNED = "doc_id long, n_shingles long, hi long, lo long, keys array<long>, sketch binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(ids: list, sets: list) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        signed = super_minhash(np.concatenate(full), np.repeat(np.arange(len(full)), [len(s) for s in full]), len(full)) if full else np.empty((0, REGISTERS), np.uint64)
        keys, sketch = iter(band_keys(signed).tolist()), iter(mix64(signed).astype(np.uint8))
        out: dict[str, list] = {x: [] for x in _SIGNED.names}
        for i, s in zip(ids, sets, strict=True):
            whole = xxhash.xxh3_128_digest(s.tobytes())
            hi, lo = np.frombuffer(whole, np.int64).tolist()
            for name, value in zip(_SIGNED.names, (i, len(s), hi, lo, next(keys) if len(s) else None, next(sketch).tobytes() if len(s) else None), strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=_SIGNED)

    for batch in batches:
        ids, sets, held = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            sets.append(shingle_set(words_of(text.as_py())))
            held += len(sets[-1]) + 8
            if held >= CHUNK:
                yield flush(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at in range(0, len(ids), 512):
            sets = [shingle_set(words_of(x.as_py())).astype(np.int64) for x in batch.column(1)[at : at + 512]]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 512], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["id", "shingles"])


class Met:
    """The rows (side, id, component, outside, n_shingles, sketch, keys) of one pair of blocks of a bucket."""

    def __init__(self, bucket: int, rows: list[tuple]):
        self.side, self.ids, self.group, self.outside, self.size = (np.array([r[i] for r in rows]) for i in range(5))
        self.sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        keys = np.stack([r[6] for r in rows])
        self.before = keys[:, : np.flatnonzero((keys == bucket).all(axis=0))[0]]
        self.left, self.right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)

    def near(self, at: int) -> np.ndarray:
        """Right rows in another component than `at` whose size and sketch allow a link. Two rows that share an earlier
        bucket meet there; of two rows outside the largest component, the one with the smaller id looks at the other."""
        other = self.right[(self.group[self.right] != self.group[at]) & ((self.outside[self.right] == 0) | (self.ids[self.right] > self.ids[at]))]
        other = other[4 * np.minimum(self.size[other], self.size[at]) >= 3 * np.maximum(self.size[other], self.size[at])]
        other = other[(self.sketch[other] == self.sketch[at]).sum(axis=1) >= SKETCH_FLOOR * REGISTERS]
        return other[~(self.before[other] == self.before[at]).any(axis=1)]


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches sorted by their first `width` columns. A group holds about 2 * BLOCK rows at most."""
    key, held = None, []
    for batch in batches:
        columns = [[x.values.to_numpy() for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


INVOLVED = "bucket long, x long, y long, side int, id long, component long, outside int"


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, x, y, side, id, component, outside, n_shingles, sketch, keys), those that come near another."""
    for key, rows in _grouped(batches, 3):
        met = Met(key[0], rows)
        hit = np.zeros(len(rows), bool)
        for i in met.left:
            near = met.near(i)
            hit[near] = True
            hit[i] |= len(near) > 0
        if hit.any():
            n = int(hit.sum())
            kept = [pa.array(x[hit], t) for x, t in ((met.side, pa.int32()), (met.ids, pa.int64()), (met.group, pa.int64()), (met.outside, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * n, pa.int64()) for k in key), *kept], names=["bucket", "x", "y", "side", "id", "component", "outside"])


LINKS = "a long, b long"


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links across components among rows (bucket, x, y, u, v, side, id, component, outside, n_shingles, sketch,
    keys, shingles) of one pair of blocks; a spanning set of them."""
    for key, rows in _grouped(batches, 5):
        met = Met(key[0], rows)
        met.group = np.unique(met.group, return_inverse=True)[1]
        code = np.unique(np.concatenate([r[7] for r in rows]), return_inverse=True)[1]
        parts = np.split(code, np.cumsum(met.size)[:-1])
        has = np.zeros(code.max() + 1, bool)
        us, vs = [], []
        for i in met.left:
            near = met.near(i)
            if len(near):
                has[parts[i]] = True
                common = np.array([np.count_nonzero(has[parts[j]]) for j in near])
                has[parts[i]] = False
                for j in near[100 * common >= 75 * (met.size[near] + met.size[i] - common)]:
                    if met.group[j] != met.group[i]:
                        met.group[met.group == met.group[j]] = met.group[i]
                        us.append(met.ids[i])
                        vs.append(met.ids[j])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet 100 * intersection >= 75 * union.

    A node with many partners is dealt over SALTS copies, so that none makes a hot key."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = salted.join(left, ["a", "salt"]).join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= 75 * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set holds its distinct five-word
    shingles, or its whole word sequence when shorter. Documents link at a similarity of 0.75 or more.
    component_id is the smallest id reachable over links; kept says whether that is the row's own.

    Null or blank text: an empty set, linked with nothing. Null id: not linked, component_id null, kept.
    Rows that repeat an id are one document (any of their texts may link it) and all stay in the result.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.keep(docs.mapInArrow(_sign, SIGNED), "signed")

    linkable = signed.where("doc_id is not null and n_shingles > 0")
    # Written first: a join with a grouped table in its own stage cannot be split where one text has most rows.
    classes = scratch.keep(linkable.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    member = scratch.keep(linkable.select("doc_id", "hi", "lo", "n_shingles", F.struct("keys", "sketch").alias("marks")).join(classes, ["hi", "lo"]).select("doc_id", "hi", "lo", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("marks")).alias("marks")), "member")
    reps = member.where("marks is not null").select(F.col("rep").alias("id"), "n_shingles", "marks")

    # Stars in two levels: members meet the smallest of their salted part of a bucket, and these the bucket's smallest.
    banded = reps.select("id", F.explode("marks.keys").alias("bucket")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = banded.groupBy("bucket", "salt").agg(F.min("id").alias("near"), F.count("*").alias("n"))
    shared = parts.groupBy("bucket").agg(F.min("near").alias("center"), F.sum("n").alias("m")).where("m > 1")
    parts = scratch.keep(parts.join(shared, "bucket").select("bucket", "salt", "near", "center", "m"), "parts")
    buckets = scratch.keep(banded.join(parts, ["bucket", "salt"]).select("bucket", "id", "near", "m"), "buckets")
    sets = docs.join(buckets.select(F.col("id").alias("doc_id")).distinct(), "doc_id").mapInArrow(_sets, "id long, shingles array<long>")
    sets = scratch.keep(sets, "sets")

    stars = buckets.select(F.col("near").alias("a"), F.col("id").alias("b")).union(parts.select("center", "near")).where("a != b").distinct()
    links = scratch.keep(_confirmed(stars, sets), "links-0")
    # Members that repeat an id tie that id's classes together.
    same = member.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(reps.select(F.col("id").alias("a")).distinct(), "a").distinct()
    links = links.union(same)
    component = scratch.keep(connected_components(links, scratch, "first"), "component-0")

    # What the stars leave: buckets that still hold several components. Members outside a bucket's largest component meet
    # all its members, a block against a block; sketches go first, and sets only for those that a sketch lets through.
    marked = buckets.where("m > 2").select("bucket", "id").join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = marked.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = counted.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("m"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    open_ = open_.select("bucket", "main", F.ceil(F.col("m") / BLOCK).alias("ys"), F.ceil(F.col("rest") / BLOCK).alias("xs"))
    marked = scratch.keep(marked.join(open_, "bucket"), "open")
    marks = reps.select("id", "n_shingles", F.col("marks.sketch").alias("sketch"), F.col("marks.keys").alias("keys"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    key, cells, row = ["bucket", "x", "y"], ["bucket", "x", "y", "u", "v"], ["side", "id", "component", "outside"]
    marked = marked.withColumn("outside", (F.col("component") != F.col("main")).cast("int"))
    probes = marked.where("outside = 1").withColumn("x", part(7, "xs")).withColumn("y", every("ys")).withColumn("side", F.lit(0))
    others = marked.withColumn("y", part(8, "ys")).withColumn("x", every("xs")).withColumn("side", F.lit(1))
    met = probes.select(*key, *row).union(others.select(*key, *row)).join(marks, "id")
    met = met.select(*key, *row, "n_shingles", "sketch", "keys").repartition(*key).sortWithinPartitions(*key)
    met = scratch.keep(met.mapInArrow(_involved, INVOLVED), "involved").join(marks, "id")

    # Full sets are compared in cells: blocks whose sides hold more than LOAD shingles are cut again.
    held = lambda side: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("side") == side, F.col("n_shingles"))) / LOAD))
    met = met.join(met.groupBy(*key).agg(held(0).alias("us"), held(1).alias("vs")), key)
    met = met.where("side = 0").withColumn("u", part(9, "us")).withColumn("v", every("vs")).union(met.where("side = 1").withColumn("u", every("us")).withColumn("v", part(10, "vs")).select(*met.columns, "u", "v"))
    met = met.join(sets, "id").select(*cells, *row, "n_shingles", "sketch", "keys", "shingles").repartition(*cells).sortWithinPartitions(*cells)
    links = links.union(scratch.keep(met.mapInArrow(_remaining, LINKS).distinct(), "links-1"))
    component = scratch.keep(connected_components(links, scratch, "second"), "component-1")
    scratch.drop("parts", "buckets", "sets", "component-0", "open", "involved")

    rep_of = member.select("hi", "lo", "rep").distinct()
    found = rep_of.join(component, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("found"))
    out = signed.select("doc_id", "n_shingles", "hi", "lo").join(found, ["hi", "lo"], "left")
    own = F.when(F.col("n_shingles") > 0, F.least("found", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
