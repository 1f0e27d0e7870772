"""Exact removal of repeated passages with two-stage suffix sorting.

Every 100-byte window contains the smallest hash of its 32-byte grams at the same place wherever the window
occurs, so equal windows share an anchor. Anchors that occur once cannot hold a repeat and go first. Each other
anchor brings the bytes of the windows it is responsible for; equal stretches fold into their earliest
occurrence; the different ones that share an anchor meet in one task, which builds a suffix array of them by
two-stage sorting and finds equal windows as runs of adjacent common prefixes of 100 bytes or more. An anchor with
very many different stretches is cut by the bytes around it, so that no group grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GOLDEN, Scratch, mix64

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES = 4_000_000
COMBINE_BYTES = 2_000_000  # texts whose repeats are combined before anything moves
SEVERAL = 4  # different stretches of one anchor in such a chunk from which on they are dealt out one by one
GROUP = 2_048  # different stretches that are sorted together; what is more is cut by content first
SALTS = 32
_MASK = (1 << 64) - 1
LAST_ID = (1 << 63) - 1
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_LEVEL = mix64(np.arange(301, 306, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of each 32-byte gram, by doubling: every byte has a coefficient of its own."""
    h = _BYTE[x]
    for level, s in enumerate((1, 2, 4, 8, 16)):
        h = h[:-s] * _LEVEL[level] + h[s:]
    h ^= h >> np.uint64(29)
    h *= _LEVEL[0]
    h ^= h >> np.uint64(32)
    return h


def _sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        a = op(a[:-done], a[done:])
        done *= 2
    return op(a[: len(a) - (width - done)], a[width - done :]) if width > done else a


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, windows) of each anchor; its windows are consecutive starts."""
    if len(x) < LENGTH:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h = gram_hashes(x)
    low = _sliding(h, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(h == _sliding(np.concatenate([pad, low, pad]), SPAN, np.maximum))
    first = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
    if len(at) != len(first) or not np.array_equal(h[at], low[first]):
        # Equal grams inside a window: each window takes its leftmost smallest gram.
        codes = np.unique(h[at], return_inverse=True)
        size = len(h) + 1
        keys = np.sort(codes[1] * size + at)
        own = keys[np.searchsorted(keys, np.searchsorted(codes[0], low) * size + np.arange(len(low)))] % size
        first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        at = own[first]
    return h[at], at, first, np.diff(np.r_[first, len(low)])


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    w = np.concatenate([x, np.zeros(LENGTH + 16, np.uint8)]).astype(np.uint64)
    for s in (1, 2, 4):
        w = (w[:-s] << np.uint64(8 * s)) | w[s:]
    return w


def suffix_array(x: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of x sorted by their first `depth` bytes at least (those equal so far: in any order).

    Suffixes smaller than their successor are sorted directly, eight bytes a step, on the ties left. The rest
    are induced: going through the buckets of first bytes upward, each sorted suffix puts its predecessor,
    where larger, next into the bucket of the predecessor's byte."""
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    step = np.sign(np.diff(x.astype(np.int16), append=-1))
    known = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    w = _words(x)
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(w[direct], kind="stable")]
    group = np.cumsum(np.r_[0, w[direct[1:]] != w[direct[:-1]]]) if len(direct) else direct
    for d in range(8, depth, 8):
        same = np.r_[False, group[1:] == group[:-1]] if len(group) else np.empty(0, bool)
        tied = np.flatnonzero(same | np.r_[same[1:], False]) if len(group) else direct
        if not len(tied):
            break
        part, owner = direct[tied], group[tied]
        key = w[np.minimum(part + d, len(w) - 1)]
        order = np.lexsort((key, owner))
        direct[tied], key = part[order], key[order]
        fresh = np.r_[False, (key[1:] != key[:-1]) & (owner[1:] == owner[:-1])]
        bump = np.zeros(len(group), np.int64)
        bump[tied[fresh]] = 1
        group = group + np.cumsum(bump)
    heads = x[direct]
    cut = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[x[n - 1]].append(np.array([n - 1]))  # the last suffix precedes all others of its byte
    out = []
    for c in np.unique(x):
        new = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        parts = []
        while len(new):
            parts.append(new)
            before = new[new > 0] - 1
            new = before[(x[before] == c) & ~smaller[before]]
        parts.append(direct[cut[c] : cut[int(c) + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (x[before] > c)]
        byte = x[before]
        order = np.argsort(byte, kind="stable")
        byte, before = byte[order], before[order]
        for piece in np.split(before, np.flatnonzero(byte[1:] != byte[:-1]) + 1):
            if len(piece):
                waiting[x[piece[0]]].append(piece)
    return np.concatenate(out)


def adjacent_common(x: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it, `depth` at most; 0 for the first."""
    w = _words(x)
    common = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for d in range(0, depth, 8):
        a, b = (w[np.minimum(order[i] + d, len(w) - 1)] for i in (open_, open_ - 1))
        differ = a ^ b
        bits = (differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0) if len(differ) else np.zeros((0, 8), bool)
        common[open_] += np.where(differ == 0, 8, bits.argmax(axis=1) if len(bits) else 0)
        open_ = open_[differ == 0]
        if not len(open_):
            break
    return np.minimum(common, depth)


def repeated_windows(owner: np.ndarray, start: np.ndarray, count: np.ndarray, bodies: list[bytes]) -> list[tuple[int, int, int]]:
    """Runs (owner, start, windows) of windows that also start earlier, among the stretches given."""
    sizes = np.array([len(b) + 1 for b in bodies])
    x = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8)
    base = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(bodies)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    window = np.full(len(x), -1, np.int64)
    window[base[which] + inside] = np.arange(len(which))
    order = suffix_array(x)
    order = order[window[order] >= 0]
    group_head = np.flatnonzero(adjacent_common(x, order) < LENGTH)
    rank = np.empty(len(which), np.int64)
    rank[np.lexsort((start[which] + inside, owner[which]))] = np.arange(len(which))
    rank_of = rank[window[order]]
    earliest = np.repeat(np.minimum.reduceat(rank_of, group_head), np.diff(np.r_[group_head, len(order)]))
    hit = np.zeros(len(which), bool)
    hit[window[order]] = rank_of != earliest
    at = np.flatnonzero(hit)
    runs = np.split(at, np.flatnonzero((np.diff(at) != 1) | (which[at[1:]] != which[at[:-1]])) + 1) if len(at) else []
    return [(int(owner[which[r[0]]]), int(start[which[r[0]]] + inside[r[0]]), len(r)) for r in runs]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


ANCHORS = "p long, h long, s long, doc long, tag long, at long, n long, off long, done boolean, several boolean"
_ANCHORS = pa.schema([*((c, pa.int64()) for c in "p h s doc tag at n off".split()), ("done", pa.bool_()), ("several", pa.bool_())])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor and different stretch of a chunk of texts: hash, digest, place, windows, anchor's offset in
    the stretch. p deals rows out: by the hash, or, where the chunk alone has several stretches for it, by hash and
    digest, with one marker for the hash. Repeats inside the chunk leave as finished runs (done), adjacent ones
    joined, under keys that spread them."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = _bytes(row[2].as_py())
            held.append((row[0], row[1], raw))
            size += len(raw)
            if size >= COMBINE_BYTES:
                yield _combined(held)
                held, size = [], 0
    if held:
        yield _combined(held)


def _combined(texts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    texts = sorted(texts, key=lambda t: t[:2])
    found, digests = [], []
    for i, (_, _, raw) in enumerate(texts):
        if i and texts[i - 1][:2] == texts[i][:2]:
            continue  # the same text under the same id
        h, at, first, n = anchors(np.frombuffer(raw, np.uint8))
        found.append((np.full(len(h), i), h, at - first, first, n))
        digests += [xxhash.xxh3_64_intdigest(raw[a : a + m + LENGTH - 1]) for a, m in zip(first.tolist(), n.tolist(), strict=True)]
    own, h, off, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
    s = np.array(digests, np.uint64)
    order = np.lexsort((at, own, s, h))
    own, h, s, at, n, off = (x[order] for x in (own, h, s, at, n, off))
    same_h = np.r_[False, h[1:] == h[:-1]]
    repeat = same_h & np.r_[False, s[1:] == s[:-1]]
    group = np.cumsum(~same_h) - 1
    different = np.bincount(group, ~repeat) if len(h) else np.empty(0)
    several = different[group] >= SEVERAL if len(h) else repeat
    doc, tag = (np.array([t[k] for t in texts], np.int64) for k in (0, 1))
    # Runs of repeats, adjacent ones joined.
    at_r, own_r, n_r = at[repeat], own[repeat], n[repeat]
    order = np.lexsort((at_r, own_r))
    at_r, own_r, n_r = at_r[order], own_r[order], n_r[order]
    head = np.flatnonzero(np.r_[True, (own_r[1:] != own_r[:-1]) | (at_r[1:] != at_r[:-1] + n_r[:-1])]) if len(at_r) else at_r
    n_r = np.add.reduceat(n_r, head) if len(head) else n_r
    at_r, own_r = at_r[head], own_r[head]
    keep = ~repeat
    marks = np.flatnonzero(several & ~same_h)
    zero = lambda x: np.zeros(len(x), np.int64)
    signed = lambda x: x.view(np.int64)
    p = np.where(several[keep], mix64(h[keep] + s[keep]), h[keep])
    spread = mix64(tag[own_r].view(np.uint64) + at_r.astype(np.uint64))
    parts = [
        (signed(p), signed(h[keep]), signed(s[keep]), doc[own[keep]], tag[own[keep]], at[keep], n[keep], off[keep], np.zeros(keep.sum(), bool), several[keep]),
        (signed(h[marks]), signed(h[marks]), *[zero(marks)] * 3, np.full(len(marks), -1), zero(marks), zero(marks), np.zeros(len(marks), bool), np.ones(len(marks), bool)),
        (signed(spread), *[zero(head)] * 2, doc[own_r], tag[own_r], at_r, n_r, zero(head), np.ones(len(head), bool), np.zeros(len(head), bool)),
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t.type) for x, t in zip(zip(*parts, strict=True), _ANCHORS, strict=True)], schema=_ANCHORS)


PACKED = "doc long, tag long, body binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed: they are most of what moves."""
    tight = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            own = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([tight.compress(_bytes(x.as_py())) for x in own.column(2)], pa.binary())], names=["doc", "tag", "body"])


CONTEXTS = "key long, doc long, tag long, start long, n long, off long, body binary"
_CONTEXTS = pa.schema([*((c, pa.int64()) for c in "key doc tag start n off".split()), ("body", pa.binary())])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loose = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for doc, tag, body, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = loose.decompress(body)
            out += [(m["h"], doc, tag, m["at"], m["n"], m["off"], raw[m["at"] : m["at"] + m["n"] + LENGTH - 1]) for m in marks]
            if len(out) > 20_000:
                yield _context_batch(out)
                out = []
        if out:
            yield _context_batch(out)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _CONTEXTS, strict=True)], schema=_CONTEXTS)


def _halves(level: int):
    """Cuts stretches by the offset of the anchor in the window. Windows whose offsets lie in one cell agree on the bytes
    that all windows of the cell hold, so those bytes become part of the key: equal windows stay together."""
    width = -(-SPAN // (1 << level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, doc, tag, start, n, off, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                high = off  # the first window holds the anchor at this offset, the last at off - n + 1
                while high > off - n:
                    cell = high // width
                    low = max(off - n + 1, cell * width)
                    skip, many = off - high, high - low + 1
                    core = body[off - cell * width : off + LENGTH - (cell + 1) * width + 1]
                    out.append((xxhash.xxh3_64_intdigest(core, key & _MASK) - (1 << 63), doc, tag, start + skip, many, high, body[skip : skip + many + LENGTH - 1]))
                    high = low - 1
                if len(out) > 20_000:
                    yield _context_batch(out)
                    out = []
            if out:
                yield _context_batch(out)

    return run


RUNS = "doc long, tag long, start long, n long"
_RUNS = pa.schema([(c, pa.int64()) for c in "doc tag start n".split()])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key; whole groups of a key are gathered up to CHUNK_BYTES."""
    done: list[tuple] = []
    group: list[tuple] = []
    held = 0

    def ready(rows: list[tuple]) -> pa.RecordBatch:
        owners = sorted({r[1:3] for r in rows})
        place = {x: i for i, x in enumerate(owners)}
        runs = repeated_windows(np.array([place[r[1:3]] for r in rows]), *(np.array([r[i] for r in rows], np.int64) for i in (3, 4)), [r[6] for r in rows])
        out = [(*owners[o], a, n) for o, a, n in runs]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], schema=_RUNS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                done += group
                group = []
                if held > CHUNK_BYTES:
                    yield ready(done)
                    done, held = [], 0
            group.append(row)
            held += len(row[6])
    if done or group:
        yield ready(done + group)


CUT = "doc long, tag long, n_removed long, n_spans long, kept_sha256 string"


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loose = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {x.split()[0]: [] for x in CUT.split(", ")}
        for doc, tag, body, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            raw = np.frombuffer(loose.decompress(body.as_py()), np.uint8)
            spans = removed_spans([(r["start"], r["n"]) for r in runs.as_py()])
            keep = np.ones(len(raw), bool)
            for a, b in spans:
                keep[a:b] = False
            for name, value in zip(out, (doc, tag, sum(b - a for a, b in spans), len(spans), hashlib.sha256(raw[keep].tobytes()).hexdigest()), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()], names=list(out))


def removed_spans(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte spans [a, b) covered by runs (first window, windows)."""
    out: list[list[int]] = []
    for start, n in sorted(runs):
        end = start + n - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


class RepeatedPassages:
    """meta: (doc_id, doc, tag, sha, n_bytes, copy) for each input row. runs: (doc, tag, start, n) repeated windows of
    the documents that are no whole copies. (doc, tag) names an id's text and orders the texts: tag is a hash of 62
    bits, above which rows without an id come."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP):
        self.scratch = scratch = Scratch(docs.sparkSession, "passages")
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        known = F.col(id_col).cast("long")
        tag = F.shiftrightunsigned(F.xxhash64(text), 2) + F.when(known.isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
        docs = docs.select(known.alias("doc_id"), F.coalesce(known, F.lit(LAST_ID)).alias("doc"), tag.alias("tag"), text.alias("text"))
        meta = scratch.keep(docs.select("doc_id", "doc", "tag", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "rows")
        # Written first: a join with a grouped table in its own stage cannot be split where one text has most rows.
        first = scratch.keep(meta.groupBy("sha").agg(F.min(F.struct("doc", "tag")).alias("first")), "first")
        self.meta = scratch.keep(meta.join(first, "sha").withColumn("copy", F.struct("doc", "tag") > F.col("first")).drop("first"), "meta")
        self.docs = docs.where(F.octet_length("text") >= LENGTH).select("doc", "tag", "text")

        # 1. Anchors that occur more than once: equal stretches are settled, different ones go on.
        rows = self.docs.mapInArrow(_anchor_rows, ANCHORS)
        every = Window.partitionBy("p")
        rows = rows.withColumn("before", F.lag(F.struct("h", "s", "doc", "tag", "at")).over(every.orderBy("h", "s", "doc", "tag", "at")))
        rows = rows.withColumn("several", F.bool_or("several").over(every) | (F.min("s").over(every) != F.max("s").over(every)))
        again = (F.col("before.h") == F.col("h")) & (F.col("before.s") == F.col("s")) & (F.col("before.at") >= 0)
        same = again & (F.col("before.doc") == F.col("doc")) & (F.col("before.tag") == F.col("tag")) & (F.col("before.at") == F.col("at"))
        rows = rows.withColumn("repeat", F.col("done") | F.coalesce(again, F.lit(False))).where((F.col("at") >= 0) & (F.col("done") | ~F.coalesce(same, F.lit(False))))
        rows = scratch.keep(rows.where("repeat or several").select("h", "doc", "tag", "at", "n", "off", "repeat"), "anchors")
        self.whole = rows.where("repeat").select("doc", "tag", F.col("at").alias("start"), "n")

        # 2. The different stretches of one anchor, with their bytes.
        marks = rows.where("not repeat").groupBy("doc", "tag").agg(F.collect_set(F.struct("h", "at", "n", "off")).alias("marks"))
        held = self.docs.mapInArrow(_pack, PACKED).join(marks, ["doc", "tag"]).dropDuplicates(["doc", "tag"])
        contexts = scratch.keep(held.select("doc", "tag", "body", "marks").mapInArrow(_context_rows, CONTEXTS), "contexts")
        runs = [self.whole, *self._settle(contexts, group)]
        self.runs = scratch.keep(reduce(DataFrame.union, runs), "runs")
        scratch.drop("rows", "anchors", "contexts", *self.temporary)

    def _settle(self, contexts: DataFrame, group: int) -> Iterator[DataFrame]:
        """Suffix-sorts the stretches of each key. A key with more than `group` of them is cut by what they hold,
        equal parts fold into their earliest (a grouped minimum), and the rest are looked at again; cells narrow to
        one window, so this ends."""
        self.temporary: list[str] = []
        for level in range(1, SPAN.bit_length() + 2):
            crowds = contexts.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > group)
            crowds = self.scratch.keep(crowds.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), f"crowds-{level}")
            self.temporary.append(f"crowds-{level}")
            crowded = not crowds.isEmpty()
            contexts = contexts.withColumn("salt", F.pmod(F.xxhash64("doc", "tag", "start"), F.lit(SALTS)))  # a crowd is many rows of one key
            cold = (contexts.join(crowds, ["key", "salt"], "left_anti") if crowded else contexts)
            yield cold.select(*_CONTEXTS.names).repartition("key").sortWithinPartitions("key").mapInArrow(_sort_groups, RUNS)
            if not crowded:
                return
            cut = contexts.join(crowds, ["key", "salt"], "left_semi").select(*_CONTEXTS.names).mapInArrow(_halves(level), CONTEXTS)
            cut = self.scratch.keep(cut.withColumn("d", F.xxhash64("body")), f"cut-{level}")
            first = self.scratch.keep(cut.groupBy("key", "d").agg(F.min(F.struct("doc", "tag", "start")).alias("first")), f"first-{level}")
            cut = cut.join(first, ["key", "d"]).withColumn("repeat", F.struct("doc", "tag", "start") != F.col("first"))
            cut = self.scratch.keep(cut.drop("d", "first"), f"level-{level}")
            self.temporary += [f"cut-{level}", f"first-{level}", f"level-{level}"]
            yield cut.where("repeat").select("doc", "tag", "start", "n")
            contexts = cut.where("not repeat").drop("repeat")

    def summary(self) -> DataFrame:
        runs = self.runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        alone = self.meta.where("not copy").select("doc", "tag").distinct()
        runs = runs.join(alone, ["doc", "tag"], "left_semi")
        cut = self.docs.mapInArrow(_pack, PACKED).join(runs, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).mapInArrow(_cut_rows, CUT)
        out = self.meta.join(cut, ["doc", "tag"], "left")
        gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
        return out.select(
            "doc_id", "n_bytes",
            F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )


def remove_repeated_passages(docs: DataFrame, **columns) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a 100-byte string that covers it also starts earlier: in a smaller doc_id, or before in the
    same document. Null text counts as empty. Null ids come after all ids. Rows that repeat an id with the same
    text are one document and get the same result; with different texts they are judged in the order of a text
    hash of 62 bits. Texts under 100 bytes stay whole. An empty table gives no rows. Other columns are ignored.
    """
    return RepeatedPassages(docs, **columns).summary()
