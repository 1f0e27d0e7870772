"""Benchmark decontamination by latent semantic retrieval.

TF-IDF rows of all corpus passages and of the benchmark's own give a term matrix A. A distributed randomised SVD
(range finder, one power step, small SVD) reduces it: only sums over terms move. Sliding windows of every document are
projected and compared with all benchmark passages by cosine; near-verbatim copies are also met by shared word
triples, whatever the rank or the benchmark's size. Candidates are confirmed by their longest common word subsequence
and by whether the passage's answer (its item's last sentence) is there too. Texts are read once for each block of
passages, into the codes of the words that the block knows; the later passes read those where they lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64

PASSAGE_WORDS = 64
STEPS = (5, 7)  # windows are four steps wide and start at each step
LEVELS = 3  # each level doubles the steps: windows of 20, 28, 40, 56, 80 and 112 words
RANK = 128
EXTRA = 16  # columns beyond the rank (oversampling)
FIT_PASSAGES = 64  # passages that a task multiplies at a time
COSINE = 0.35
COMMON = 0.01  # least weight of a word, as a share of the median
SHORT = 5  # passages of fewer words are looked for word for word
SUBSEQUENCE = 0.6
SURE = 0.85
ANSWER = 0.5
BLOCK_PASSAGES = 1000  # benchmark passages of one scan: bounds the vocabulary, the basis and the index
STRETCH_CHARS = 200_000  # a longer text is cut into words a stretch at a time
SEARCH_WORDS = 16_384  # words that are projected at a time
_PLAIN = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in range(256))
_GAP = re.compile(r"[\x00-\x2f:-@\[-`{-\x7f]")
_WIDE = 4 * STEPS[-1] << LEVELS - 1
_MULTIPLY = mix64(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and other non-ASCII signs."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word of `a` at a time (bit-parallel)."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := where.get(w):
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(a) - row.bit_count()


def passages_of(text: str | None) -> list[tuple[list[bytes], list[bytes]]]:
    """(words, answer words) of each passage. A text of more than 64 words is cut into parts of nearly equal length. The
    answer is the item's last sentence, or the last quarter of the words when that is longer, and belongs to the last
    part; other parts take their own last quarter."""
    words = words_of(text)
    tail = words_of(re.split(r"[.!?\n]+", (text or "").strip().rstrip(".!?"))[-1])
    n = -(-len(words) // PASSAGE_WORDS)
    cut = [len(words) * i // n for i in range(n + 1)] if n else []
    out = []
    for a, b in zip(cut, cut[1:]):
        part = words[a:b]
        quarter = part[-max(1, len(part) // 4) :]
        out.append((part, tail if b == len(words) and len(quarter) < len(tail) <= len(part) else quarter))
    return out


def stretches(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch at a time."""
    text, at = text or "", 0
    while True:
        end = len(text)
        if end - at > STRETCH_CHARS and (m := _GAP.search(text, at + STRETCH_CHARS)):
            end = m.end()
        yield words_of(text[at:end])
        if end == len(text):
            return
        at = end


CODED = "doc_id long, h long, codes binary"


class Fit:
    """Codes of the words of a block of benchmark passages: 1 and up; 0 stands for all other words."""

    def __init__(self, passages: list[tuple[int, list[bytes], list[bytes]]]):
        self.code = {w: c for c, w in enumerate(dict.fromkeys(w for _, words, _ in passages for w in words), 1)}
        self.kind = np.uint16 if len(self.code) < 1 << 16 else np.uint32
        self.coded = [self.codes(words).astype(np.int64) for _, words, _ in passages]

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.code.get, words, repeat(0)), self.kind, len(words))

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                body = [tight.compress(np.concatenate([self.codes(x) for x in stretches(text.as_py())]).tobytes()) for text in own.column(2)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(body, pa.binary())], names=["doc_id", "h", "codes"])

    def decode(self, column: pa.Array) -> list[np.ndarray]:
        loose = zstandard.ZstdDecompressor()
        return [np.frombuffer(loose.decompress(x), self.kind) for x in column.to_pylist()]

    def frequencies(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(code, documents that hold it) of a task; -1: documents, -2: words."""
        count, rows, length = np.zeros(len(self.code) + 1, np.int64), 0, 0
        for batch in batches:
            for codes in self.decode(batch.column(0)):
                count[np.unique(codes)] += 1
                rows += 1
                length += len(codes)
        at = np.flatnonzero(count[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[length, rows, count[at]])], names=["c", "n"])


def weights(counts: dict[int, int], n: int) -> np.ndarray:
    """Inverse document frequencies over all documents, by code. Every word weighs something, however common it is."""
    df = np.array([counts.get(c, 0) for c in range(1, n + 1)], float)
    idf = np.log((1 + counts.get(-1, 0)) / (1 + df))
    middle = float(np.median(idf)) if n else 1.0
    return np.r_[0.0, np.maximum(idf, COMMON * (middle or 1.0))]


def products(passages: list[np.ndarray], idf: np.ndarray, x: np.ndarray, out: np.ndarray, scale: float = 1.0) -> None:
    """Adds A'(A x) of some passages, unit rows of TF-IDF, to `out`."""
    own, at = np.unique(np.concatenate(passages), return_inverse=True)
    row = np.repeat(np.arange(len(passages)), [len(c) for c in passages])
    a = np.bincount(row * len(own) + at, minlength=len(passages) * len(own)).reshape(len(passages), len(own)) * idf[own]
    a = (a / np.maximum(np.sqrt((a**2).sum(axis=1)), 1e-9)[:, None]).astype(np.float32)
    out[own] += np.float32(scale) * (a.T @ (a @ x[own]))


def corpus_products(coded: DataFrame, fit: Fit, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x) over the passages of all documents: tasks sum, then terms meet their sums."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast((fit, idf, x))  # bounded by BLOCK_PASSAGES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, idf, x = shared.value
        out, waiting = np.zeros_like(x), []
        for batch in batches:
            for codes in fit.decode(batch.column(0)):
                waiting += [c for i in range(0, len(codes), PASSAGE_WORDS) if len(c := (y := codes[i : i + PASSAGE_WORDS])[y > 0])]
                while len(waiting) >= FIT_PASSAGES:
                    products(waiting[:FIT_PASSAGES], idf, x, out)
                    del waiting[:FIT_PASSAGES]
        if waiting:
            products(waiting, idf, x, out)
        at = np.flatnonzero(np.abs(out).sum(axis=1))
        for i in range(0, len(at), 2000):
            part = at[i : i + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([out[c].tobytes() for c in part], pa.binary())], names=["c", "z"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(z.as_py(), np.float32)
                sums[c] = sums[c] + row if c in sums else row.astype(float)
        at = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([sums[c].astype(np.float32).tobytes() for c in at], pa.binary())], names=["c", "z"])

    out = np.zeros_like(x)
    for row in coded.select("codes").mapInArrow(task, "c long, z binary").repartition("c").mapInArrow(total, "c long, z binary").toLocalIterator():
        out[row["c"]] = np.frombuffer(row["z"], np.float32)
    return out


def randomised_svd(apply, terms: int, rank: int = RANK, extra: int = EXTRA) -> np.ndarray:
    """Leading right singular vectors (terms x rank at most) of the A whose A'(A x) `apply` gives. The range finder
    draws rank + extra random columns; a power step sharpens them; the small SVD of the result orders them."""
    wide = min(rank + extra, terms)
    if not terms:
        return np.zeros((0, 1), np.float32)
    at = np.arange(terms, dtype=np.uint64)[:, None] * np.uint64(4096) + np.arange(wide, dtype=np.uint64)
    random = ((mix64(at + np.uint64(1)) >> np.uint64(40)).astype(np.float32) / 2**23 - 1).astype(np.float32)
    found = np.linalg.qr(apply(random).astype(float))[0]
    left, size, _ = np.linalg.svd(apply(found.astype(np.float32)).astype(float), full_matrices=False)
    return left[:, size > 1e-7 * max(size[0], 1e-30)][:, :rank].astype(np.float32)


class Index:
    """A block of benchmark passages, projected, with their word triples."""

    def __init__(self, passages: list[tuple[int, list[bytes], list[bytes]]], fit: Fit, idf: np.ndarray, basis: np.ndarray):
        self.items = [i for i, _, _ in passages]
        self.fit, self.passages, self.answers = fit, [c.tolist() for c in fit.coded], [fit.codes(a).tolist() for _, _, a in passages]
        self.size = np.array([len(c) for c in fit.coded], np.int64)
        self.counts = [Counter(c) for c in self.passages]
        self.least = np.array([next(t for t in range(1, n + 1) if t / n >= SUBSEQUENCE) if n >= SHORT else n for n in self.size.tolist()], np.int64)
        self.times = np.zeros((len(passages), len(fit.code) + 1), np.uint8)  # how often a passage has a word: PASSAGE_WORDS at most
        for j, c in enumerate(fit.coded):
            np.add.at(self.times[j], c, 1)
        self.rows = (idf[:, None] * basis).astype(np.float32)  # by code; that of 0 is zero
        vectors = np.array([self.rows[c].sum(axis=0) for c in fit.coded], np.float32).reshape(-1, self.rows.shape[1])
        self.vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1)), 1e-9)[:, None]
        steps = sorted((base << level, base, level) for base in STEPS for level in range(LEVELS))
        # A passage belongs to the narrowest windows of which it fills three quarters at most.
        self.step = np.array([next(s for s, _, _ in steps if n <= 3 * s) for n in self.size.tolist()], np.int64)
        self.kinds = [(s, base, level, np.flatnonzero((self.step == s) & (self.size >= SHORT))) for s, base, level in steps]
        self.short: dict[int, list[int]] = {}
        for j in np.flatnonzero(self.size < SHORT).tolist():
            self.short.setdefault(self.passages[j][0], []).append(j)
        owner = [np.full(max(0, len(c) - 2), j) for j, c in enumerate(fit.coded) if len(c) >= SHORT]
        keys = np.concatenate([self.triples(c) for c in fit.coded if len(c) >= SHORT] or [np.empty(0, np.uint64)])
        owner = np.concatenate(owner or [np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.start = np.unique(keys[order], return_index=True)
        self.start, self.owner = np.append(self.start, len(keys)), owner[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def triples(codes: np.ndarray) -> np.ndarray:
        """Keys of the word triples that start at each place but the last two."""
        c = codes.astype(np.uint64)
        return mix64(c[:-2] * _MULTIPLY[0] + c[1:-1] * _MULTIPLY[1] + c[2:] * _MULTIPLY[2]) if len(c) > 2 else np.empty(0, np.uint64)

    def hits(self, coded: list[np.ndarray]) -> list[dict[int, float]]:
        """For each text's codes: item -> best share of a passage's words found in order, of the passages it holds."""
        out: list[dict[int, float]] = [{} for _ in coded]
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, codes in enumerate(coded if self.items else ()):
            for at in range(0, max(1, len(codes)), SEARCH_WORDS):  # pieces of a long text overlap by two windows
                held.append((i, codes[max(0, at - 2 * _WIDE) : at + SEARCH_WORDS]))
                size += len(held[-1][1])
                if size >= SEARCH_WORDS:
                    self._search(held, out)
                    held, size = [], 0
        if held:
            self._search(held, out)
        return out

    def _search(self, held: list[tuple[int, np.ndarray]], out: list[dict[int, float]]) -> None:
        pieces = [c for _, c in held]
        done: dict[tuple[int, int], set[int]] = {}

        def look(k: int, j: int, begin: int) -> None:
            """Confirms passage j in the six steps of piece k from `begin` on."""
            begin = max(0, begin)
            seen = done.setdefault((k, j), set())
            if begin in seen:
                return
            seen.add(begin)
            found, item = out[held[k][0]], self.items[j]
            if found.get(item, 0.0) < 1.0:
                share = self.share(j, pieces[k][begin : begin + 6 * int(self.step[j])].tolist())
                if share > found.get(item, 0.0):
                    found[item] = share

        for k, j, place in self._near_verbatim(pieces):
            step = int(self.step[j])
            for b in (place // step - 1, place // step - 2):
                look(k, j, b * step)
        for k, j, b in self._similar(pieces):
            look(k, j, (b - 1) * int(self.step[j]))
        if self.short:
            for k, codes in enumerate(pieces):
                row = codes.tolist()
                for at in np.flatnonzero(np.isin(codes, list(self.short))).tolist():
                    for j in self.short[row[at]]:
                        if row[at : at + len(self.passages[j])] == self.passages[j]:
                            out[held[k][0]][self.items[j]] = 1.0

    def share(self, j: int, region: list[int]) -> float:
        """Share of passage j's words that the region has in order, if that and the answer suffice; else 0."""
        count = self.counts[j]
        if sum(map(count.__getitem__, count.keys() & region)) < self.least[j]:
            return 0.0
        share = common_subsequence(self.passages[j], region) / len(self.passages[j])
        good = share >= SURE or share >= SUBSEQUENCE and common_subsequence(self.answers[j], region) >= ANSWER * len(self.answers[j])
        return share if good else 0.0

    def _near_verbatim(self, pieces: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(piece, passage, place) where a third of a passage's word triples lie close together."""
        flat = np.concatenate([np.r_[c, 0, 0] for c in pieces])
        piece = np.repeat(np.arange(len(pieces)), [len(c) + 2 for c in pieces])
        first = np.cumsum([0, *[len(c) + 2 for c in pieces]])
        keys = self.triples(flat)
        at = np.flatnonzero(self.sieve[(keys >> np.uint64(44)).astype(np.int64)] & (flat[:-2] > 0) & (flat[1:-1] > 0) & (flat[2:] > 0)) if len(self.keys) else np.empty(0, np.int64)
        which = np.searchsorted(self.keys, keys[at])
        real = self.keys[np.minimum(which, len(self.keys) - 1)] == keys[at] if len(at) else np.empty(0, bool)
        at, which = at[real], which[real]
        many = self.start[which + 1] - self.start[which]
        place = np.repeat(self.start[which] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(at) else at
        n = len(flat)
        owner, at = np.divmod(np.unique(self.owner[place] * n + np.repeat(at, many)), n)
        last = np.arange(len(owner)) + np.maximum(1, (self.size[owner] - 2) // 3) - 1
        some = np.flatnonzero(last < len(owner))
        some = some[(owner[last[some]] == owner[some]) & (piece[at[last[some]]] == piece[at[some]]) & (at[last[some]] - at[some] <= 4 * self.step[owner[some]])]
        for j, x in zip(owner[some].tolist(), at[some].tolist(), strict=True):
            yield int(piece[x]), j, x - int(first[piece[x]])

    def _similar(self, pieces: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(piece, passage, step) of windows whose cosine with a passage suffices."""
        size = np.array([len(c) for c in pieces], np.int64)
        for base in STEPS:
            kinds = [k for k in self.kinds if k[1] == base and len(k[3])]
            if not kinds:
                continue
            top = 4 << LEVELS - 1  # each piece has four whole steps at least on every level
            blocks = np.maximum(top, -(-size // (base * 4)) * 4)
            first = np.cumsum(np.r_[0, blocks])
            flat = np.zeros(first[-1] * base, self.fit.kind)
            for c, f in zip(pieces, first.tolist(), strict=False):
                flat[f * base : f * base + len(c)] = c
            flat = flat.reshape(-1, base)
            sums = np.empty((len(flat), self.rows.shape[1]), np.float32)
            for i in range(0, len(flat), 512):
                part = flat[i : i + 512]
                row = self.rows[part[:, 0]]
                for k in range(1, base):
                    row += self.rows[part[:, k]]
                sums[i : i + 512] = row
            for level in range(LEVELS):
                if level:
                    sums = sums[::2] + sums[1::2]
                for step, _, _, own in (k for k in kinds if k[2] == level):
                    windows = sums[:-3] + sums[1:-2]
                    windows += sums[2:-1]
                    windows += sums[3:]
                    norm = np.sqrt(np.einsum("ij,ij->i", windows, windows))
                    b, j = np.nonzero(windows @ self.vectors[own].T >= np.maximum(COSINE * norm, 1e-9)[:, None])
                    begin = first >> level
                    piece = np.searchsorted(begin, b, side="right") - 1
                    good = b - begin[piece] <= np.maximum(0, -(-size[piece] // step) - 4)
                    piece, j, b = piece[good], own[j[good]], b[good]
                    good = self._enough(flat.reshape(-1, step), begin[piece], begin[piece + 1], j, b)
                    yield from zip(piece[good].tolist(), j[good].tolist(), (b - begin[piece])[good].tolist(), strict=True)

    def _enough(self, steps: np.ndarray, begin: np.ndarray, end: np.ndarray, j: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the six steps around window b hold as many words of passage j as a subsequence needs: first counting
        each place, then, in the six steps that are looked at, each word as often as the passage has it."""
        out = np.zeros(len(b), bool)
        flat = self.times.reshape(-1)

        def words(own: np.ndarray, first: np.ndarray) -> np.ndarray:
            at = first[:, None] + np.arange(6)
            found = steps.take(np.minimum(at, len(steps) - 1).clip(0), axis=0)
            found[(at < begin[own, None]) | (at >= end[own, None])] = 0
            return found.reshape(len(own), 6 * steps.shape[1])

        for i in range(0, len(b), 2048):
            own = np.arange(i, min(i + 2048, len(b)))
            row = j[own, None] * self.times.shape[1]
            near = (flat.take(words(own, b[own] - 1) + row) > 0).sum(axis=1, dtype=np.int32) >= self.least[j[own]]
            own, row = own[near], row[near]
            held = np.sort(words(own, np.maximum(b[own] - 1, begin[own])), axis=1)
            times = flat.take(held + row)
            times[:, 1:][held[:, 1:] == held[:, :-1]] = 0
            out[own] = times.sum(axis=1, dtype=np.int32) >= self.least[j[own]]
        return out


PASSAGES = "item long, part long, words array<binary>, answer array<binary>"
RESULT = "doc_id long, h long, item_ids array<long>, best double"


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, w, a) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (w, a) in enumerate(passages_of(text))]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["item", "part", "words", "answer"])


def build_index(docs: DataFrame, passages: list[tuple[int, list[bytes], list[bytes]]], rank: int, scratch: Scratch, name: str = "coded") -> tuple[DataFrame, Index]:
    """Codes of all documents (doc_id, h, text), written once, and the index of a block of benchmark passages, with
    weights and basis fitted on all of them."""
    fit = Fit(passages)
    shared = docs.sparkSession.sparkContext.broadcast(fit)
    coded = scratch.keep(docs.select("doc_id", "h", "text").mapInArrow(lambda batches: shared.value.encode(batches), CODED), name)
    counted = coded.select("codes").mapInArrow(lambda batches: shared.value.frequencies(batches), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    counts = {r["c"]: r["n"] for r in counted.collect()} if fit.code else {}  # a row for each word of the block
    idf = weights(counts, len(fit.code))
    # The benchmark's own passages weigh as much in all as the corpus, so that the basis can tell them apart.
    own = max(1.0, counts.get(-2, 0) / PASSAGE_WORDS / max(1, len(passages)))

    def apply(x: np.ndarray) -> np.ndarray:
        out = corpus_products(coded, fit, idf, x)
        for i in range(0, len(fit.coded), FIT_PASSAGES):
            products(fit.coded[i : i + FIT_PASSAGES], idf, x, out, own)
        return out

    basis = randomised_svd(apply, len(fit.code) + 1 if fit.code else 0, rank)
    return coded, Index(passages, fit, idf, basis if fit.code else np.zeros((1, 1), np.float32))


def find_contamination(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_passages: int = BLOCK_PASSAGES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, h (hash of the text), item_ids (benchmark items it holds,
    ascending), best, contaminated.

    A document holds an item when, in some window, at least 60 % of a passage's words occur in order and half of
    its answer does too, or 85 % of the words do. Passages of fewer than five words are found word for word. Null or
    empty texts hold nothing; items without words or id are never found. Null ids and repeated rows stay as they
    come; other columns are ignored, whatever their names. Weights and basis are fitted on the benchmark and all
    documents. Benchmarks beyond `block_passages` passages are taken in blocks, one after the other: what a task or
    the driver holds does not grow with the benchmark. Empty tables: no rows, or nothing contaminated.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    scratch = Scratch(spark, "decontaminate")
    passages = scratch.keep(items.mapInArrow(_passage_rows, PASSAGES), "passages")
    blocks = -(-passages.count() // block_passages) or 1

    def scan(block: int) -> DataFrame:
        part = passages.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == block).orderBy("item", "part", "words").collect()
        coded, built = build_index(rows, [(r["item"], [bytes(w) for w in r["words"]], [bytes(w) for w in r["answer"]]) for r in part], rank, scratch, f"coded-{block}")
        index = spark.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    own = batch.slice(at, 512)
                    found = index.value.hits(index.value.fit.decode(own.column(2)))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([sorted(x) for x in found], pa.list_(pa.int64())), pa.array([max(x.values(), default=0.0) for x in found])], names=["doc_id", "h", "item_ids", "best"])

        return coded.mapInArrow(run, RESULT)

    if blocks == 1:
        out = scan(0)
    else:
        found = None
        for b in range(blocks):
            part = scratch.keep(scan(b).where(F.size("item_ids") > 0), f"block-{b}")
            scratch.drop(f"coded-{b}")
            found = part if found is None else found.union(part)
        # Rows that agree in id and text agree in what they hold.
        found = found.groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("best").alias("best")).toDF("k_id", "k_h", "item_ids", "best")
        keyed = rows.select("doc_id", "h")
        none = F.array().cast("array<long>")
        out = keyed.join(found, keyed["doc_id"].eqNullSafe(found["k_id"]) & (keyed["h"] == found["k_h"]), "left").select("doc_id", "h", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("best", F.lit(0.0)).alias("best"))
    return out.withColumn("contaminated", F.size("item_ids") > 0)
