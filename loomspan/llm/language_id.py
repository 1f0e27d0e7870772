"""Language identification: multinomial naive Bayes over hashed character n-grams.

Tasks count the n-grams of the labelled documents into a matrix of languages and hash buckets; Spark sums the matrices.
The log-probabilities are broadcast, a block of languages at a time so that their size is bounded, and a batch of texts
is scored in numpy: its n-grams are looked up in the matrix and summed along each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch

BITS = 16
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)  # characters of an n-gram
SMOOTHING = 0.5  # added to every bucket's count
LANG_BLOCK = 64  # languages whose log-probabilities are broadcast at once
SLICE = 1 << 16  # characters that are scored at once
UNKNOWN = "und"
_ODD = np.uint64(0x5851F42D4C957F2D)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a space for each run of others than letters, and at both ends; empty
    without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    kept = np.full(len(points) + 2, 32, np.uint32)
    kept[1:-1][letter] = points[letter]
    space = kept == 32
    return kept[~space | np.r_[True, ~space[:-1]]]


def _pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Slices of a long text; a slice ends with a space, with which the next begins, unless a word fills it."""
    at = 0
    while len(points) - at > SLICE:
        spaces = np.flatnonzero(points[at + 1 : at + SLICE] == 32)
        end = at + 1 + int(spaces[-1]) if len(spaces) else at + SLICE - 1
        yield points[at : end + 1]
        at = end
    if len(points):
        yield points[at:]


def slices(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, starts of the pieces, text of each piece): texts side by side, about SLICE characters at a time."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for part in ((i, piece) for i, points in enumerate(texts) for piece in _pieces(points)):
        if held and size + len(part[1]) > SLICE:
            yield _joined(held)
            held, size = [], 0
        held.append(part)
        size += len(part[1])
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, p in held])
    return np.concatenate([p for _, p in held]), np.cumsum(sizes) - sizes, np.array([i for i, _ in held])


def grams(points: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram that begins at each character; BUCKETS where it would cross a piece's end."""
    wide = points.astype(np.uint64)
    key = wide
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            key = key[:-1] * _ODD + wide[n - 1 :]
        out = np.full(len(wide), BUCKETS, np.int64)
        out[: len(key)] = (key * GOLDEN) >> np.uint64(64 - BITS)
        for back in range(1, n):
            out[starts[1:] - back] = BUCKETS
        if n in GRAMS:
            yield out
        if len(key) < 2:
            return


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of each language and bucket, and its documents as bucket -1, summed over the task; handed on when many
    languages have come."""
    held: dict[str, np.ndarray] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    for batch in batches:
        own: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own.setdefault(lang, []).append(characters(text.as_py()))
        for lang, texts in own.items():
            if lang not in held and len(held) >= LANG_BLOCK:
                yield from hand_on()
                held.clear()
            counts = held.setdefault(lang, np.zeros(BUCKETS + 2, np.int64))
            counts[0] += len(texts)
            for points, starts, _ in slices(texts):
                for bucket in grams(points, starts):
                    counts[1:] += np.bincount(bucket, minlength=BUCKETS + 1)
    yield from hand_on()


def _log_probabilities(counts: pa.Table, langs: list[str], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets x languages, prior) of a block of languages; a last row of zeros for n-grams that cross."""
    at = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((BUCKETS + 1, len(langs)))
    np.add.at(n, (counts.column("bucket").to_numpy() + 1, np.fromiter((at[x] for x in counts.column("lang").to_pylist()), np.int64, counts.num_rows)), counts.column("n").to_numpy())
    table = np.log((n[1:] + SMOOTHING) / (n[1:].sum(axis=0) + SMOOTHING * BUCKETS))
    return np.vstack([table, np.zeros(len(langs))]), np.log(n[0] / docs)


def score_texts(texts: list[np.ndarray], table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log-likelihood and prior of every language for each of the texts' characters."""
    out = np.tile(prior, (len(texts), 1))
    for points, starts, text in slices(texts):
        found = sum(table[bucket] for bucket in grams(points, starts))
        np.add.at(out, text, np.add.reduceat(found, starts, axis=0))
    return out


def _scorer(model, langs: list[str]):
    """Takes the best language of a block into (lang_pred, best, total), whose total is the sum of likelihoods over the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, prior = model.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            points = [characters(x) if x is not None else np.empty(0, np.uint32) for x in texts]
            logits = score_texts(points, table, prior)
            best, top = logits.argmax(axis=1), logits.max(axis=1)
            total = np.exp(logits - top[:, None]).sum(axis=1)
            pred, held, so_far = (batch.column(c).to_pylist() for c in ("lang_pred", "best", "total"))
            for i, x in enumerate(points):
                if len(x):
                    new = pred[i] is None or top[i] > held[i]
                    high = top[i] if new else held[i]
                    so_far[i] = float((so_far[i] * np.exp(held[i] - high) if pred[i] is not None else 0.0) + total[i] * np.exp(top[i] - high))
                    pred[i], held[i] = (langs[best[i]] if new else pred[i]), float(high)
            kept = [batch.column(c) for c in ("doc_id", "held_out", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(held, pa.float64()), pa.array(so_far, pa.float64())], names=["doc_id", "held_out", "text", "lang_pred", "best", "total"])

    return run


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lang_block: int = LANG_BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of every text, and its posterior.

    Languages are learned from the texts and non-null languages of the documents that are not held out, by the crc32 of
    their id; nothing but the text goes into a prediction. A null text, one without a letter, and every text where no
    language could be learned give `und` and 0. Documents with a null id are not held out, nor learned from. Equal
    likelihoods take the language of the smallest name. Empty texts teach only how common a language is. Repeated rows
    count and are judged each. Very long texts are read whole, in bounded slices. An empty table gives no rows. Other
    columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "language")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    taught = rows.where("doc_id is not null and not held_out and lang is not null and text is not null").select("lang", "text")
    counts = scratch.keep(taught.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    size = counts.where("bucket = -1")
    docs_in_all, many = size.agg(F.sum("n"), F.count("*")).first()
    x = rows.select("doc_id", "held_out", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(0.0).alias("total"))
    last = None
    for _ in range(-(-many // lang_block)):
        # A block of languages in the order of their names, and their counts: bounded by languages times buckets.
        block = size.select("lang") if last is None else size.where(F.col("lang") > last).select("lang")
        langs = [r.lang for r in block.orderBy("lang").limit(lang_block).collect()]
        last = langs[-1]
        model = _log_probabilities(counts.where(F.col("lang").isin(langs)).toArrow(), langs, docs_in_all)
        x = x.mapInArrow(_scorer(spark.sparkContext.broadcast(model), langs), x.schema)
    return x.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.least(1 / F.col("total"), F.lit(1.0))).alias("score"))
