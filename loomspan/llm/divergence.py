"""Audit of how far the sources of a language diverge, in whole numbers.

Tasks count the terms of their documents into bounded tables; the sums give each language its kept terms and each
(language, source) group its counts. Kept terms are dealt into blocks and groups into bands; a tile holds the smoothed
shares of two bands' groups for a block's terms as dense int64 matrices, and numpy broadcasts all pairs of their rows
against each other. Tiles yield partial pair matrices, which are summed, and a heap of the first terms of each group,
which are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
HELD = 400_000  # terms that a task counts before it hands them on
DOC, DOCS = 1 << 40, 1 << 20  # a term's entry holds occurrences + DOC * documents, of DOCS documents at most
PIECE = 1 << 22  # bytes of a text that are counted at once
BLOCK_TERMS = 2048
BAND = 64  # groups in a band
TILE_CELLS = 1 << 20  # cells of a broadcast product
#: Every byte of a term as it is counted: A-Z lower-cased, a-z and all bytes beyond ASCII kept, any other a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
TILED = "lang string, source string, part string, item string, value long"


def _terms(text: pa.Scalar) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece of it at a time; pieces end between terms."""
    view, at, tail = memoryview(text.as_buffer()), 0, b""
    while at < len(view):
        piece = tail + bytes(view[at : at + PIECE]).translate(LETTERS)
        at += PIECE
        end = len(piece) if at >= len(view) else piece.rfind(b" ") + 1
        tail = piece[end:]
        yield piece[:end].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of the task, handed on whenever the table is full. A row
    with a null term names a group."""
    held: dict[tuple[str, str], dict[bytes | None, int]] = {}
    size = docs = 0
    for batch in batches:
        text = batch.column(2).cast(pa.binary())
        for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            found: Counter[bytes] = Counter()
            for words in _terms(text[i]):
                found.update(words)
            own = held.setdefault(group, {None: 0})
            size -= len(own)
            get = own.get
            for term, n in found.items():
                own[term] = get(term, 0) + n + DOC
            size, docs = size + len(own), docs + 1
            if size >= HELD or docs >= DOCS:
                yield _table(held)
                held, size, docs = {}, 0, 0
    if held:
        yield _table(held)


def _table(held: dict[tuple[str, str], dict[bytes | None, int]]) -> pa.RecordBatch:
    sizes = [len(x) for x in held.values()]
    named = lambda at: pa.array([g[at] for g in held], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    terms = pa.array([t for x in held.values() for t in x], pa.binary()).cast(pa.string(), safe=False)
    both = np.fromiter((v for x in held.values() for v in x.values()), np.int64, sum(sizes))
    return pa.RecordBatch.from_arrays([named(0), named(1), terms, pa.array(both % DOC), pa.array(both // DOC)], names=["lang", "source", "term", "n", "docs"])


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / total) for 0 < n <= total, exact while total is below 2^53: long division by thousands."""
    value, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        value, rest = value * 1000 + rest // total, rest % total
    return value + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    far = p - q
    return far * far // q


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For all rows of p against all rows of q, the summed divergence over the columns, in slices of bounded size."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, TILE_CELLS // max(1, out.size))
    for at in range(0, p.shape[1], step):
        out += divergence(p[:, None, at : at + step], q[None, :, at : at + step]).sum(axis=2)
    return out


def _tile(top_terms: int):
    """One tile: counts of the groups of two bands for the terms of a block."""

    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        left, right = key[2].as_py(), key[3].as_py()
        rows = groups.to_pylist()
        place = {r["source"]: i for i, r in enumerate(rows)}
        total = np.array([r["total"] for r in rows], np.int64)[:, None]
        mine = [i for i, r in enumerate(rows) if r["band"] == left]
        others = [i for i, r in enumerate(rows) if r["band"] == right]
        terms = counts.column("term").combine_chunks().dictionary_encode()
        names, column = terms.dictionary, terms.indices.to_numpy()
        row = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
        dense = np.zeros((len(rows), len(names)), np.int64)
        dense[row, column] = counts.column("n").to_numpy()
        p = share(dense + 1, total)
        sums = pair_sums(p[mine], p[others])
        if len(names) < rows[0]["terms"]:  # terms of the block that none of these groups has
            bare = share(np.ones_like(total), total)
            sums += (rows[0]["terms"] - len(names)) * divergence(bare[mine], bare[others].T)
        out: list[tuple[str, str, str, int]] = []
        for i, a in enumerate(mine):
            out += [(rows[a]["source"], "pair", rows[b]["source"], int(sums[i, j])) for j, b in enumerate(others) if a != b]
        if left == right:
            q = np.zeros(len(names), np.int64)
            q[column] = counts.column("all").to_numpy()
            q = share(q + 1, np.array([rows[0]["lang_total"]]))
            listed = names.to_pylist()
            order = np.argsort(np.array([*map(str.encode, listed), None], object)[:-1], kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            for a in mine:
                at = np.flatnonzero((dense[a] > 0) & (p[a] > q))
                value = divergence(p[a, at], q[at])
                first = np.lexsort((rank[at], -value))[:top_terms]
                out += [(rows[a]["source"], "term", listed[at[o]], int(value[o])) for o in first]
        source, part, item, value = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def _bucket(name: str, of: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(of)).cast("long")


def _with_tiles(df: DataFrame) -> DataFrame:
    """Rows of each band (i, j), for all tiles in which the row's band meets another or itself."""
    own = F.col("band")
    met = lambda o: F.when(o == own, F.array(F.struct(own.alias("i"), o.alias("j")))).otherwise(F.array(F.struct(own.alias("i"), o.alias("j")), F.struct(o.alias("i"), own.alias("j"))))
    return df.select("*", F.explode(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1), met))).alias("t")).select("*", "t.i", "t.j").drop("t")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_terms: int = BLOCK_TERMS, band: int = BAND) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the terms in
    `min_docs` of its documents at least, V of them. A group's share of a kept term with n of its N occurrences is
    p = 1 + floor(1e9 * (n + 1) / (N + V)); the divergence of p from q is floor((p - q) * (p - q) / q). Part `pair` sums
    it over all kept terms for each other source of the language, all ranks; part `term` gives each group's terms that
    it has and uses more than its language does, up to `top_terms`. Ranks run by (value descending, bytes of item).

    Null text, language or source count as ''. Groups without terms take part; without kept terms the sums are 0.
    Repeated rows are documents of their own. Very long texts are counted whole, in bounded pieces. An empty table
    gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.keep(counts, "counts")
    groups, counts = counts.where("term is null").select("lang", "source"), counts.where("term is not null")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs).drop("docs")
    kept = scratch.keep(kept, "kept")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / band).alias("bands")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n")), "lang", "left")
    v = F.coalesce("v", F.lit(0))
    langs = scratch.keep(langs.select("lang", "bands", v.alias("v"), F.greatest(F.col("lang_n") + v, F.lit(1)).alias("lang_total"), F.greatest(F.ceil(v / block_terms), F.lit(1)).alias("blocks")), "langs")
    found = scratch.keep(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    named = groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
    named = named.select("lang", "source", F.greatest(F.coalesce("n", F.lit(0)) + F.col("v"), F.lit(1)).alias("total"), "lang_total", "bands", _bucket("source", "bands").alias("band"))
    sizes = kept.join(langs, "lang").groupBy("lang", _bucket("term", "blocks").alias("block")).agg(F.count("*").alias("terms"))
    named = _with_tiles(named).join(sizes, "lang", "left").fillna(0, ["block", "terms"])
    cells = _with_tiles(found.join(langs, "lang").withColumns({"block": _bucket("term", "blocks"), "band": _bucket("source", "bands")}))
    key = ["lang", "block", "i", "j"]
    tiles = cells.select(*key, "source", "term", "n", "all").groupBy(*key).cogroup(named.select(*key, "source", "band", "total", "lang_total", "terms").groupBy(*key)).applyInArrow(_tile(top_terms), TILED)
    tiles = scratch.keep(tiles, "tiles")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    return pairs.union(tiles.where("part = 'term'").select("*", rank).where(F.col("rank") <= top_terms))
