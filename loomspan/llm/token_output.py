"""Token ids in training order.

Documents become token ids, each followed by an end mark, and pack into sequences of fixed length inside
hash groups. Group sizes give every sequence a dense index; a keyed Feistel permutation with cycle-walking
maps the index to its global slot; sequences move to the range partition that holds the slot. Records have
one width, so record i of a shard starts at i * stride and a reader can resume at any slot.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, shared_dir
from .feistel import permute

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The vocabulary's pre-token pattern and its free id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
SEQUENCE = 1024
SHARD = 1024
KEY = 0x51F0A7
GROUP_DOCS = 512
PIECE = 200_000  # code points handed to the tokenizer at once, cut before a space


@lru_cache(2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_ids(text: str, ranks: bytes) -> np.ndarray:
    """Ids of a text. A long text goes in pieces cut between a non-space and a space, where pre-tokens part."""
    coder, out, at = encoding(ranks), [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
        out += coder.encode_ordinary(text[at:end])
        at = end
    return np.array(out, np.uint16)


TOKENS = "g long, doc_id long, h long, n long, ids binary"
RECORDS = "slot long, shard long, record int, n_tokens int, doc_ids array<long>, tokens binary"


class _Group:
    """Packs one group's documents; sequences leave as they fill."""

    def __init__(self, length: int):
        self.length, self.held, self.owners, self.size, self.i = length, [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[np.ndarray, list, int]]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.size]
            self.held.append(part)
            self.owners.append(doc_id)
            self.size, at = self.size + len(part), at + len(part)
            if self.size == self.length:
                yield self.close()

    def close(self) -> tuple[np.ndarray, list, int]:
        out = np.concatenate(self.held), list(dict.fromkeys(self.owners)), self.i
        self.held, self.owners, self.size, self.i = [], [], 0, self.i + 1
        return out


def _sequences(docs: DataFrame, tokenizer: str, sequence: int, shard: int, key: int, id_col: str, text_col: str) -> DataFrame:
    """slot, n_tokens, doc_ids, body (compressed tokens) of each sequence, in slot order inside range partitions that hold
    whole shards."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # one vocabulary file: about 1 MB
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    groups = -(-docs.count() // GROUP_DOCS) or 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                ids = [np.append(token_ids(x.as_py(), ranks.value), np.uint16(END)) for x in own.column(1)]
                yield pa.RecordBatch.from_arrays([own.column(3), own.column(0), own.column(2), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack.compress(x.tobytes()) for x in ids], pa.binary())], names=["g", "doc_id", "h", "n", "ids"])

    grouped = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("h"))), F.lit(groups)))
    tokens = scratch.keep(grouped.mapInArrow(encode, TOKENS), "tokens")
    # Dense index of each group's first sequence: running sums in two levels.
    sizes = tokens.groupBy("g").agg(F.ceil(F.sum("n") / sequence).cast("long").alias("m")).withColumn("top", F.expr("g div 1024"))
    tops = sizes.groupBy("top").agg(F.sum("m").alias("m"))
    tops = tops.select("top", F.coalesce(F.sum("m").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = sizes.join(tops, "top").select("g", (F.col("before") + F.coalesce(F.sum("m").over(Window.partitionBy("top").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    base = scratch.keep(base, "base")
    total = sizes.agg(F.sum("m")).first()[0] or 0
    parts = max(1, min(-(-total // (4 * shard)), 100_000))
    stride = -(-(-(-total // parts)) // shard) * shard or shard

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        group, at, first = _Group(sequence), None, 0

        def ready(out: list) -> pa.RecordBatch:
            slot = permute(np.array([first_ + i for _, _, i, first_ in out], np.int64), total, key)
            body = zstandard.ZstdCompressor(level=1)
            full = [np.pad(x, (0, sequence - len(x)), constant_values=END) for x, _, _, _ in out]
            return pa.RecordBatch.from_arrays([pa.array(slot // stride), pa.array(slot), pa.array([len(x) for x, _, _, _ in out], pa.int32()), pa.array([d for _, d, _, _ in out], pa.list_(pa.int64())), pa.array([body.compress(x.tobytes()) for x in full], pa.binary())], names=["part", "slot", "n_tokens", "doc_ids", "body"])

        for batch in batches:
            out: list = []
            for g, doc_id, ids, start in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "ids", "base")), strict=True):
                if g != at:
                    if group.size:
                        out.append((*group.close(), first))
                    group, at, first = _Group(sequence), g, start
                out += [(*x, first) for x in group.add(doc_id, np.frombuffer(unpack.decompress(ids), np.uint16))]
                if len(out) >= 2048:
                    yield ready(out)
                    out = []
            if out:
                yield ready(out)
        if group.size:
            yield ready([(*group.close(), first)])

    # Dealt explicitly: a join may be broadcast and would then leave groups apart.
    ordered = tokens.repartition("g").join(base, "g").select("g", "doc_id", "h", "ids", "base").sortWithinPartitions("g", "doc_id", "h")
    moved = ordered.mapInArrow(pack, "part long, slot long, n_tokens int, doc_ids array<long>, body binary")
    return moved.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("slot").drop("part")


def _unfolded(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """The records of batches of sequences."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        slot = batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slot // shard), pa.array((slot % shard).astype(np.int32)), batch.column(1), batch.column(2), pa.array([unpack.decompress(x) for x in batch.column(3).to_pylist()], pa.binary())], names=["slot", "shard", "record", "n_tokens", "doc_ids", "tokens"])


def training_records(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, shard: int = SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence, in slot order inside range partitions: slot, shard, record, n_tokens, doc_ids,
    tokens (little-endian uint16, `sequence` of them; a group's last is padded with the end mark).

    Null or empty texts give the end mark alone. Null ids are kept as null in doc_ids; repeated rows are
    packed each time. An empty table gives no rows. Two runs agree, whatever the partitioning.
    """
    return _sequences(docs, tokenizer, sequence, shard, key, id_col, text_col).mapInArrow(lambda batches: _unfolded(batches, shard), RECORDS)


INDEX = "slot long, shard long, record int, n_tokens int, doc_ids array<long>, first_byte long, n_bytes int, sha256 string"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def _put(store: pyarrow.fs.FileSystem, name: str, body: bytes, digest: str) -> None:
    """Writes a file unless it holds these bytes already; attempts do not meet, and a file appears whole or not at all."""
    if store.get_file_info(name).size == len(body):
        with store.open_input_stream(name) as f:
            if hashlib.sha256(f.read()).hexdigest() == digest:
                return
    attempt = f"{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(attempt) as f:
        f.write(body)
    store.move(attempt, name)


def _written(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes the shards of batches of records; the index rows of each."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    held: list[tuple] = []
    done: set[int] = set()

    def close() -> pa.RecordBatch:
        rows = sorted(held, key=lambda r: r[2])
        number = rows[0][1]
        if number in done or [r[2] for r in rows] != list(range(len(rows))) or len({len(r[5]) for r in rows}) != 1:
            raise ValueError(f"shard {number} does not come whole and in one piece")
        done.add(number)
        body = b"".join(r[5] for r in rows)
        digest = hashlib.sha256(body).hexdigest()
        _put(store, f"{root}/shard-{number:08d}.bin", body, digest)
        stride = len(rows[0][5])
        columns = [*zip(*(r[:5] for r in rows), strict=True), [i * stride for i in range(len(rows))], [stride] * len(rows), [digest] * len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[1] != held[0][1]:
                yield close()
                held = []
            held.append(row)
    if held:
        yield close()


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Writes the records as raw files `path/shard-%08d.bin` of fixed stride. A row for each record: slot, shard, record,
    n_tokens, doc_ids, where its bytes lie (first_byte, n_bytes), and its shard's sha256.

    Records must come as `training_records` gives them: a shard whole in one partition; one that comes in parts, or
    with gaps, is an error. A shard that is there with the same bytes is not written again, so a broken run resumes;
    other bytes are replaced. path: a folder that all executors reach, as a URI or an absolute path. No records: no
    files and no rows.
    """
    names = ["slot", "shard", "record", "n_tokens", "doc_ids", "tokens"]
    return records.select(*names).mapInArrow(lambda batches: _written(batches, path), INDEX)


def write_training_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, shard: int = SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`write_shards` of the documents' `training_records`, by one Python worker a task: tokens go from the shuffle into
    files and do not pass through Spark again; a batch unfolds a part at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512))
        yield from _written(_unfolded(parts, shard), path)

    return _sequences(docs, tokenizer, sequence, shard, key, id_col, text_col).mapInArrow(write, INDEX)


def kept_folder(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, shard: int = SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> str:
    """A folder for the shards of these documents that outlives the session, named after their content and the
    options: a run over the same documents finds what an earlier one has written. It lies below the setting
    `spark.loomspan.output.dir`, or, where that is unset, below the shared folder; nothing clears it."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    n, folded, total = docs.select(h.alias("h")).agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0))).first()
    with open(tokenizer, "rb") as f:
        words = hashlib.sha256(f.read()).hexdigest()
    name = hashlib.sha256(f"{n}:{folded}:{total}:{words}:{sequence}:{shard}:{key}".encode()).hexdigest()[:32]
    base = spark.conf.get("spark.loomspan.output.dir", None) or f"{shared_dir(spark)}/output"
    return f"{base.rstrip('/')}/shards-{name}"


_INDEX = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.string())


def read_records(path: str, first_slot: int, n: int, sequence: int = SEQUENCE, shard: int = SHARD) -> np.ndarray:
    """(n, sequence) token ids of consecutive slots, read by offset from the shard files: a reader resumes at any slot."""
    store, root = _store(path)
    out = []
    slot = first_slot
    while slot < first_slot + n:
        number, record = divmod(slot, shard)
        many = min(shard - record, first_slot + n - slot)
        name = f"{root}/shard-{number:08d}.bin"
        if store.get_file_info(name).type == pyarrow.fs.FileType.NotFound:
            raise EOFError(f"there is no shard {number}")
        with store.open_input_file(name) as f:
            body = f.read_at(many * sequence * 2, record * sequence * 2)
        if len(body) != many * sequence * 2:
            raise EOFError(f"slots from {slot} on are not all in shard {number}")
        out.append(np.frombuffer(body, np.uint16).reshape(many, sequence))
        slot += many
    return np.concatenate(out) if out else np.empty((0, sequence), np.uint16)
