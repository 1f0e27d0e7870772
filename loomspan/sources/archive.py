"""ZIP packages: members as rows, and deterministic packages that are read back and checked before they count."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "archive string, member string, size long, crc long, content binary"
EPOCH = (1980, 1, 1, 0, 0, 0)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, crc, content) of each file in the ZIP files of a folder; a bad checksum is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(body.as_py())) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pa.RecordBatch.from_pylist([{"archive": at, "member": info.filename, "size": info.file_size, "crc": info.CRC, "content": z.read(info)}])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(read, MEMBERS)


def _package(rows: list[tuple[str, list[str]]]) -> bytes:
    """A ZIP body that depends on its members only: fixed dates, names in order."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for name, lines in rows:
            info = zipfile.ZipInfo(f"{name}.jsonl", EPOCH)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, "".join(f"{x}\n" for x in lines))
    return body.getvalue()


def write_packages(df: DataFrame, path: str, member: str, line: str, packages: int) -> int:
    """Writes `package-%05d.zip` below a folder that all executors reach (a URI or an absolute path): members by name,
    lines in order. Members are dealt over `packages`, one of which a task holds at a time: take as many as keep a package
    to what a task can hold. Each is read back and its checksums compared before it takes its name. Returns the number written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        held: dict[str, list[str]] = {}
        number = None

        def close() -> pa.RecordBatch:
            body = _package(sorted(held.items()))
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                if z.testzip() or any(i.CRC != zlib.crc32("".join(f"{x}\n" for x in held[i.filename.removesuffix(".jsonl")]).encode()) for i in z.infolist()):
                    raise OSError(f"package {number} does not read back")
            name = f"{root}/package-{number:05d}.zip"
            attempt = f"{name}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(attempt) as f:
                f.write(body)
            store.move(attempt, name)
            return pa.RecordBatch.from_pylist([{"package": number, "bytes": len(body)}])

        for batch in batches:
            for p, m, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and p != number:
                    yield close()
                    held = {}
                number = p
                held.setdefault(m, []).append(x)
        if held:
            yield close()

    dealt = df.select(F.pmod(F.xxhash64(member), F.lit(packages)).alias("p"), F.col(member).cast("string").alias("m"), F.col(line).alias("x"))
    done = dealt.repartition(packages, "p").sortWithinPartitions("p", "m", "x").mapInArrow(write, "package long, bytes long")
    return done.agg(F.count("*")).first()[0]
