"""Window builders as arguments: a planner takes any function from a source's end to its windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: From a source's end to the windows [a, b) that a plan takes of it.
Builder = Callable[[int], Iterable[tuple[int, int]]]


def equal_split(longest: int) -> Builder:
    """As few equal windows as keep each at `longest` or less."""

    def build(end: int) -> Iterable[tuple[int, int]]:
        n = max(1, -(-end // longest))
        return ((i * end // n, (i + 1) * end // n) for i in range(n))

    return build


def hopping(size: int, hop: int) -> Builder:
    """Windows every `hop` ticks, and a last one that ends with the source; a short source is one window."""

    def build(end: int) -> Iterable[tuple[int, int]]:
        last = end - size
        starts = [0] if last <= 0 else sorted({*range(0, last + 1, hop), last})
        return ((a, min(a + size, end)) for a in starts)

    return build


def planned_windows(sources: DataFrame, key: str, end: str, builder: Builder) -> DataFrame:
    """(key, a, b): the windows that `builder` makes of each source, as a table function over partitions by key. A source
    with a null end has none; sources that repeat a key have theirs each."""
    kind = dict(sources.dtypes)[key]

    class Plan:
        def eval(self, row: Row):
            if row["_end"] is not None:
                for a, b in builder(row["_end"]):
                    yield row["_key"], a, b

    plan = F.udtf(Plan, returnType=f"_key {kind}, a long, b long")
    rows = sources.select(F.col(key).alias("_key"), F.col(end).cast("long").alias("_end"))
    return plan(rows.asTable().partitionBy("_key")).withColumnRenamed("_key", key)
