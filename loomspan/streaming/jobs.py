"""Structured Streaming over a folder of Parquet files: windows, sessions, deduplication, running budgets.

Jobs run with `availableNow` and write each batch's changed rows with its number to the shared folder; the result
takes the newest row of each key. A retried batch writes the same rows again, so results hold after failures.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

from ..operators.ordered import LEAD, earlier, in_cells, inside, with_leads
from ..sources.shared import Scratch, shared_path


def event_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events of Parquet files as a stream with a watermark on ts (naive timestamps are cast first)."""
    schema = spark.read.parquet(path).schema
    # The file source wants a pattern or a folder.
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run(df: DataFrame, keys: Sequence[str], name: str, mode: str = "update") -> DataFrame:
    """Runs the stream to its present end and returns its rows."""
    base = shared_path(df.sparkSession, name)
    _advance(df, base, mode)
    return _results(df.sparkSession, df, base, keys, mode)


def _advance(df: DataFrame, base: str, mode: str) -> None:
    """Runs the stream from its checkpoint below `base` to its present end."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/n={number}")

    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(save).start().awaitTermination()


def _results(spark: SparkSession, df: DataFrame, base: str, keys: Sequence[str], mode: str) -> DataFrame:
    out = spark.read.schema(spark.createDataFrame([], df.schema).withColumn("_batch", F.lit(0)).schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    rest = [c for c in df.columns if c not in keys]
    if mode == "complete":
        last = out.agg(F.max("_batch").alias("_last"))
        return out.join(F.broadcast(last), F.col("_batch") == F.col("_last")).select(*df.columns)
    if not rest or mode == "append":
        return out.select(*df.columns)
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_m")).select(*keys, "_m.*")


def in_parts(df: DataFrame, at: str, parts: int) -> list[DataFrame]:
    """The rows by equal ranges of a number, in order; nulls come first."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    step = max(1, -(-(high - low + 1) // parts)) if low is not None else 1
    part = F.coalesce(((F.col(at) - (low or 0)) / step).cast("long"), F.lit(0))
    return [df.where(part == i) for i in range(parts)]


def run_parts(parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], keys: Sequence[str], name: str, mode: str = "update", conf: dict[str, str] | None = None) -> DataFrame:
    """Feeds parts of a table to a stream one after another. The stream ends with each part and starts again from its
    checkpoint with the next, so what it knows of earlier parts is its state. conf: settings of the stream's session."""
    spark = parts[0].sparkSession
    base, session = shared_path(spark, name), spark.newSession()
    for k, v in (conf or {}).items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        df = build(session.readStream.schema(part.schema).parquet(f"{base}/in"))
        _advance(df, base, mode)
    return _results(spark, df, base, keys, mode)


def reject_late(parts: Sequence[DataFrame], key: str, at: str, order: str, width: int, name: str = "rising") -> DataFrame:
    """Adds accepted: whether `at` is above all earlier ones of its key. A late point is rejected, not buffered.

    Each batch is judged by a scan in cells of `width` of `order`, so that a key with a third of its rows spreads over
    many tasks. The state is the highest `at` of each key, a table that each batch writes anew under its own number: a
    batch that is tried again reads what the batch before has written. Rows with a null key form a key; a null `at` is
    rejected, and a null `order` comes first."""
    spark = parts[0].sparkSession
    base = shared_path(spark, name)
    kept = f"{base}/high/n="
    empty = parts[0].select(key, F.col(at).alias("_high")).limit(0)
    empty.write.parquet(f"{kept}-1")

    def judge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        high = session.read.schema(empty.schema).parquet(f"{kept}{number - 1}")
        rows = in_cells(batch.withColumn("_v", F.col(at)), order, width)
        rows = with_leads(rows, [key], [F.max("_v").alias("_v")], [earlier(F.max, "_v")])
        before = F.max("_v").over(inside([key], order).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_before", before).where(f"{LEAD} = 1")
        known = high.withColumnRenamed(key, "_key")
        rows = rows.join(known, rows[key].eqNullSafe(known["_key"]), "left")
        top = F.greatest("_before", "_high")
        judged = rows.withColumn("accepted", F.coalesce(F.col(at) > top, F.col(at).isNotNull() & top.isNull()))
        judged.select(*batch.columns, "accepted").write.mode("overwrite").parquet(f"{base}/out/n={number}")
        tops = high.union(batch.select(key, at)).groupBy(key).agg(F.max("_high").alias("_high"))
        tops.write.mode("overwrite").parquet(f"{kept}{number}")

    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{base}/in")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(judge).start().awaitTermination()
    schema = StructType([*parts[0].schema.fields, StructField("accepted", BooleanType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


HELD = "lease long, consumer string, named boolean, said long"
LEASES = "lease long, registered long, accepted long, released boolean, repeated long, strange long, again long"


def follow_leases(parts: Sequence[DataFrame], name: str = "leases") -> DataFrame:
    """The newest state of each lease, over parts of (lease, consumers, consumer) that are fed to a stream one after
    another; columns as in `ledger.close_leases`, which calls Python and the state store for each lease of a batch.

    Here a batch is judged by grouped sums, so leases cost rows, and one with most rows spreads over its consumers. The
    state is a row for each consumer of a lease, named by the lease or not, with how often it has said that it accepts: a
    table that each batch writes anew under its own number, so a batch that is tried again reads what the batch before
    has written. A lease takes the first list that is not empty, each name once; of several in one batch, which have no
    order, the smallest."""
    spark = parts[0].sparkSession
    scratch = Scratch(spark, name)
    base = scratch.path("table")
    spark.createDataFrame([], HELD).write.parquet(f"{base}/held/n=-1")

    def judge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        held = session.read.schema(HELD).parquet(f"{base}/held/n={number - 1}")
        full = F.size("consumers") > 0
        lists = batch.where("consumers is not null").groupBy("lease").agg(F.min(F.when(full, F.col("consumers"))).alias("names"), F.count("*").alias("lists"), F.count_if(full).alias("full"))
        known = held.where("named").select(F.col("lease").alias("_lease"), F.lit(True).alias("_known")).distinct()
        lists = lists.join(known, F.col("lease").eqNullSafe(F.col("_lease")), "left")
        names = lists.where("_known is null").select("lease", F.explode(F.array_distinct("names")).alias("consumer"), F.lit(True).alias("named"), F.lit(0).cast("long").alias("said"))
        said = batch.where("consumers is null").select("lease", "consumer", F.lit(False).alias("named"), F.lit(1).cast("long").alias("said"))
        now = held.union(names).union(said).groupBy("lease", "consumer").agg(F.bool_or("named").alias("named"), F.sum("said").alias("said"))
        now.write.mode("overwrite").parquet(f"{base}/held/n={number}")
        now = session.read.schema(HELD).parquet(f"{base}/held/n={number}")
        again = F.when(F.col("_known"), F.col("lists")).otherwise(F.greatest(F.col("full") - 1, F.lit(0)))
        # Leases of the batch have a number here, and only they are written.
        touched = batch.select("lease", F.lit(0).cast("long").alias("again")).union(lists.select("lease", again))
        rows = now.unionByName(touched, allowMissingColumns=True)
        says = F.col("said") > 0
        sums = [F.count_if("named").alias("registered"), F.count_if(F.col("named") & says).alias("accepted"), F.coalesce(F.sum(F.greatest(F.col("said") - 1, F.lit(0))), F.lit(0)).alias("repeated"), F.count_if(~F.col("named") & says).alias("strange"), F.max("again").alias("again")]
        out = rows.groupBy("lease").agg(*sums).where("again is not null").withColumn("released", (F.col("registered") > 0) & (F.col("registered") == F.col("accepted")))
        out.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/n={number}")
        scratch.drop(f"table/held/n={number - 2}")  # no batch reads it again

    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{base}/in")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(judge).start().awaitTermination()
    return _results(spark, spark.createDataFrame([], LEASES), base, ["lease"], "update")
