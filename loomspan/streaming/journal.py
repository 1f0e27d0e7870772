"""A write-once journal of batches: the same batch may come again, another one in its place may not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A batch has been written before with other rows."""


class Journal:
    """Batches as Parquet below a folder that driver and executors share, each under its number with a digest of its
    rows. A batch counts once its digest is there, which is written last: one that broke off is written anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, batch: DataFrame, number: int) -> bool:
        """Writes the batch, and says whether it was new. The rows of a batch have no order; equal rows count each."""
        own = self.digest(batch)
        if (known := self._known(number)) is not None:
            if known != own:
                raise Conflict(f"batch {number} is in the journal with other rows")
            return False
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/n={number}")
        self.spark.createDataFrame([own], "n long, folded long, total decimal(38,0), shape string").coalesce(1).write.mode("overwrite").json(f"{self.path}/digests/n={number}")
        return True

    def read(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/rows")

    @staticmethod
    def digest(batch: DataFrame) -> tuple:
        """Count, exclusive or and sum of the rows' hashes, and the columns: one row, summed where the rows are."""
        h = F.xxhash64(*[F.to_json(c) if "map<" in kind else F.col(c) for c, kind in batch.dtypes])
        row = batch.select(h.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        return (row[0], row[1], row[2], str(batch.dtypes))

    def _known(self, number: int) -> tuple | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/digests/n={number}/_SUCCESS")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return tuple(self.spark.read.schema("n long, folded long, total decimal(38,0), shape string").json(f"{self.path}/digests/n={number}").first())
