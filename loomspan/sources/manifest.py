"""Content manifests: listed sizes and SHA-256 sums against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEM = r"^(.+?)(?:\.([^.]+))?$"


def content_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha) of each file below a folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def stem_index(spark: SparkSession, path: str) -> DataFrame:
    """(stem, suffix, path, size) of each file below a folder; contents are not read. The stem ends at the last dot of
    the name; names that begin with a dot or an underscore are left out, as by all of Spark's readers."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    name = F.substring_index("path", "/", -1)
    return x.select(F.regexp_extract(name, STEM, 1).alias("stem"), F.lower(F.regexp_extract(name, STEM, 2)).alias("suffix"), "path", "size")


def manifest_audit(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, state): OK, MISSING, EXTRA, SIZE or HASH. Both inputs: key, size, sha."""
    other = found.select(F.col(key), F.col("size").alias("_size"), F.col("sha").alias("_sha"))
    both = listed.join(other, key, "full")
    state = F.when(F.col("_sha").isNull(), "MISSING").when(F.col("sha").isNull(), "EXTRA").when(F.col("size") != F.col("_size"), "SIZE").when(F.col("sha") != F.col("_sha"), "HASH").otherwise("OK")
    return both.select(key, state.alias("state"))
