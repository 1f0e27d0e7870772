"""Delimited text with a header: typed scans that fail on broken rows, and the matching writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Typed rows; the header must name the schema's columns in order."""
    return spark.read.schema(schema).option("mode", "FAILFAST").options(header=True, sep=sep, escape='"', multiLine=True, enforceSchema=False).csv(path)


def write(df: DataFrame, path: str, sep: str = "\t") -> None:
    """An existing path is an error."""
    df.write.mode("errorifexists").options(header=True, sep=sep, escape='"').csv(path)
