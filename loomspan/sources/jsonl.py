"""JSON lines: tolerant scans with an issue per line, strict checks, write-once sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_tape import report


def strict_issue(line: Column, rows_only: bool = True) -> Column:
    """BLANK_LINE, JSON_PARSE, CONSTANT, DUPLICATE_KEY, OVERFLOW, or null for sound JSON; see `json_tape.report`.
    rows_only: a value that is no object is ROW_SHAPE."""
    found = report(line)["issue"]
    return found if rows_only else F.when(found != "ROW_SHAPE", found)


def issue(line: Column) -> Column:
    """BLANK_LINE, JSON_PARSE, ROW_SHAPE, or null for a JSON object. Repeated keys and constants do not parse."""
    found = strict_issue(line)
    return F.when(found.isin("CONSTANT", "DUPLICATE_KEY"), "JSON_PARSE").when(found != "OVERFLOW", found)


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of JSON lines; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """JSON lines with keys in name order; an existing path is an error."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)
