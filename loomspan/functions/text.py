"""Text and JSON column functions: fences, model answers, root shapes, key checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .json_tape import key_names


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def alias(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", "$1"))


def only_object(text: Column) -> tuple[Column, Column]:
    """(state, body): the text's single `segments` object; NONE without, AMBIGUOUS with several."""
    found = F.regexp_extract_all(text, F.lit(r'(\{"segments":[^{}]*\})'), 1)
    n = F.size(found)
    return F.when(n == 0, "NONE").when(n == 1, "FOUND").otherwise("AMBIGUOUS").alias("state"), F.when(n == 1, F.get(found, F.lit(0))).alias("body")


def three_state(df: DataFrame, text: str) -> DataFrame:
    """Adds state, reason and n of a model answer. An answer that breaks a rule is INVALID, never empty."""
    parsed = F.from_json(strip_fence(F.col(text)), "segments array<array<double>>")
    x = df.withColumn("_s", parsed["segments"])
    s = F.col("_s")
    bad = lambda rule: F.exists(s, rule)
    reason = (
        F.when(s.isNull(), "PARSE")
        .when(bad(lambda p: F.size(p) != 2), "SHAPE")
        .when(bad(lambda p: ~finite(p[0]) | ~finite(p[1])), "NOT_FINITE")
        .when(bad(lambda p: p[0] < 0), "NEGATIVE")
        .when(bad(lambda p: p[1] <= p[0]), "REVERSED")
    )
    x = x.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    state = F.when(~ok, "INVALID").when(F.size(s) == 0, "VALID_EMPTY").otherwise("VALID_NONEMPTY")
    return x.withColumn("state", state).withColumn("n", F.when(ok, F.size(s)).otherwise(0)).drop("_s")


def root_rows(df: DataFrame, row: str) -> DataFrame:
    """Rows of JSON documents in column `text`: under `records`, as a list, or as the values of a mapping."""
    c = F.trim("text")
    kind = f"struct<{', '.join(x.strip().replace(' ', ':') for x in row.split(','))}>"
    listed = F.when(c.startswith("["), F.from_json(c, f"array<{kind}>"))
    under = F.from_json(c, f"records array<{kind}>")["records"]
    mapped = F.map_values(F.from_json(c, f"map<string,{kind}>"))
    rows = F.coalesce(listed, F.when(F.array_contains(F.json_object_keys("text"), "records"), under).otherwise(mapped))
    return df.withColumn("_r", F.explode(rows)).select(*[x for x in df.columns if x != "text"], "_r.*")


def frame_rows(df: DataFrame, box: str) -> DataFrame:
    """(other columns, frame, box) of documents in column `text` with `frames` as a mapping from frame to object or as a
    list of objects; frame is also `frame_id`, box also `bbox`."""
    kind = f"frame int, frame_id int, box struct<{box.replace(' ', ':')}>, bbox struct<{box.replace(' ', ':')}>"
    inner = F.get_json_object("text", "$.frames")
    listed = F.from_json(F.when(F.trim(inner).startswith("["), inner), f"array<struct<{kind.replace(' int', ':int').replace(' struct', ':struct')}>>")
    mapped = F.map_entries(F.from_json(F.when(F.trim(inner).startswith("{"), inner), f"map<string,struct<{kind.replace(' int', ':int').replace(' struct', ':struct')}>>"))
    one = lambda frame, v: F.struct(F.coalesce(frame, v["frame"], v["frame_id"]).alias("frame"), F.coalesce(v["box"], v["bbox"]).alias("box"))
    rows = F.coalesce(F.transform(listed, lambda v: one(F.lit(None).cast("int"), v)), F.transform(mapped, lambda v: one(v["key"].cast("int"), v["value"])))
    return df.withColumn("_r", F.explode(rows)).select(*[x for x in df.columns if x != "text"], "_r.*")


def has_keys(text: Column, names: Sequence[str]) -> Column:
    """True if any of the keys occurs at any depth, however it is escaped; names inside string values do not count. Null
    for text that is no JSON."""
    return F.exists(key_names(text), lambda k: k.isin(*names))


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(text: Column) -> Column:
    """Composed form. Only texts beyond ASCII can change; the others do not leave the JVM's values."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)


def has_suffix(name: Column, suffixes: Sequence[str]) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [low.endswith(x) for x in suffixes])
