"""The training-corpus pipeline: five stages, each a whole-table operator of loomspan.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and reads it
again as the next stage's docs. All but the last return the columns of `documents`. Columns may be null, in any
order, and further ones may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, minhash, mixing, quality, token_output
from loomspan.llm.common import Scratch, row_hash


def _text_hash(df: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(df["text"].cast("string"), F.lit("")))


def _among(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose id and text are (left_semi) or are not (left_anti) among found (doc_id, h)."""
    keys = found.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).distinct()
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("n_id"), _text_hash(docs).alias("n_h"))
    return named.join(keys, F.col("n_id").eqNullSafe(F.col("k_id")) & (F.col("n_h") == F.col("k_h")), how).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: low quality or toxic.

    Null, empty and blank texts are judged by their (empty) shape; rows that repeat an id and text share their fate;
    null ids are judged by their text like all others. Very long texts are judged whole.
    """
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _among(docs, judged.where("keep"), "left_semi")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Of rows that share that id, the one whose values hash lowest stays. Null or blank texts are in no group and stay,
    and so do rows without an id, which are linked with nothing.
    """
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("k_id")).distinct()
    named = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("n_id"), row_hash(docs).alias("place"))
    one = named.join(kept, F.col("n_id") == F.col("k_id"), "left_semi").groupBy("n_id").agg(F.min_by("row", "place").alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat an id and text share their fate; rows without an id go by
    their text.
    """
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _among(docs, found.where("contaminated"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's taken words, a row for each repeat.

    Documents that the mix does not take, null and blank texts among them, have no row. Rows without an id or source are
    mixed like all others.
    """
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride token records in training order, written as shard files; a row for each record says where it lies and
    which documents it holds.

    Shards and index stay, below `token_output.kept_folder`: a run over the same documents writes only the shards that
    are not there yet. Null and empty texts give an end mark alone; ids may be null or repeat. No documents: no files
    and no rows.
    """
    kept = token_output.kept_folder(docs)
    index = token_output.write_training_shards(docs, f"{kept}/files")
    index.write.mode("overwrite").parquet(f"{kept}/index")
    return spark.read.schema(index.schema).parquet(f"{kept}/index")


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mixing_stage),
    ("token-id output", token_stage),
]

#: SQL cannot express the trained models, random draws and the tokenizer; tests/llm/test_pipeline.py holds the stages to
#: recomputations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, str(i))
    return docs
