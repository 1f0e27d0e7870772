"""Registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, hamming_topk, hard_negatives, html_extract, language_id, link_rank, minhash, mixing, pii, quality, suffix_dedup, token_output


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_passages(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality", "toxic", "site", "posterior", "keep")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("h")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.top_k(_read(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.training_records(_read(spark, sf_dir, "documents"))


def op10_link_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_rank.judge_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", hard_negatives.flipped(F.col("vec_id"), F.col("label"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_extract": op6_html_extract,
    "op7_hamming_topk": op7_hamming_topk,
    "op8_pii": op8_pii,
    "op9_token_output": op9_token_output,
    "op10_link_rank": op10_link_rank,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op2_minhash_dedup": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), s as (
  select distinct doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) x from d where len(w) > 0
), n as (select doc_id, count(*) n from s group by 1
), l as (
  select a.doc_id a, b.doc_id b from s a join s b on a.x = b.x and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), r as (select doc_id a, doc_id b from documents union select r.a, l.b from r join l on l.a = r.b
), c as (select a, min(b) component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id, d.doc_id = c.component_id kept
from d left join n using (doc_id) join c on c.a = d.doc_id
""",
    "op7_hamming_topk": """
with d as (
  select a.vec_id query_id, b.vec_id, list_sum([case when (a.embedding[i] > 0) <> (b.embedding[i] > 0) then 1 else 0 end for i in range(1, 65)])::int distance
  from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id
), r as (select *, row_number() over (partition by query_id order by distance, vec_id)::int rank from d)
select query_id, rank, vec_id, distance from r where rank <= 10
""",
    "op11_hard_negatives": """
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint label, [floor(256 * x::double)::bigint for x in embedding] q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id anchor_id, b.vec_id id, a.label = b.label same, coalesce(list_sum([a.q[i] * b.q[i] for i in range(1, least(len(a.q), len(b.q)) + 1)]), 0)::bigint score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int rank, id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
""",
    "op12_source_divergence": r"""
with d as (
  select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents
), o as (select id, lang, source, unnest(w) term from d
), k as (select lang, term, count(*) n from o group by 1, 2 having count(distinct id) >= 3
), v as (select lang, count(*) v, sum(n) n from k group by 1
), g as (select distinct lang, source from d
), c as (select o.lang, o.source, o.term, count(*) n from o join k using (lang, term) group by 1, 2, 3
), t as (select lang, source, sum(n) n from c group by 1, 2
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v) p, 1 + 1000000000::hugeint * (k.n + 1) // (v.n + v.v) q
  from g join k using (lang) join v using (lang) left join t on t.lang = g.lang and t.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), s as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) x from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), r as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s.x, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q
)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int rank from r qualify part = 'pair' or rank <= 200
""",
}
