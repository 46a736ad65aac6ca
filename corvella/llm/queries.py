"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import fim, jaccard, lmscore, mixing, multiindex, negatives, packing, pieces, quality, secrets, sharding, topk, toxicity
from corvella.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_rows(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor, shifted = F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchor, shifted)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.pack(table(spark, sf_dir, "documents"))
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_quality, op4_multiindex, op5_jaccard, op6_pieces, op7_topk, op8_toxicity, op9_lmscore, op10_secrets, op11_negatives, op12_packing, op13_fim)}

_LEVELS = "list_transform(embedding, lambda x: floor(256 * x::double)::bigint)"

#: Where the rows follow from the contract alone. The others draw, learn or scan by a method that SQL doesn't have.
ORACLE = {
    "op7_topk": f"""with e as (select vec_id, {_LEVELS} v from embeddings), s as (select q.vec_id query_id, c.vec_id vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::bigint score from e q, e c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s) select query_id, rank, vec_id, score from r where rank <= 5""",
    "op11_negatives": f"""with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end y, {_LEVELS} v from embeddings where label is not null and embedding is not null), s as (select a.vec_id anchor_id, c.vec_id vec_id, a.y = c.y alike, list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1] * x[2]))::bigint score from e a, e c where a.vec_id % 50 = 0 and a.vec_id <> c.vec_id), p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) k from s where alike), w as (select p.anchor_id, p.vec_id positive_id, s.vec_id negative_id, p.score positive_score, s.score negative_score, row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int rank from p join s on s.anchor_id = p.anchor_id and not s.alike and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.k <= 5) select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from w where rank <= 3""",
    "op13_fim": """with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u, sha256('1:' || doc_id) x from documents), h as (select *, len(u) n, ('0x' || x[1:8])::bigint h1, ('0x' || x[9:16])::bigint h2, ('0x' || x[17:24])::bigint h3, ('0x' || x[25:32])::bigint h4 from d), c as (select doc_id, n, t, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form, u, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b from h), f as (select doc_id, n, t, form, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:n], '') s from c) select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars, sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from f""",
}
