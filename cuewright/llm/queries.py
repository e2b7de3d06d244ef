"""The numbered queries over the corpus tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, html_text, mixing, passages, permuterm, pii, quality, resample, secrets, simhash, toxicity, vectors
from .common import table


def op1_private_data(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.held_out("doc_id", 4, 2)
    s = quality.score(docs, quality.train(docs, labels, ~out))
    return s.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_near_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.held_out("doc_id", 5, 0)
    s = toxicity.score_all(docs, labels, ~out)
    return s.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_simhash(spark, sf_dir):
    x = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mix_sources(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark, sf_dir):
    ok = "<|im_end|><|im_start|>assistant ok"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    return chat.digests(c.unionByName(extra))


def op11_importance_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secrets(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return permuterm.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_private_data": op1_private_data,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_quality": op3_quality,
    "op4_near_vectors": op4_near_vectors,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_mix_sources": op8_mix_sources,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_format": op10_chat_format,
    "op11_importance_resample": op11_importance_resample,
    "op12_secrets": op12_secrets,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Chat: roles and texts straight from the table; the formatted length by the template's rule.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 11)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES = {"op4_near_vectors": vectors.ORACLE_SQL, "op8_mix_sources": mixing.ORACLE_SQL, "op10_chat_format": CHAT_SQL, "op11_importance_resample": resample.ORACLE_SQL, "op12_secrets": secrets.ORACLE_SQL, "op13_spelling_variants": permuterm.ORACLE_SQL}
