"""The given tables as journals: conversations and documents as entries, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOME = "/home/ana"
FOLDERS = (f"{HOME}/Apps/shop", f"{HOME}/Apps/shop/web", f"{HOME}/Apps/Shop/API", f"{HOME}/Apps", f"{HOME}/Apps/sho_p", "/tmp/scratch", "/srv/data")
NOW = "2026-02-01T00:00:00.000Z"
TOOL = "memory_context"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    size = F.octet_length("text")
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    kind = F.when(F.col("role") == "system", "compaction").when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "tool_result").otherwise(F.col("role"))
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.col("conv_id") % len(FOLDERS) + 1).cast("int"))
    return c.select(
        F.concat(F.lit("conv/"), F.col("conv_id"), F.lit(".jsonl")).alias("path"), F.col("conv_id").cast("string").alias("session_id"), folder.alias("cwd"),
        F.concat_ws("-", "conv_id", "turn").alias("entry_id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("ts"), kind.alias("kind"), F.col("role").alias("role"),
        F.when(kind == "tool_result", F.when(F.col("conv_id") % 2 == 0, TOOL).otherwise("bash")).alias("name"), F.length("text").cast("long").alias("chars"),
        F.coalesce(F.sum(size + 1).over(before), F.lit(0)).cast("long").alias("offset"), size.cast("long").alias("length"), "text", "turn",
    )


_FOLDER_SQL = "CASE conv_id % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FOLDERS)) + " END"
CONV_SQL = f"""c AS (SELECT *, CASE WHEN role = 'system' THEN 'compaction' WHEN role = 'assistant' AND turn % 3 = 0 THEN 'tool_result' ELSE role END AS kind FROM conversations),
e AS (SELECT 'conv/' || conv_id || '.jsonl' AS path, CAST(conv_id AS VARCHAR) AS session_id, {_FOLDER_SQL} AS cwd, conv_id || '-' || turn AS entry_id,
  strftime(TIMESTAMP '2026-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') AS ts, kind, role,
  CASE WHEN kind = 'tool_result' THEN CASE WHEN conv_id % 2 = 0 THEN '{TOOL}' ELSE 'bash' END END AS name, CAST(length(text) AS BIGINT) AS chars,
  CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(strlen(text) AS BIGINT) AS length, text, turn FROM c)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1767225600) + (F.col("doc_id") % 40) * 86400)
    return d.select(
        F.concat(F.col("source"), F.lit(".jsonl")).alias("path"), F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("entry_id"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("ts"), F.when(F.col("doc_id") % 3 == 0, "user").otherwise("assistant").alias("kind"), F.col("doc_id").alias("offset"),
        F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("role"), "text", "lang",
    )


DOCS_SQL = """d AS (SELECT source || '.jsonl' AS path, source AS session_id, CAST(doc_id AS VARCHAR) AS entry_id,
  strftime(TIMESTAMP '2026-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') AS ts, CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS kind, doc_id AS "offset", text, lang FROM documents)"""

TOKENS_SQL = r"regexp_extract_all(regexp_replace(strip_accents(lower({0})), '\p{{M}}+', '', 'g'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
