"""Search, summaries, reading, status and junk by the engine itself: conversations become journals, the journal source
reads them, the index is built from what it reads, and the answers come from the index. They are held against SQL over
the table."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from daybook.functions.entries import SUMMARIES
from daybook.functions.text import phrases
from daybook.operators import junk
from daybook.operators.history import fetched, found
from daybook.operators.index import Index
from daybook.operators.search import candidates, listed, page, reranked
from daybook.plans.scope import Filters
from daybook.queries.views import CONV_SQL, NOW, TOKENS_SQL, conversations
from daybook.sources.journal import listed as journals_in
from daybook.streaming.ingest import catch_up

WORDS, READ_SESSION, ROOTS = "the that", "7", ("/tmp",)
#: One index for each session of Spark and each table, as building one reads all of it.
_built: dict[tuple[str, str], Index] = {}


def journal_lines(entries: DataFrame) -> DataFrame:
    """(session, turn, value): a header for each session, then a line for each entry."""
    message = F.struct(
        F.when(F.col("kind") == "tool_result", "toolResult").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.col("name").alias("toolName"),
    )
    summary = F.col("kind") == "compaction"
    line = F.to_json(F.struct(
        F.when(summary, "compaction").otherwise("message").alias("type"), F.col("entry_id").alias("id"), F.col("ts").alias("timestamp"),
        F.when(summary, F.col("text")).alias("summary"), F.when(~summary, message).alias("message"),
    ))
    first = entries.groupBy("session_id").agg(F.min("ts").alias("ts"), F.first("cwd").alias("cwd"))
    header = F.to_json(F.struct(F.lit("session").alias("type"), F.col("session_id").alias("id"), F.col("ts").alias("timestamp"), "cwd"))
    heads = first.select(F.col("session_id").alias("session"), F.lit(-1).cast("long").alias("turn"), header.alias("value"))
    return heads.unionByName(entries.select(F.col("session_id").alias("session"), "turn", line.alias("value")))


def write_journals(lines: DataFrame, folder: str) -> None:
    """A file for each session, written beside its place and moved there, so that a task may run again."""

    def write(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for session, own in groupby(rows, key=lambda r: r["session"]):
            temp = f"{folder}/.{uuid.uuid4().hex}"
            with open(temp, "w", encoding="utf-8", newline="\n") as f:
                f.writelines(r["value"] + "\n" for r in own)
            os.replace(temp, f"{folder}/{session}.jsonl")

    lines.repartition("session").sortWithinPartitions("session", "turn").foreachPartition(write)


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="daybook-")
    return named.removeprefix("file://").rstrip("/")


def built(spark: SparkSession, d: str) -> Index:
    """The index of the conversations. Journals are read by byte offset, so they lie where executors open files."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        folder = f"{_shared(spark)}/engine-{uuid.uuid4().hex[:12]}"
        write_journals(journal_lines(conversations(spark, d)), f"{folder}/journals")
        index = Index(spark, f"{folder}/index")
        catch_up(spark, f"{folder}/journals", index, f"file://{folder}/checkpoint")
        _built[key] = index
    return _built[key]


def merged(spark: SparkSession, d: str) -> Index:
    """An index of the same journals from many batches, each of a twelfth of their bytes, merged as they came."""
    key = (spark.sparkContext.applicationId, f"{d}/merged")
    if key not in _built:
        folder = os.path.dirname(built(spark, d).base)
        index = Index(spark, f"{folder}/merged/index")
        sizes = sum(size for _, size, _ in journals_in(f"{folder}/journals"))
        catch_up(spark, f"{folder}/journals", index, f"file://{folder}/merged/checkpoint", most_bytes=max(1, sizes // 12))
        _built[key] = index
    return _built[key]


def engine_batches(spark: SparkSession, d: str) -> DataFrame:
    """What each session has in an index of many batches: bounded ingest, commits and merges lose and repeat nothing."""
    return merged(spark, d).entries().groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("dl").alias("tokens"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def engine_forget(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each session after all junk journals were forgotten, in one step."""
    folder = os.path.dirname(built(spark, d).base)
    index = Index(spark, f"{folder}/forgotten-{uuid.uuid4().hex[:8]}")
    catch_up(spark, f"{folder}/journals", index, f"file://{index.base}-checkpoint")
    stats = junk.journal_stats(index.journals(), index.entries(joined=False))
    index.forget(stats.where(junk.junk_reason(ROOTS).isNotNull()).select("path"))
    return index.entries().groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("dl").alias("tokens"))


def engine_search_merged(spark: SparkSession, d: str) -> DataFrame:
    return _searched(merged(spark, d).pinned())


def engine_search(spark: SparkSession, d: str) -> DataFrame:
    return _searched(built(spark, d).pinned())


def _searched(index: Index) -> DataFrame:
    top = candidates(found(index, phrases(WORDS), Filters(kinds=("user", "assistant"))).withColumn("score", F.round("score", 9)))
    shown = top.select("path", "generation", "offset", "score", "match", "session_id").join(index.entries(joined=False), ["path", "generation", "offset"])
    return page(reranked(shown, NOW).withColumn("value", F.round("value", 9))).select("entry_id", "session_id", "ts", "kind", "match", F.round("value", 6).alias("value"))


def engine_summaries(spark: SparkSession, d: str) -> DataFrame:
    return listed(built(spark, d).entries(), Filters(kinds=SUMMARIES)).select("entry_id", "session_id", "cwd", "ts", "kind", F.col("chars").cast("long").alias("chars"))


def engine_read(spark: SparkSession, d: str) -> DataFrame:
    """One session's entries as read back from their journal."""
    hits = listed(built(spark, d).entries(), Filters(session_id=READ_SESSION)).select("entry_id", "path", "offset", "length").collect()  # a page
    ids = spark.createDataFrame([(i, h["entry_id"]) for i, h in enumerate(hits)], "rank int, entry_id string")
    return ids.join(fetched(spark, hits), "rank").select("entry_id", "text") if hits else ids.select("entry_id", F.lit("").alias("text"))


def engine_status(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d).status().select("files", "sessions", "entries", "summaries")


def engine_junk(spark: SparkSession, d: str) -> DataFrame:
    index = built(spark, d)
    stats = junk.journal_stats(index.journals(), index.entries(joined=False))
    return stats.select("session_id", "cwd", "users", "messages", "replies", "summaries", junk.junk_reason(ROOTS).alias("reason"))


def sql() -> dict[str, str]:
    words = TOKENS_SQL.format("text")
    value = f"score / (1 + greatest(0, epoch_ms(CAST('{NOW[:-1]}' AS TIMESTAMP)) - epoch_ms(CAST(left(ts, 23) AS TIMESTAMP))) / 2592000000.0)"
    part = lambda i: f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    a, b = WORDS.split()
    search = f"""WITH {CONV_SQL}, t AS (SELECT *, {words} AS tk FROM e), x AS (SELECT *, len(tk) AS dl, len(list_filter(tk, lambda z: z = '{a}')) AS f1, len(list_filter(tk, lambda z: z = '{b}')) AS f2 FROM t),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM x),
m AS (SELECT x.*, round({part(1)} + {part(2)}, 9) AS score, CAST(f1 > 0 AS INT) + CAST(f2 > 0 AS INT) AS k FROM x, st WHERE (f1 > 0 OR f2 > 0) AND kind IN ('user', 'assistant')),
r AS (SELECT * FROM m WHERE k = 2 OR (SELECT max(k) FROM m) < 2 ORDER BY score DESC, ts DESC LIMIT 400)
SELECT entry_id, session_id, ts, kind, CASE WHEN k = 2 THEN 'all' ELSE 'any' END AS match, round(round({value}, 9), 6) AS value FROM r ORDER BY round({value}, 9) DESC, ts DESC LIMIT 20"""
    counted = f"SELECT session_id, count(*) AS entries, CAST(sum(len({words})) AS BIGINT) AS tokens"
    stats = """s AS (SELECT session_id, any_value(cwd) AS cwd, count(*) FILTER (WHERE kind = 'user') AS users, CAST(0 AS BIGINT) AS messages, count(*) FILTER (WHERE kind = 'assistant') AS replies,
  count(*) FILTER (WHERE kind = 'compaction') AS summaries FROM e GROUP BY session_id)"""
    reason = "CASE WHEN summaries > 0 THEN NULL WHEN cwd = '/tmp' OR starts_with(cwd, '/tmp/') THEN 'temporary folder' WHEN users = 0 THEN 'no instructions' WHEN replies <= 2 THEN 'two replies or fewer' END"
    return {
        "engine_search": search,
        "engine_search_merged": search,
        "engine_batches": f"WITH {CONV_SQL} {counted}, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY session_id",
        "engine_forget": f"WITH {CONV_SQL}, {stats}, j AS (SELECT session_id FROM s WHERE {reason} IS NULL) {counted} FROM e WHERE session_id IN (SELECT session_id FROM j) GROUP BY session_id",
        "engine_summaries": f"WITH {CONV_SQL} SELECT entry_id, session_id, cwd, ts, kind, chars FROM e WHERE kind = 'compaction' ORDER BY ts DESC LIMIT 20",
        "engine_read": f"WITH {CONV_SQL} SELECT entry_id, trim(text, ' \t\r\n') AS text FROM e WHERE session_id = '{READ_SESSION}' ORDER BY ts DESC LIMIT 20",
        "engine_status": f"WITH {CONV_SQL} SELECT count(DISTINCT session_id) AS files, count(DISTINCT session_id) AS sessions, count(*) AS entries, count(*) FILTER (WHERE kind = 'compaction') AS summaries FROM e",
        "engine_junk": f"WITH {CONV_SQL}, {stats} SELECT *, {reason} AS reason FROM s",
    }


NAMES = (engine_search, engine_search_merged, engine_batches, engine_forget, engine_summaries, engine_read, engine_status, engine_junk)
