"""Tokens, phrases, BM25, ranking, pages and excerpts over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import excerpt, let, phrase_count, phrases, tokens, utf16_length
from daybook.operators import search as s
from daybook.plans.scope import Filters
from daybook.queries.views import CONV_SQL, DOCS_SQL, NOW, TOKENS_SQL, TOOL, conversations, documents

ALL_WORDS, SOME_WORDS, PHRASE, TWICE = "the that", "the zzzznone que", "of-the", "que QUE"


def _found(entries: DataFrame, query: str, filters: Filters = Filters()) -> DataFrame:
    wanted = phrases(query)
    matched = s.matches_in_texts(entries, wanted).drop("text")
    return s.ranked(matched, filters, len(wanted))


def _phrase_sql(query: str) -> str:
    """CTEs t (tokens), x (dl, f1, f2, ...), st and sc (score, n_matched over all documents)."""
    wanted = phrases(query)
    tf = []
    for i, p in enumerate(wanted, 1):
        if len(p) == 1:
            tf.append(f"len(list_filter(tk, lambda z: z = '{p[0]}')) AS f{i}")
        else:
            tf.append(f"len(list_filter(range(1, CAST(len(tk) AS BIGINT) - {len(p) - 2}), lambda i: " + " AND ".join(f"tk[i + {k}] = '{w}'" for k, w in enumerate(p)) + f")) AS f{i}")
    n = range(1, len(wanted) + 1)
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in n)
    return f"""{DOCS_SQL}, t AS (SELECT *, {TOKENS_SQL.format('text')} AS tk FROM d),
x AS (SELECT *, len(tk) AS dl, {', '.join(tf)} FROM t), st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM t),
df AS (SELECT {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS n{i}' for i in n)} FROM x),
sc AS (SELECT x.*, {score} AS score, {' + '.join(f'CAST(f{i} > 0 AS BIGINT)' for i in n)} AS n_matched FROM x, st, df)"""


def _match_sql(query: str, where: str = "true") -> str:
    n = len(phrases(query))
    return f"""{_phrase_sql(query)}, k AS (SELECT * FROM sc WHERE n_matched > 0 AND {where}), mx AS (SELECT max(n_matched) = {n} AS a FROM k),
m AS (SELECT k.*, CASE WHEN a THEN 'all' ELSE 'any' END AS match FROM k, mx WHERE n_matched = {n} OR NOT a)"""


_ORDER = 'ts DESC, path, "offset" DESC'
_VALUE = f"score / (1 + greatest(0, epoch_ms(CAST('{NOW[:-1]}' AS TIMESTAMP)) - epoch_ms(CAST(left(ts, 23) AS TIMESTAMP))) / 2592000000.0)"


def tokenize_fold(spark: SparkSession, d: str) -> DataFrame:
    told = let(tokens(F.col("text")), lambda tk: F.struct(F.size(tk).cast("long").alias("n"), F.md5(F.array_join(tk, " ")).alias("tokens_md5")))
    return documents(spark, d).select("entry_id", told.alias("t")).select("entry_id", "t.*")


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    n = let(tokens(F.col("text")), lambda tk: phrase_count(tk, phrases(PHRASE)[0])).cast("long")
    return documents(spark, d).select("entry_id", n.alias("n")).where("n > 0")


def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return _found(documents(spark, d), ALL_WORDS).select("entry_id", "match", F.round("score", 6).alias("score"))


def search_any_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _found(documents(spark, d), SOME_WORDS).select("entry_id", "match", F.col("n_matched").cast("long").alias("n_matched"), F.round("score", 6).alias("score"))


def bm25_score(spark: SparkSession, d: str) -> DataFrame:
    return _found(documents(spark, d), f"{PHRASE} which").select("entry_id", F.round("score", 6).alias("score"))


def bm25_filter_invariant(spark: SparkSession, d: str) -> DataFrame:
    return _found(documents(spark, d), ALL_WORDS, Filters(session_id="src3", since="2026-01-10")).select("entry_id", F.round("score", 6).alias("score"))


def dup_phrase_weight(spark: SparkSession, d: str) -> DataFrame:
    return _found(documents(spark, d), TWICE).select("entry_id", F.round("score", 6).alias("score"))


def search_topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return s.candidates(_found(documents(spark, d), "the").withColumn("score", F.round("score", 9))).select("entry_id", F.round("score", 6).alias("score"))


def search_rerank_recency(spark: SparkSession, d: str) -> DataFrame:
    top = s.candidates(_found(documents(spark, d), ALL_WORDS).withColumn("score", F.round("score", 9)))
    return s.page(s.reranked(top, NOW).withColumn("value", F.round("value", 9))).select("entry_id", "session_id", "ts", F.round("value", 6).alias("value"))


def search_page_offset(spark: SparkSession, d: str) -> DataFrame:
    top = s.candidates(_found(documents(spark, d), ALL_WORDS).withColumn("score", F.round("score", 9)), 40)
    return s.page(s.reranked(top, NOW).withColumn("value", F.round("value", 9)), 40).select("entry_id", F.round("value", 6).alias("value"))


def search_in_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same search by way of postings: what an index holds is grouped by term, and only the asked terms are read."""
    docs, wanted = documents(spark, d), phrases(f"{PHRASE} which")
    tk = docs.select("path", "entry_id", tokens(F.col("text")).alias("tk"))
    posted = tk.select("path", "entry_id", F.posexplode("tk").alias("pos", "term")).groupBy("term", "path", "entry_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    lengths = tk.select("path", "entry_id", F.size("tk").alias("dl"))
    matched = s.matches_in_postings(posted, wanted).join(lengths, ["path", "entry_id"])
    found = s.scored(matched, s.corpus_of(lengths), len(wanted))
    return found.select("entry_id", F.col("n_matched").cast("long").alias("n_matched"), F.round("score", 6).alias("score"))


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    """Many one-word searches in one job: each distinct word of each benchmark item is asked of all documents. A token that
    nobody asks for goes before anything is grouped."""
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    tk = documents(spark, d).select("entry_id", F.explode(tokens(F.col("text"))).alias("term"))
    hits = tk.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "entry_id").agg(F.count(F.lit(1)).alias("tf"))
    # An entry counts once for an item, however many of its words it has.
    each = hits.join(asked, "term").groupBy("item_id", "entry_id").agg(F.sum("tf").alias("tf"))
    return each.groupBy("item_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("instances"))


def excerpt_window(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("entry_id", excerpt(F.col("text"), "the").alias("excerpt"))


def utf16_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.col("text"), F.lit("😀a"))
    return documents(spark, d).select("entry_id", utf16_length(t).cast("long").alias("units"), F.length(t).cast("long").alias("points"))


def echo_suppression(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).where(~s.is_echo(TOOL, "3-1", "3")).select("entry_id", "kind", "name")


def _postings_sql() -> str:
    return f"WITH {_phrase_sql(f'{PHRASE} which')} SELECT entry_id, n_matched, round(score, 6) AS score FROM sc WHERE n_matched > 0"


def sql() -> dict[str, str]:
    found = lambda q, cols, where="true": f"WITH {_match_sql(q, where)} SELECT {cols} FROM m"
    score = "round(score, 6) AS score"
    top = lambda n: f"r AS (SELECT * REPLACE (round(score, 9) AS score) FROM m), c AS (SELECT * FROM r ORDER BY score DESC, {_ORDER} LIMIT {n}), v AS (SELECT *, round({_VALUE}, 9) AS value FROM c)"
    words = TOKENS_SQL.format("text")
    return {
        "tokenize_fold": f"WITH {DOCS_SQL}, t AS (SELECT entry_id, {words} AS tk FROM d) SELECT entry_id, CAST(len(tk) AS BIGINT) AS n, md5(array_to_string(tk, ' ')) AS tokens_md5 FROM t",
        "phrase_match": f"WITH {_phrase_sql(PHRASE)} SELECT entry_id, CAST(f1 AS BIGINT) AS n FROM x WHERE f1 > 0",
        "search_all_terms": found(ALL_WORDS, f"entry_id, match, {score}"),
        "search_any_fallback": found(SOME_WORDS, f"entry_id, match, n_matched, {score}"),
        "bm25_score": found(f"{PHRASE} which", f"entry_id, {score}"),
        "bm25_filter_invariant": found(ALL_WORDS, f"entry_id, {score}", "session_id = 'src3' AND ts >= '2026-01-10'"),
        "dup_phrase_weight": found(TWICE, f"entry_id, {score}"),
        "search_topk_candidates": f"WITH {_match_sql('the')}, {top(400)} SELECT entry_id, {score} FROM c",
        "search_rerank_recency": f"WITH {_match_sql(ALL_WORDS)}, {top(400)} SELECT entry_id, session_id, ts, round(value, 6) AS value FROM v ORDER BY v.value DESC, {_ORDER} LIMIT 20",
        "search_page_offset": f"WITH {_match_sql(ALL_WORDS)}, {top(400)} SELECT entry_id, round(value, 6) AS value FROM v ORDER BY v.value DESC, {_ORDER} LIMIT 20 OFFSET 40",
        "search_in_postings": _postings_sql(),
        "search_batch": f"""WITH {DOCS_SQL}, a AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark), t AS (SELECT entry_id, unnest({words}) AS term FROM d)
SELECT item_id, count(DISTINCT entry_id) AS entries, count(*) AS instances FROM t JOIN a USING (term) GROUP BY item_id""",
        "excerpt_window": f"""WITH {CONV_SQL}, p AS (SELECT entry_id, text, greatest(0, greatest(1, instr(regexp_replace(strip_accents(lower(text)), '\\p{{M}}+', '', 'g'), 'the')) - 81) AS s FROM e)
SELECT entry_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, CAST(s + 1 AS BIGINT), 320), '\\s+', ' ', 'g')) || CASE WHEN s + 320 < length(text) THEN '…' ELSE '' END AS excerpt FROM p""",
        "utf16_lengths": f"WITH {DOCS_SQL} SELECT entry_id, CAST(length(text) + 3 + length(regexp_replace(text, '[\\x00-\\x{{FFFF}}]', '', 'g')) AS BIGINT) AS units, CAST(length(text) + 2 AS BIGINT) AS points FROM d",
        "echo_suppression": f"WITH {CONV_SQL} SELECT entry_id, kind, name FROM e WHERE NOT (kind = 'tool_result' AND coalesce(name, '') = '{TOOL}') AND NOT (entry_id = '3-1' AND session_id = '3')",
    }


NAMES = (
    tokenize_fold, phrase_match, search_all_terms, search_any_fallback, bm25_score, bm25_filter_invariant, dup_phrase_weight, search_topk_candidates, search_rerank_recency, search_page_offset,
    search_in_postings, search_batch, excerpt_window, utf16_lengths, echo_suppression,
)
