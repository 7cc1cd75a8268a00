"""Lists, scopes, reading, statistics and junk over conversations, and extraction from made lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.dates import boundary, day_of, display
from daybook.functions.entries import SUMMARIES, with_entries
from daybook.functions.text import flat, trimmed
from daybook.operators import junk
from daybook.operators import search as s
from daybook.plans.scope import Context, Filters, Request, filters_for, project_roots, under
from daybook.queries.views import CONV_SQL, FOLDERS, HOME, conversations, table

COLUMNS = ("entry_id", "session_id", "ts", "kind")
ROOTS = ("/tmp",)
_PAGE = 'ORDER BY ts DESC, path, "offset" DESC LIMIT 20'


def _listed(spark, d, filters, offset=0):
    return s.listed(conversations(spark, d), filters, offset).select(*COLUMNS)


def list_newest(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, Filters(), 20)


def list_kind_filter(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, Filters(kinds=("tool_result",)))


def list_role_filter(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, Filters(role="assistant", kinds=("assistant", "tool_result")))


def list_since_until(spark: SparkSession, d: str) -> DataFrame:
    f = Filters(since=boundary("2026-01-01T12:00:00Z", False), until=boundary("2026-01-02", True))
    return conversations(spark, d).where(f.predicate()).select(*COLUMNS)


def list_local_day(spark: SparkSession, d: str) -> DataFrame:
    zone = "America/Bogota"
    f = Filters(since=boundary("2026-01-02", False, zone), until=boundary("2026-01-02", True, zone))
    return conversations(spark, d).where(f.predicate()).select("entry_id", day_of(F.col("ts"), zone).alias("day"), display(F.col("ts"), zone).alias("shown"))


def count_matches(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).where(Filters(kinds=("user", "assistant"), since="2026-01-02").predicate()).agg(F.count(F.lit(1)).alias("total"))


def summaries_list(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, Filters(kinds=SUMMARIES))


def find_entry(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).where("entry_id = '7-1'").select("path", *COLUMNS, "chars", "offset", "length")


def find_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Ids that several sessions share (here the turn's number), each with the sessions to choose from."""
    forked = conversations(spark, d).withColumn("entry_id", F.concat(F.lit("turn-"), F.col("turn")))
    return forked.groupBy("entry_id").agg(F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("latest")).where("sessions > 1")


def read_page(spark: SparkSession, d: str) -> DataFrame:
    """Every page of 100 characters of each entry, and where the next begins."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("chars") - 1, F.lit(0)), F.lit(100).cast("long")))
    c = conversations(spark, d).select("entry_id", "text", "chars", at.alias("at"))
    return c.select("entry_id", "at", F.expr("substring(text, CAST(at AS INT) + 1, 100)").alias("text"), F.when(F.col("at") + 100 < F.col("chars"), F.col("at") + 100).alias("next_offset"))


def _scoped(spark, d, scope, **more):
    c = conversations(spark, d)
    filters, _ = filters_for(Request("search", scope=scope, **more), Context("11", FOLDERS[1], HOME), FOLDERS)
    return c.where(filters.predicate()).select("entry_id", "cwd")


def scope_session(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d, "session")


def scope_project(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d, "project")


def scope_global(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d, "global", kind="user")


def project_root_all(spark: SparkSession, d: str) -> DataFrame:
    return project_roots(conversations(spark, d), HOME)


def under_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d)
    return c.where(under(F.col("cwd"), f"{HOME}/Apps/SHOP") | under(F.col("cwd"), f"{HOME}/Apps/sho_p/")).select("entry_id", "cwd")


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).withColumn("entry_id", F.concat(F.lit("t"), (F.col("turn") / 2).cast("int")))
    first = W.partitionBy("path", "entry_id").orderBy("offset")
    return c.withColumn("n", F.row_number().over(first)).where("n = 1").select("path", "entry_id", "offset")


def byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("entry_id", "offset", "length", "chars")


def tool_names_distinct(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).where("name IS NOT NULL")
    order = F.array_sort(F.collect_list(F.struct("offset", "name")))  # of one session
    return c.groupBy("session_id").agg(F.array_join(F.array_distinct(F.transform(order, lambda x: x["name"])), ",").alias("names"))


def _stats(spark, d):
    c = conversations(spark, d)
    journals = c.groupBy("path", "session_id", "cwd").agg(F.min("ts").alias("started_at"), F.sum(F.col("length") + 1).alias("bytes"), F.max("ts").alias("last"))
    return junk.journal_stats(journals, c)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d)
    return c.agg(
        F.countDistinct("path").alias("files"), F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("entries"), F.count_if(F.col("kind").isin(*SUMMARIES)).alias("summaries"),
        F.coalesce(F.sum(F.col("length") + 1), F.lit(0)).alias("indexed_bytes"),
    )


def journal_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("path", "session_id", "cwd", "started_at", "users", "messages", "replies", "summaries")


def distinct_cwds(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("cwd").dropna().distinct()


def junk_reason(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("path", junk.junk_reason(ROOTS).alias("reason"))


def _candidates(spark, d):
    stats = _stats(spark, d)
    files = stats.select("path", F.col("bytes").alias("size"), F.unix_millis(F.to_timestamp("last")).alias("modified")).where("path <> 'conv/5.jsonl'")
    now = 1767225600000 + 72 * 3_600_000
    return junk.candidates(stats.drop("bytes"), files, ["conv/12.jsonl"], now, ROOTS)


def gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("path", "cwd", "bytes", "modified_ms", "reason")


def gc_reason_summary(spark: SparkSession, d: str) -> DataFrame:
    return junk.by_reason(_candidates(spark, d))


def whitespace_flat(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("entry_id", F.md5(flat(F.col("text"))).alias("flat_md5"), F.md5(trimmed(F.concat(F.lit("\t "), F.col("text"), F.lit("\n")))).alias("trimmed_md5"))


def json_extract_entry(spark: SparkSession, d: str) -> DataFrame:
    """Lines are made from events: a header each hundredth, a broken line each thirtieth, else a message of some role."""
    e = table(spark, sf_dir=d, name="events")
    k, props, id_ = F.col("event_id"), F.col("props"), F.concat(F.lit("e"), F.col("event_id"))
    head = F.concat(F.lit('{"type":"'), F.when(k % 100 == 0, "session").when(k % 7 == 1, "compaction").when(k % 7 == 2, "custom_message").otherwise("message"), F.lit('","id":"'), id_, F.lit('",'))
    call = F.concat(F.lit('"message":{"role":"assistant","content":[{"type":"thinking","thinking":"x"},{"type":"text","text":" a\\nb "},{"type":"toolCall","name":"run","arguments":'), props, F.lit('},{"type":"image"}]}}'))
    body = (
        F.when(k % 7 == 1, F.concat(F.lit('"timestamp":"2026-01-01","summary":"sum '), k, F.lit('","tokensBefore":'), k, F.lit("}")))
        .when(k % 7 == 2, F.lit('"content":[{"type":"text","text":"hello"},7,null]}'))
        .when(k % 7 == 3, call)
        .when(k % 7 == 4, F.lit('"message":{"role":"toolResult","toolName":"grep","content":"[not a list]"}}'))
        .when(k % 7 == 5, F.lit('"message":{"role":"bashExecution","command":"ls","output":""}}'))
        .otherwise(F.concat(F.lit('"parentId":"p","message":{"role":"user","content":"  '), F.col("event_type"), F.lit(' "}}')))
    )
    line = F.when(k % 30 == 0, F.lit('{"type":')).when(k % 100 == 0, F.concat(head, F.lit('"cwd":"/w","timestamp":"t"}'))).otherwise(F.concat(head, body))
    out = with_entries(e.select("event_id", line.alias("line")))
    return out.select("event_id", F.col("header.session_id").alias("header"), F.col("entry.kind").alias("kind"), F.col("entry.role").alias("role"), F.col("entry.name").alias("name"), F.col("entry.text").alias("text"), F.col("entry.parent_id").alias("parent_id"), F.col("entry.tokens_before").alias("tokens_before"))


NAMES = (
    list_newest, list_kind_filter, list_role_filter, list_since_until, list_local_day, count_matches, summaries_list, find_entry, find_ambiguous, read_page, scope_session, scope_project, scope_global,
    project_root_all, under_case_insensitive, dedup_first_wins, byte_offsets, tool_names_distinct, status_counts, journal_stats, distinct_cwds, junk_reason, gc_candidates, gc_reason_summary,
    whitespace_flat, json_extract_entry,
)


def sql() -> dict[str, str]:
    cols = ", ".join(COLUMNS)
    e = lambda q: f"WITH {CONV_SQL}{q if q.startswith(",") else " " + q}"
    counts = "count(*) FILTER (WHERE kind = 'user') AS users, count(*) FILTER (WHERE kind = 'custom') AS messages, count(*) FILTER (WHERE kind = 'assistant') AS replies, count(*) FILTER (WHERE kind IN ('compaction', 'branch_summary')) AS summaries"
    stats = f"s AS (SELECT path, session_id, cwd, min(ts) AS started_at, max(ts) AS last, CAST(sum(length + 1) AS BIGINT) AS bytes, {counts} FROM e GROUP BY path, session_id, cwd)"
    reason = "CASE WHEN summaries > 0 THEN NULL WHEN cwd = '/tmp' OR starts_with(cwd, '/tmp/') THEN 'temporary folder' WHEN users = 0 AND messages = 0 THEN 'no instructions' WHEN replies <= 2 THEN 'two replies or fewer' END"
    modified = "epoch_ms(CAST(left(last, 23) AS TIMESTAMP))"
    found = f"g AS (SELECT path, cwd, bytes, {modified} AS modified_ms, {reason} AS reason FROM s WHERE {reason} IS NOT NULL AND path NOT IN ('conv/12.jsonl', 'conv/5.jsonl') AND {1767225600000 + 72 * 3_600_000} - {modified} >= 86400000)"
    space = "\\t\\n\\v\\f\\r "
    folders = f"f AS (SELECT DISTINCT cwd FROM e), p AS (SELECT f.cwd, a.cwd AS a FROM f JOIN f a ON f.cwd = a.cwd OR (starts_with(f.cwd, a.cwd || '/') AND len(string_split(a.cwd, '/')) > {len(HOME.split('/')) + 1}) WHERE starts_with(f.cwd, '{HOME}/') AND starts_with(a.cwd, '{HOME}/'))"
    local = "CAST(left(ts, 23) AS TIMESTAMP) - INTERVAL 5 HOUR"
    k = "event_id"
    return {
        "list_newest": e(f"SELECT {cols} FROM e {_PAGE} OFFSET 20"),
        "list_kind_filter": e(f"SELECT {cols} FROM e WHERE kind = 'tool_result' {_PAGE}"),
        "list_role_filter": e(f"SELECT {cols} FROM e WHERE role = 'assistant' AND kind IN ('assistant', 'tool_result') {_PAGE}"),
        "list_since_until": e(f"SELECT {cols} FROM e WHERE ts >= '2026-01-01T12:00:00.000Z' AND ts <= '2026-01-02T23:59:59.999Z'"),
        "list_local_day": e(f"SELECT entry_id, strftime({local}, '%Y-%m-%d') AS day, strftime({local}, '%m-%d %H:%M') AS shown FROM e WHERE CAST({local} AS DATE) = DATE '2026-01-02'"),
        "count_matches": e("SELECT count(*) AS total FROM e WHERE kind IN ('user', 'assistant') AND ts >= '2026-01-02'"),
        "summaries_list": e(f"SELECT {cols} FROM e WHERE kind IN ('compaction', 'branch_summary') {_PAGE}"),
        "find_entry": e(f"SELECT path, {cols}, chars, \"offset\", length FROM e WHERE entry_id = '7-1'"),
        "find_ambiguous": e("SELECT 'turn-' || turn AS entry_id, count(DISTINCT session_id) AS sessions, max(ts) AS latest FROM e GROUP BY turn HAVING count(DISTINCT session_id) > 1"),
        "read_page": e('SELECT entry_id, "at", substring(text, "at" + 1, 100) AS text, CASE WHEN "at" + 100 < chars THEN "at" + 100 END AS next_offset FROM (SELECT *, unnest(range(0, greatest(chars, 1), 100)) AS "at" FROM e) p'),
        "scope_session": e("SELECT entry_id, cwd FROM e WHERE session_id = '11'"),
        "scope_project": e(f"SELECT entry_id, cwd FROM e WHERE cwd = '{FOLDERS[0]}' OR lower(cwd) LIKE lower('{FOLDERS[0]}/') || '%'"),
        "scope_global": e("SELECT entry_id, cwd FROM e WHERE kind = 'user'"),
        "project_root_all": e(f", {folders} SELECT f.cwd, coalesce(arg_min(a, length(a)), f.cwd) AS project FROM f LEFT JOIN p USING (cwd) GROUP BY f.cwd"),
        "under_case_insensitive": e(f"SELECT entry_id, cwd FROM e WHERE cwd = '{HOME}/Apps/SHOP' OR starts_with(lower(cwd), lower('{HOME}/Apps/SHOP/')) OR cwd = '{HOME}/Apps/sho_p'"),
        "dedup_first_wins": e("SELECT path, 't' || (turn // 2) AS entry_id, min(\"offset\") AS \"offset\" FROM e GROUP BY path, turn // 2"),
        "byte_offsets": e('SELECT entry_id, "offset", length, chars FROM e'),
        "tool_names_distinct": e(", n AS (SELECT session_id, name, min(\"offset\") AS o FROM e WHERE name IS NOT NULL GROUP BY session_id, name) SELECT session_id, string_agg(name, ',' ORDER BY o) AS names FROM n GROUP BY session_id"),
        "status_counts": e("SELECT count(DISTINCT path) AS files, count(DISTINCT session_id) AS sessions, count(*) AS entries, count(*) FILTER (WHERE kind IN ('compaction', 'branch_summary')) AS summaries, CAST(coalesce(sum(length + 1), 0) AS BIGINT) AS indexed_bytes FROM e"),
        "journal_stats": e(f", {stats} SELECT path, session_id, cwd, started_at, users, messages, replies, summaries FROM s"),
        "distinct_cwds": e("SELECT DISTINCT cwd FROM e WHERE cwd IS NOT NULL"),
        "junk_reason": e(f", {stats} SELECT path, {reason} AS reason FROM s"),
        "gc_candidates": e(f", {stats}, {found} SELECT path, cwd, bytes, modified_ms, reason FROM g"),
        "gc_reason_summary": e(f", {stats}, {found} SELECT reason, count(*) AS journals, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY reason"),
        "whitespace_flat": e(f"SELECT entry_id, md5(trim(regexp_replace(text, '[{space}]+', ' ', 'g'))) AS flat_md5, md5(regexp_replace(text, '^[{space}]+|[{space}]+$', '', 'g')) AS trimmed_md5 FROM e"),
        "json_extract_entry": f"""SELECT {k}, CASE WHEN {k} % 30 <> 0 AND {k} % 100 = 0 THEN 'e' || {k} END AS header,
 CASE WHEN x THEN NULL WHEN {k} % 7 = 1 THEN 'compaction' WHEN {k} % 7 = 2 THEN 'custom' WHEN {k} % 7 = 3 THEN 'assistant' WHEN {k} % 7 = 4 THEN 'tool_result' WHEN {k} % 7 = 5 THEN 'bash' ELSE 'user' END AS kind,
 CASE WHEN x THEN NULL WHEN {k} % 7 = 1 THEN 'compaction' WHEN {k} % 7 = 2 THEN 'custom' WHEN {k} % 7 = 3 THEN 'assistant' WHEN {k} % 7 = 4 THEN 'toolResult' WHEN {k} % 7 = 5 THEN 'bashExecution' ELSE 'user' END AS role,
 CASE WHEN x THEN NULL WHEN {k} % 7 = 2 THEN 'custom' WHEN {k} % 7 = 3 THEN 'run' WHEN {k} % 7 = 4 THEN 'grep' WHEN {k} % 7 = 5 THEN 'bash' END AS name,
 CASE WHEN x THEN NULL WHEN {k} % 7 = 1 THEN 'sum ' || {k} WHEN {k} % 7 = 2 THEN 'hello' WHEN {k} % 7 = 3 THEN 'a' || chr(10) || 'b ' || chr(10) || 'run(' || replace(props, ' ', '') || ')' || chr(10) || '[image]'
   WHEN {k} % 7 = 4 THEN '[not a list]' WHEN {k} % 7 = 5 THEN '$ ls' ELSE trim(event_type) END AS text,
 CASE WHEN NOT x AND {k} % 7 IN (0, 6) THEN 'p' END AS parent_id, CASE WHEN NOT x AND {k} % 7 = 1 THEN CAST({k} AS DOUBLE) END AS tokens_before
FROM (SELECT *, {k} % 30 = 0 OR {k} % 100 = 0 AS x FROM events)""",
    }
