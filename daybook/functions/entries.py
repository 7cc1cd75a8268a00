"""Journal lines to headers and entries, as column expressions over the line's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import trimmed, utf16_length

# The kinds of entries.
KINDS = ("user", "assistant", "tool_result", "bash", "custom", "compaction", "branch_summary")
SUMMARIES = ("compaction", "branch_summary")



def _kind_of(v: Column, path: str) -> Column:
    """The JSON type at a path of a variant, as Spark names it (STRING, ARRAY<...>, ...), or null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    """The string at a path; null if what stands there is something else."""
    return F.when(_kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _blocks(line: Column, path: str) -> Column:
    """The objects of an array, as JSON text in the keys' own order."""
    found = F.from_json(F.get_json_object(line, path), "array<string>")
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda b: F.substring(F.ltrim(b), 1, 1) == "{")


def _block_text(b: Column) -> Column:
    kind = F.get_json_object(b, "$.type")
    call = F.concat(F.coalesce(F.get_json_object(b, "$.name"), F.lit("tool")), F.lit("("), F.coalesce(F.get_json_object(b, "$.arguments"), F.lit("{}")), F.lit(")"))
    return F.when(kind == "text", F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).when(kind == "toolCall", call).when(kind == "image", "[image]").otherwise("")


def content_text(line: Column, v: Column, path: str) -> Column:
    """What a reader sees of a content: the string, or its blocks' texts, tool calls and image marks, line by line."""
    parts = F.filter(F.transform(_blocks(line, path), _block_text), lambda t: t != "")
    return F.when(_kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string")).when(_kind_of(v, path).startswith("ARRAY"), F.array_join(parts, "\n")).otherwise("")


def tool_names(line: Column, path: str) -> Column:
    """Distinct names of the tools called, in the order of their first call, joined by commas; null if there are none."""
    calls = F.filter(_blocks(line, path), lambda b: F.get_json_object(b, "$.type") == "toolCall")
    names = F.transform(calls, lambda b: F.coalesce(F.get_json_object(b, "$.name"), F.lit("")))
    return F.when(F.size(calls) > 0, F.array_join(F.array_distinct(names), ","))


def with_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with the structs ``header`` (session_id, cwd, started_at) and ``entry``; null where a line has none. Lines
    that aren't JSON objects have neither."""
    held = lines.withColumn("_v", F.try_parse_json(F.col(line)))
    x, v = F.col(line), F.col("_v")
    s = lambda path: _string(v, path)
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    kind, id_ = s("$.type"), s("$.id")
    header = F.when((kind == "session") & id_.isNotNull(), F.struct(id_.alias("session_id"), or_empty(s("$.cwd")).alias("cwd"), or_empty(s("$.timestamp")).alias("started_at")))
    role = F.when(kind == "message", s("$.message.role"))
    content = content_text(x, v, "$.message.content")
    custom = F.coalesce(F.nullif(or_empty(s("$.customType")), F.lit("")), F.lit("custom"))
    command = F.nullif(or_empty(s("$.message.command")), F.lit(""))
    shell = F.concat_ws("\n", F.concat(F.lit("$ "), command), F.nullif(or_empty(s("$.message.output")), F.lit("")))
    number = F.when(_kind_of(v, "$.tokensBefore").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$.tokensBefore", "double"))
    none = F.lit(None).cast("string")
    what = (
        F.when(kind.isin(*SUMMARIES), F.struct(kind.alias("kind"), kind.alias("role"), none.alias("name"), or_empty(s("$.summary")).alias("text"), number.alias("tokens_before")))
        .when(kind == "custom_message", F.struct(F.lit("custom").alias("kind"), custom.alias("role"), custom.alias("name"), content_text(x, v, "$.content").alias("text"), F.lit(None).cast("double").alias("tokens_before")))
        .when(role == "user", F.struct(F.lit("user").alias("kind"), role.alias("role"), none.alias("name"), trimmed(content).alias("text"), F.lit(None).cast("double").alias("tokens_before")))
        .when(role == "assistant", F.struct(F.lit("assistant").alias("kind"), role.alias("role"), tool_names(x, "$.message.content").alias("name"), trimmed(content).alias("text"), F.lit(None).cast("double").alias("tokens_before")))
        .when(role == "toolResult", F.struct(F.lit("tool_result").alias("kind"), role.alias("role"), F.nullif(or_empty(s("$.message.toolName")), F.lit("")).alias("name"), content.alias("text"), F.lit(None).cast("double").alias("tokens_before")))
        .when(role == "bashExecution", F.struct(F.lit("bash").alias("kind"), role.alias("role"), F.lit("bash").alias("name"), shell.alias("text"), F.lit(None).cast("double").alias("tokens_before")))
    )
    out = held.withColumn("header", header).withColumn("_what", what)
    w = F.col("_what")
    entry = F.when(
        id_.isNotNull() & (w["text"] != ""),
        F.struct(
            id_.alias("entry_id"), s("$.parentId").alias("parent_id"), or_empty(s("$.timestamp")).alias("ts"), w["kind"].alias("kind"), w["role"].alias("role"), w["name"].alias("name"),
            w["text"].alias("text"), utf16_length(w["text"]).alias("chars"), w["tokens_before"].alias("tokens_before"),
        ),
    )
    return out.withColumn("entry", entry).drop("_v", "_what")
