r"""Chat formatting: records of many layouts to canonical turns, and turns to one training text with a loss mask.

A record is a JSON object. Its fingerprint is a hash of the field paths in it: the names of its fields, and of the fields of
the objects in them (``messages[].role``). Only paths that some layout knows are hashed, so ids and other extra fields don't
matter. The fingerprint selects a ``Layout``, which only declares where roles and texts stand; a record whose fingerprint no
layout has is told of by ``unknown_layouts`` and gets null turns.

A ``Template`` puts each turn between marks. Inside roles and texts every place at which a control string begins (any
template's mark, or a token of ``CONTROL``) gets ``ESCAPE`` after its first character, and an ``ESCAPE`` that was there is
doubled, so marks occur as marks only and what was written can be read back. The loss mask has for each turn how many code
points are skipped, learned, and skipped again; the learned ones are the texts of the learned roles as they stand in the
output. Turn by turn it covers the whole output, so it needs no running sum over a conversation of any length.

Only DataFrame functions are used. A record is one row, so a conversation must fit in one; that is the format's own limit.

Defined cases: a null role or text is empty; a conversation without turns is the empty text; turns with one number follow the
order of role and text, and rows that repeat are turns of their own; rows without conv_id form one conversation with a null
conv_id; texts of any length are formatted whole; a record that is no JSON object has no paths and no layout; a field that
is null, or missing in some item of a list only, is an empty text; a list with items that aren't objects fits no layout; an empty table gives no conversation (the query adds its fixed one).
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import bare, let, table

#: What follows a list's name in a path where the list has items that aren't objects.
SCALARS = "[]="
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout has its turns: in the objects of the list ``items`` (fields ``role`` and ``text``), or in fields of
    their own, in order: ``fields`` has (role, field, further fields that may be there and are joined by an empty line)."""

    name: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    #: Fields that may be missing.
    may: tuple[str, ...] = ()

    def paths(self) -> list[tuple[str, ...]]:
        """The sorted paths of each record that this layout fits."""
        if self.items:
            # A list without items has no paths below it.
            own = f"{self.items}[]"
            return [(own,), tuple(sorted((own, f"{own}.{self.role}", f"{own}.{self.text}")))]
        free = [*self.may, *(m for _, _, more in self.fields for m in more)]
        sure = [f for _, f, _ in self.fields if f not in self.may]
        return [tuple(sorted((*sure, *some))) for n in range(len(free) + 1) for some in itertools.combinations(free, n)]

    def known(self) -> set[str]:
        """The paths that decide whether this layout fits: its own, and that a list has more than objects."""
        return {p for way in self.paths() for p in way} | ({self.items + SCALARS} if self.items else set())


# Public layouts of chat and instruction data.
LAYOUTS = (
    Layout("messages", "messages", "role", "content"),
    Layout("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Layout("prompt", fields=(("system", "system", ()), ("user", "prompt", ()), ("assistant", "completion", ())), may=("system",)),
    Layout("response", fields=(("system", "system_prompt", ()), ("user", "question", ()), ("assistant", "response", ())), may=("system_prompt",)),
    Layout("instruction", fields=(("user", "instruction", ("input",)), ("assistant", "output", ()))),
)


def _names(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def paths(record: Column) -> Column:
    """The sorted distinct field paths of a JSON object, two levels deep."""
    held = F.from_json(record, "map<string,string>")

    def below(name: Column, value: Column) -> Column:
        items = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
        listed = F.flatten(F.transform(items, lambda i: F.when(F.substring(i, 1, 1) == "{", F.transform(_names(i), lambda k: F.concat(name, F.lit("[]."), k))).otherwise(F.array(F.concat(name, F.lit(SCALARS))))))
        inside = F.transform(_names(value), lambda k: F.concat(name, F.lit("."), k))
        first = F.substring(value, 1, 1)
        return F.when(first == "[", F.array_append(F.array_distinct(listed), F.concat(name, F.lit("[]")))).when(first == "{", F.array_append(inside, name)).otherwise(F.array(name))

    found = F.transform(F.map_entries(held), lambda e: below(e["key"], F.coalesce(e["value"], F.lit(""))))
    return F.when(F.substring(F.trim(record), 1, 1) == "{", F.array_sort(F.array_distinct(F.flatten(found))))


def fingerprint(found: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """A hash of those of the paths that any layout knows."""
    known = sorted(set().union(*(x.known() for x in layouts)))
    return F.xxhash64(F.array_sort(F.array_intersect(F.coalesce(found, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(bare(role).alias("role"), bare(text).alias("text"))


def _mapped(layout: Layout, record: Column) -> Column:
    """The turns of a record of this layout."""
    if layout.items:
        held = F.from_json(record, f"struct<`{layout.items}`:array<struct<`{layout.role}`:string,`{layout.text}`:string>>>")[layout.items]
        renamed = lambda r: F.coalesce(F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair])[r], r) if layout.roles else r
        return F.transform(F.coalesce(held, F.array().cast(held_type(layout))), lambda m: _turn(renamed(m[layout.role]), m[layout.text]))
    names = [*layout.may, *(x for _, f, more in layout.fields for x in (f, *more))]
    held = F.from_json(record, "struct<" + ",".join(f"`{n}`:string" for n in dict.fromkeys(names)) + ">")

    def turns(h: Column) -> Column:
        own = []
        for role, name, more in layout.fields:
            text = F.concat(bare(h[name]), *[F.when(bare(h[m]) != "", F.concat(F.lit("\n\n"), h[m])).otherwise("") for m in more])
            there = h[name].isNotNull() if name in layout.may else F.lit(True)
            own.append(F.when(there, _turn(F.lit(role), text)))
        return F.array_compact(F.array(*own))

    return let(held, turns)


def held_type(layout: Layout) -> str:
    return f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records (record: JSON) with fingerprint, layout (null if none fits) and turns."""
    found = records.withColumn("fingerprint", fingerprint(paths(F.col("record")), layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        mine = F.col("fingerprint").isin([])
        for way in layout.paths():
            mine = mine | (F.col("fingerprint") == F.xxhash64(F.array(*[F.lit(p) for p in way])))
        name, turns = F.when(mine, layout.name).otherwise(name), F.when(mine, _mapped(layout, F.col("record"))).otherwise(turns)
    return found.withColumns({"layout": name, "turns": turns})


def unknown_layouts(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """paths, records: what the records have that no layout fits."""
    told = canonical(records, layouts).where("layout IS NULL").select(paths(F.col("record")).alias("paths"))
    return told.groupBy("paths").agg(F.count(F.lit(1)).alias("records"))


@dataclass(frozen=True)
class Template:
    """Each turn is ``begin``, role, ``between``, text, ``end``."""

    begin: str
    between: str
    end: str
    learned: tuple[str, ...] = ("assistant",)


# Marks of public chat templates, and tokens that tokenizers take for control.
CHATML = Template("<|im_start|>", "<|im_sep|>", "<|im_end|>")
HEADERS = Template("<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|system|>", "<|user|>", "<|assistant|>", "<pad>", "<unk>")
#: A private-use character.
ESCAPE = "\ue000"


def control_strings() -> list[str]:
    return sorted({*CONTROL, *(m for t in (CHATML, HEADERS) for m in (t.begin, t.between, t.end))})


def escaped(text: Column) -> Column:
    alternatives = "|".join(re.sub(r"([^\w])", r"\\\1", c) for c in control_strings())
    marked = F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), f"(?=(?:{alternatives}))(.)", f"$1{ESCAPE}")
    firsts = sorted({c[0] for c in control_strings()})
    plain = ~text.contains(ESCAPE)
    for c in firsts:
        plain = plain & ~text.contains(c)
    return F.when(plain, text).otherwise(marked)


def unescaped(text: Column) -> Column:
    """Doubled escapes are one, single ones nothing."""
    return F.when(text.contains(ESCAPE), F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")).otherwise(text)


def formatted(canon: DataFrame, template: Template = CHATML) -> DataFrame:
    """canon (turns) with formatted and mask: for each turn skip, learn and rest, in code points; turns goes."""
    turn = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["role"].isin(*template.learned).alias("learned")))
    n = F.length
    piece = lambda t: F.concat(F.lit(template.begin), t["role"], F.lit(template.between), t["text"], F.lit(template.end))

    def mask(t: Column) -> Column:
        head, text = n(t["role"]) + len(template.begin) + len(template.between), n(t["text"])
        learn = F.when(t["learned"], text).otherwise(0)
        return F.struct(head.alias("skip"), learn.alias("learn"), (text - learn + len(template.end)).alias("rest"))

    both = canon.withColumn("_t", turn)
    return both.withColumns({"formatted": F.array_join(F.transform("_t", piece), ""), "mask": F.transform("_t", mask)}).drop("_t", "turns")


def pieces(text: Column, template: Template = CHATML) -> Column:
    """The output's turns as they stand in it, without their end marks."""
    cut = F.split(text, re.sub(r"([^\w])", r"\\\1", template.end), -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def read_back(text: Column, template: Template = CHATML) -> Column:
    """The turns that an output was made of."""
    def turn(piece: Column) -> Column:
        at = F.locate(template.between, piece)
        role = F.substring(piece, F.lit(len(template.begin) + 1), at - 1 - len(template.begin))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(piece, at + len(template.between), n_all(piece))).alias("text"))

    n_all = F.length
    return F.transform(pieces(text, template), turn)


def learned(text: Column, mask: Column, template: Template = CHATML) -> Column:
    """All that the mask has learned, unescaped, nothing between."""
    each = F.zip_with(pieces(text, template), mask, lambda p, m: unescaped(F.substring(p, m["skip"] + 1, m["learn"])))
    return F.array_join(each, "")


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id, record: each conversation as a JSON object of one of the layouts, whichever its turns fit; the number of the
    conversation decides between those that do."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", bare(F.col("role")).alias("role"), bare(F.col("text")).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    held = conversations.groupBy("conv_id").agg(turns.alias("t")).withColumn("roles", F.transform("t", lambda t: t["role"]))
    text = lambda i: F.col("t")[i]["text"]
    to_json = lambda *fields: F.to_json(F.struct("conv_id", *fields), {"ignoreNullFields": "false"})
    ask, told = F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    choice = F.coalesce(F.pmod(F.col("conv_id"), F.lit(3)), F.lit(0))
    names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    foreign = F.array_contains("roles", "human") | F.array_contains("roles", "gpt")
    record = (
        F.when((F.col("roles") == ask) & (choice == 0), to_json(text(0).alias("prompt"), text(1).alias("completion")))
        .when((F.col("roles") == ask) & (choice == 1), to_json(text(0).alias("question"), text(1).alias("response")))
        .when(F.col("roles") == ask, to_json(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output")))
        .when((F.col("roles") == told) & (choice == 0), to_json(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion")))
        .when((F.col("roles") == told) & (choice == 1), to_json(text(0).alias("system_prompt"), text(1).alias("question"), text(2).alias("response")))
        .when((choice == 2) & ~foreign, to_json(F.transform("t", lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")))
        .otherwise(to_json(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    )
    return held.select("conv_id", record.alias("record"))


# The conversation that the query adds.
PLANTED = (-7, (("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    conv_id, turns = PLANTED
    rows = rows.unionByName(spark.range(1).select(F.lit(conv_id).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, (r, t) in enumerate(turns)]))))
    out = formatted(canonical(records_of(rows)).select("conv_id", "turns"))
    back = out.select("conv_id", read_back(F.col("formatted")).alias("t"), learned(F.col("formatted"), F.col("mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op13_sql() -> str:
    def added(x: str) -> str:
        """Characters that escaping adds: one for each control string, none of which begins inside another, and each escape."""
        return " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in (*control_strings(), ESCAPE))

    conv_id, turns = PLANTED
    planted = " UNION ALL ".join(f"SELECT {conv_id}, {i}, '{r}', '{t}'" for i, (r, t) in enumerate(turns))
    marks = len(CHATML.begin + CHATML.between + CHATML.end)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {planted})),
s AS (SELECT *, length(role) + length(text) + {marks} + {added("role")} + {added("text")} AS size FROM t),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(size) AS size FROM s GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n AS n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g
"""
