"""A trie of conversations by shared first turns, from digests of blocks of turns.

Every conversation is rebuilt from the first turns of the first one of its five and its own later turns. Its turns are cut
into blocks of ``BLOCK``; a block's digest stands for its turns, and the digests of all blocks before it for its prefix.
Conversations are grouped by prefix and block first. Where all that go on from a prefix go on with the same block, the
block's turns are a chain, taken from one of them. Only where blocks differ are the turns inside compared one by one.

Sums over subtrees need no walk: each node belongs to its smallest conversation, whose nodes are a path, so the paths are
a tree with a row for each conversation. Totals of whole subtrees of that tree are found by doubling (each round twice as
many generations, so as many rounds as the logarithm of its height), and sums along each path by windows.

Digests are pairs of 64-bit hashes; a prefix is the exclusive or of its blocks' hashes, each with its number, so it can be
summed piece by piece. Texts are hashed where they are read and never shuffled. One conversation may hold any share of all
rows: places, prefixes and sums along it are found by stretches of ``STRETCH`` first, then inside each. The list of the
conversations that end at a node is hashed as it streams by, sorted, so its length doesn't matter for memory.

Defined cases: a null role or text is empty; turns of one conversation with the same number follow the order of their
hashes, and so do rows that repeat (each is a turn); null turns come first; rows without conv_id are left out; the
conversation's remainder by five is Spark's (it has the sign of conv_id); an empty table has no nodes, not even a root;
other columns are ignored. A stretch of turns with one number is ordered by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import bare, small, stage, table

BLOCK, FAMILY, LENT = 4, 5, 9
#: Turns, or blocks, of one conversation that are numbered, or summed, together.
STRETCH = 4096
KEY = ("depth", "kx", "ky")
NONE = hashlib.sha256(b"").hexdigest()


def lent(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(LENT)).cast("int")


def _pair(*what: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *what), F.xxhash64(F.lit(2), *what)


def _stretch(turn: Column) -> Column:
    """Null turns are a stretch of their own, before all others."""
    return F.coalesce(F.floor(turn / STRETCH).cast("long"), F.lit(-(2**62)))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, x, y, bytes): the turns of the rebuilt conversations, from 1; and (conv): all conversations."""
    x, y = _pair(bare(F.col("role")), bare(F.col("text")))
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), turn.alias("turn"), _stretch(turn).alias("part"), x.alias("x"), y.alias("y"), F.octet_length(bare(F.col("text"))).cast("long").alias("bytes"))
    parts = stage(rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size")), "trie-parts")
    sizes = parts.groupBy("conv").agg(F.sum("size").alias("n")).withColumn("first", F.expr(f"conv - conv % {FAMILY}")).withColumn("h", lent(F.col("conv")))
    # At most nine conversations have one first conversation.
    families = sizes.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("conv", "h"))).alias("takers"), F.max(F.when(F.col("conv") == F.col("first"), F.col("n"))).alias("base"))
    about = sizes.join(families, "first").select("conv", "h", (F.col("h") - F.least(F.col("h"), F.coalesce("base", F.lit(0)))).alias("shift"), F.when(F.col("conv") == F.col("first"), F.col("takers")).alias("takers"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("before", before).join(about, "conv").drop("size")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "x", "y"))
    placed = rows.join(starts, ["conv", "part"]).withColumn("pos", F.col("before") + place)
    own = F.when(F.col("pos") > F.col("h"), F.array(F.struct(F.col("conv"), (F.col("pos") - F.col("shift")).alias("pos"))))
    given = F.when((F.col("pos") < LENT) & F.col("takers").isNotNull(), F.transform(F.filter("takers", lambda t: t["h"] >= F.col("pos")), lambda t: F.struct(t["conv"].alias("conv"), F.col("pos").alias("pos"))))
    none = F.array().cast("array<struct<conv:bigint,pos:bigint>>")
    out = placed.select("x", "y", "bytes", F.explode(F.concat(F.coalesce(own, none), F.coalesce(given, none))).alias("t"))
    return out.select("t.conv", "t.pos", "x", "y", "bytes"), sizes.select("conv")


def _before(df: DataFrame, of: str, at: str, values: dict[str, str], how, later: bool = False) -> DataFrame:
    """df with, for each of ``values`` (new name: column), what ``how`` gathers of the rows of the same ``of`` that stand
    before (later: after) in ``at``. Rows are gathered by stretches first, so a long path is no single group."""
    edge = (1, Window.unboundedFollowing) if later else (Window.unboundedPreceding, -1)
    cut = df.withColumn("_s", F.floor(F.col(at) / STRETCH))
    sums = cut.groupBy(of, "_s").agg(*[how(c).alias(f"_{name}") for name, c in values.items()])
    outer = Window.partitionBy(of).orderBy("_s").rowsBetween(*edge)
    sums = sums.select(of, "_s", *[F.coalesce(how(f"_{name}").over(outer), F.lit(0)).alias(f"_{name}") for name in values])
    inner = Window.partitionBy(of, "_s").orderBy(at).rowsBetween(*edge)
    both = lambda a, b: a.bitwiseXOR(b) if how is F.bit_xor else a + b
    joined = cut.join(sums, [of, "_s"])
    return joined.select(*df.columns, *[both(F.coalesce(how(c).over(inner), F.lit(0)), F.col(f"_{name}")).alias(name) for name, c in values.items()])


def blocks(turns: DataFrame) -> DataFrame:
    """conv, block (from 0), turns, bx, by (the block's digest), px, py (of all blocks before it), qx, qy (with it)."""
    held = turns.groupBy("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "bytes"))).alias("turns"))
    held = held.withColumn("turns", F.transform("turns", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["bytes"].alias("bytes"))))
    bx, by = _pair(F.transform("turns", lambda t: F.struct(t["x"], t["y"])))
    held = held.withColumns({"bx": bx, "by": by})
    sx, sy = _pair(F.col("block"), F.col("bx"), F.col("by"))
    held = _before(held.withColumns({"_x": sx, "_y": sy}), "conv", "block", {"px": "_x", "py": "_y"}, F.bit_xor)
    return held.withColumns({"qx": F.col("px").bitwiseXOR(F.col("_x")), "qy": F.col("py").bitwiseXOR(F.col("_y"))}).drop("_x", "_y")


def _inside(n: Column) -> Column:
    """Keys of the first n turns of a block after its prefix; all of a full block have the prefix's key after it."""
    x, y = _pair(F.col("block"), F.col("px"), F.col("py"), F.transform(F.slice("turns", 1, n), lambda t: F.struct(t["x"], t["y"])))
    whole = n == BLOCK
    return F.struct(F.when(n == 0, F.col("px")).when(whole, F.col("qx")).otherwise(x).alias("x"), F.when(n == 0, F.col("py")).when(whole, F.col("qy")).otherwise(y).alias("y"))


def _turn_rows(edges: DataFrame) -> DataFrame:
    """A row for each turn of each block: the keys of the turns up to it and before it."""
    rows = edges.select("*", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("t"))
    rows = rows.select((F.col("block") * BLOCK + F.col("t")).alias("depth"), _inside(F.col("t")).alias("k"), _inside(F.col("t") - 1).alias("j"), "conv", "n_convs", F.element_at("turns", F.col("t"))["bytes"].alias("bytes"))
    return rows.select("depth", F.col("k.x").alias("kx"), F.col("k.y").alias("ky"), F.col("j.x").alias("jx"), F.col("j.y").alias("jy"), "conv", "n_convs", "bytes")


def nodes_of(held: DataFrame) -> DataFrame:
    """depth, kx, ky (its key), jx, jy (its parent's), conv, n_convs, bytes: every node below the root. held: blocks."""
    prefix = ["block", "px", "py"]
    edges = stage(held.groupBy(*prefix, "bx", "by", "qx", "qy").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.first("turns").alias("turns")), "trie-edges")
    ways = edges.groupBy(*prefix).agg(F.count(F.lit(1)).alias("_ways"), F.first(F.struct("qx", "qy", "n_convs", "conv", "turns")).alias("e"))
    chains = _turn_rows(ways.where("_ways = 1").select(*prefix, "e.*"))
    # Many blocks may follow one prefix: Spark splits such a key's rows when it joins them.
    parted = stage(ways.where("_ways > 1").select(*prefix), "trie-parted")
    met = _turn_rows(edges.join(small(parted), prefix, "left_semi")).groupBy(*KEY, "jx", "jy").agg(F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.first("bytes").alias("bytes"))
    columns = [*KEY, "jx", "jy", "conv", "n_convs", "bytes"]
    return chains.select(*columns).unionByName(met.select(*columns))


def ends_of(held: DataFrame, everyone: DataFrame) -> DataFrame:
    """depth, kx, ky, ends_sha256: of the nodes at which conversations end."""
    last = held.withColumn("k", _inside(F.size("turns"))).groupBy("conv").agg(F.max(F.struct("block", F.size("turns").alias("n"), "k")).alias("l"))
    last = last.select("conv", (F.col("l.block") * BLOCK + F.col("l.n")).alias("depth"), F.col("l.k.x").alias("kx"), F.col("l.k.y").alias("ky"))
    ended = everyone.join(last, "conv", "left").select("conv", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("kx", F.lit(0)).cast("long").alias("kx"), F.coalesce("ky", F.lit(0)).cast("long").alias("ky"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in now), pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"])
        for batch in batches:
            out = []
            for depth, kx, ky, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv")), strict=True):
                if (depth, kx, ky) == now:
                    digest.update(b",%d" % conv)
                    continue
                if now is not None:
                    out.append(row())
                now, digest = (depth, kx, ky), hashlib.sha256(b"%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in out]) for i in range(len(KEY) + 1)], [*KEY, "ends_sha256"])
        if now is not None:
            yield row()

    return ended.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(hashed, "depth long, kx long, ky long, ends_sha256 string")


def whole_totals(paths: DataFrame) -> DataFrame:
    """conv, parent, at, leaves, saved of whole subtrees. paths: the same of each path alone; parent: null under the root's."""
    up = stage(paths.withColumn("above", F.col("parent")), "trie-paths")
    while not up.where(F.col("above").isNotNull()).isEmpty():
        below = up.where(F.col("above").isNotNull()).groupBy(F.col("above").alias("conv")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        higher = small(stage(up.select(F.col("conv").alias("above"), F.col("above").alias("_above")), "trie-above"))
        summed = up.join(below, "conv", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))}).drop("_l", "_s")
        up = stage(summed.join(higher, "above", "left").drop("above").withColumnRenamed("_above", "above"), "trie-paths")
    return up.drop("above")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    conversations: conv_id, turn, role, text."""
    turns, everyone = rebuilt(conversations)
    everyone = stage(everyone, "trie-conversations")
    held = stage(blocks(turns), "trie-blocks")
    ends = stage(ends_of(held, everyone), "trie-ends")
    zero = lambda name: F.lit(0).cast("long").alias(name)
    root = everyone.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(*[zero(c) for c in (*KEY, "jx", "jy")], "conv", "n_convs", zero("bytes"))
    nodes = stage(nodes_of(held).withColumn("depth", F.col("depth").cast("long")).unionByName(root), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("jx").alias("kx"), F.col("jy").alias("ky")).agg(F.count(F.lit(1)).alias("n_children"))
    above = small(stage(nodes.join(kids, list(KEY)).select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("jx"), F.col("ky").alias("jy"), F.col("conv").alias("parent")), "trie-parents"))
    full = nodes.join(kids, list(KEY), "left").join(ends, list(KEY), "left").join(above, ["depth", "jx", "jy"], "left")
    full = stage(full.select(
        "depth", "conv", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"),
    ), "trie-full")
    tops = full.where("depth > 0 AND parent <> conv").select("conv", "parent", (F.col("depth") - 1).alias("at"))
    sums = full.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    # The root's own path is no part of this: nobody asks for what hangs on it but the path itself.
    crown = full.where("depth = 0").select(F.col("conv").alias("parent"), F.lit(True).alias("_crown"))
    paths = tops.join(sums, "conv").join(F.broadcast(crown), "parent", "left")  # one row
    totals = whole_totals(paths.select("conv", F.when(F.col("_crown").isNull(), F.col("parent")).alias("parent"), "at", "leaves", "saved", F.col("parent").alias("on")))
    hung = totals.groupBy(F.col("on").alias("conv"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    laid = full.join(hung, ["conv", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("_l", F.lit(0)), "own": F.col("own") + F.coalesce("_s", F.lit(0))}).drop("_l", "_s")
    summed = _before(laid, "conv", "depth", {"_leaves": "leaf", "_saved": "own"}, F.sum, later=True)
    return summed.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", (F.col("_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("_saved") + F.col("own")).alias("saved_tokens"), "ends_sha256",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_sql() -> str:
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {step}), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS w FROM t GROUP BY c),
ids AS (SELECT c, w, c - c % {FAMILY} AS base, {crc} % {LENT} AS h FROM lists),
r AS (SELECT ids.c, list_concat(CASE WHEN b.c IS NULL THEN ids.w[1:0] ELSE b.w[1:ids.h] END, ids.w[ids.h + 1:]) AS w FROM ids LEFT JOIN lists b ON b.c = ids.base),
m AS (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM r),
nodes AS MATERIALIZED (SELECT d, w[1:d] AS k, min(c) AS conv, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(w) = d) AS ends FROM m GROUP BY ALL),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
held AS MATERIALIZED (SELECT nodes.*, coalesce(kids, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(k[d].text) END AS saved FROM nodes LEFT JOIN kids USING (d, k)),
up AS (SELECT *, unnest(range(0, d + 1)) AS a FROM held),
sums AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM up GROUP BY ALL)
SELECT held.conv AS conv_id, held.d AS depth, p.conv AS parent_conv_id, held.n AS n_convs, held.kids AS n_children, leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(held.ends, '')) AS ends_sha256
FROM held JOIN sums USING (d, k) LEFT JOIN nodes p ON p.d = held.d - 1 AND p.k = held.k[1:held.d - 1]
"""
