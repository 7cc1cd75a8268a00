"""Benchmark decontamination by spaced-seed hashing.

Fixed masks each look at four of at most six consecutive tokens and ignore those between, so a substituted token leaves
the hash of every mask alone that ignores its place. The masks are all choices of four whose first is the first token:
wherever four of six tokens agree, some mask sees just four of these. At least ``MIN_MATCH`` of an item of nine or more
tokens can't agree without such a place, whichever tokens are substituted. The hashes of all places of the benchmark are
joined with those of all places of the documents. Every hit says how the two texts would lie against each other, and
there they are compared token by token. An overlap counts if at least ``MIN_MATCH`` of the item's tokens agree; or of
``LOCAL`` consecutive tokens of it; or of the item's tokens in order, where words were inserted or dropped, at offsets up
to ``BAND`` from the lie. Items of fewer than ``SHORT`` tokens are compared wherever one of their first tokens stands, of
as many that one must agree. The SQL lacks overlaps in order only.

Only DataFrame operations are used. A window is hashed in the scan's own stage, with no shuffle; only hits move, and
they are summed before they do. Benchmark and lies are broadcast if they were counted and are small, else joined by
shuffling.

Defined cases: null and empty texts have no tokens and match nothing; tokens are runs of letters and digits in lower
case, so case and punctuation don't matter; items without tokens match nothing; an item or document that repeats is
reported under each of its ids once; several places of one pair give the best one, whole items at one offset before
others, of equals the first; n_match counts the tokens that agree there, over the whole item; empty tables
give no rows; a document or item without id is left out; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import bare, fresh, small, stage, table

SHORT = 9
#: Places that each mask looks at: four of six, the first among them.
MASKS = tuple((0, *rest) for rest in combinations(range(1, 6), 3))
MIN_MATCH = 0.7
#: Tokens of a local overlap, and offsets to both sides of a lie that tokens may agree at in order.
LOCAL, BAND = 13, 3


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case."""
    parts = F.array_remove(F.split(F.lower(bare(text)), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _windows(texts: DataFrame, tokens: str) -> DataFrame:
    """A row for each place and mask: what texts has, place, seed; seed is null where the mask doesn't fit in what is
    left. All of it is compiled code: no function over arrays that would copy the tokens for each place."""
    places = texts.withColumn("place", F.explode(F.sequence(F.lit(0), F.size(tokens) - 1)))
    near = places.withColumns({f"_t{k}": F.get(F.col(tokens), F.col("place") + k) for k in range(6)})
    seed = lambda m, mask: F.when(F.col(f"_t{mask[-1]}").isNotNull(), F.xxhash64(F.lit(m), *[F.col(f"_t{k}") for k in mask]))
    return near.withColumn("seed", F.explode(F.array(*[seed(m, mask) for m, mask in enumerate(MASKS)]))).drop(*[f"_t{k}" for k in range(6)])


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_match): the best verified overlap of each document and item.

    docs: doc_id, text; items: item_id, text."""
    tests = stage(items.select("item_id", token_hashes(F.col("text")).alias("it")).where(F.size("it") > 0), "benchmark-items")
    seeds = stage(_windows(tests.where(F.size("it") >= SHORT), "it").select("seed", "item_id", F.col("place").alias("item_place")).where("seed IS NOT NULL").distinct(), "benchmark-seeds")
    hashed = docs.select("doc_id", token_hashes(F.col("text")).alias("dt"))
    hits = _windows(hashed.where(F.size("dt") > 0), "dt").select("doc_id", "place", "seed").join(small(seeds), "seed")
    lies = hits.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("start")).distinct()
    told = F.slice("it", F.lit(1), (F.size("it") - F.ceil(MIN_MATCH * F.size("it")) + 1).cast("int"))
    brief = tests.where(F.size("it") < SHORT).select("item_id", F.posexplode(told).alias("k", "first"))
    if not brief.isEmpty():
        places = hashed.select("doc_id", F.posexplode("dt").alias("place", "first"))
        lies = lies.unionByName(places.join(small(stage(brief, "benchmark-short")), "first").select("doc_id", "item_id", (F.col("place") - F.col("k")).alias("start")).distinct())
    lies = stage(lies, "benchmark-lies")
    same = F.transform("it", lambda x, k: F.coalesce(F.get(F.col("dt"), F.col("start") + k) == x, F.lit(False)))
    laid = hashed.join(small(lies), "doc_id").join(small(tests), "item_id").withColumn("same", same).withColumn("n_tokens", F.size("it"))
    agree = lambda flags: F.size(F.filter(flags, lambda x: x))
    laid = laid.withColumn("n_match", agree(F.col("same"))).withColumn("whole", F.col("n_match") >= MIN_MATCH * F.col("n_tokens"))
    local = F.exists(F.sequence(F.lit(1), F.col("n_tokens") - LOCAL + 1), lambda i: agree(F.slice("same", i, LOCAL)) >= MIN_MATCH * LOCAL)
    laid = laid.withColumn("local", F.when(F.col("whole") | (F.col("n_tokens") < LOCAL), F.col("whole")).otherwise(local))
    laid = laid.withColumn("chained", F.when(F.col("whole"), 0).otherwise(_chained()))
    chained = F.col("chained") >= MIN_MATCH * F.col("n_tokens")
    good = laid.where(F.col("local") | chained).withColumn("n_match", F.when(chained, F.col("chained")).otherwise(F.col("n_match")))
    best = F.max(F.struct("whole", "n_match", (-F.col("start")).alias("s"), "n_tokens")).alias("b")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n_tokens").cast("long").alias("n_tokens"), F.col("b.n_match").cast("long").alias("n_match")
    )


def _chained() -> Column:
    """Tokens of column ``it`` that agree in order with ``dt`` at offsets up to ``BAND`` from ``start``: the longest common
    subsequence in a band, kept for each offset while the item is gone through."""
    width = 2 * BAND + 1

    def step(held: Column, k: Column) -> Column:
        best, out = [], []
        for d in range(width):
            agrees = F.coalesce((F.get(F.col("dt"), F.col("start") + k + d - BAND) == F.get(F.col("it"), k)).cast("int"), F.lit(0))
            best += [F.get(held, F.lit(d)) + agrees, *([F.get(held, F.lit(d + 1))] if d + 1 < width else [])]
            out.append(F.greatest(*best))
        return F.array(*out)

    return F.array_max(F.aggregate(F.sequence(F.lit(0), F.size("it") - 1), F.array(*[F.lit(0)] * width), step))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that overlap with no benchmark item. Rows are told apart by two hashes of their text,
    so it doesn't matter whether they have ids."""
    own = F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    found = overlaps(docs.where("text <> ''").select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    key = fresh("_leak", docs.columns)
    leaks = stage(found.select(F.col("doc_id").alias(key)).distinct(), "benchmark-leaks")
    return docs.join(small(leaks), own == F.col(key), "left_anti")


def op6_sql() -> str:
    seeds = " UNION ALL ".join(
        "SELECT id, p, {m} AS m, {k} AS seed FROM w WHERE p + {last} <= len(t)".format(m=m, last=mask[-1], k=" || '|' || ".join(f"t[p + {k}]" for k in mask)) for m, mask in enumerate(MASKS)
    )
    cut = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    side = lambda name, key: f"""{name}w AS (SELECT {key} AS id, t, unnest(range(1, CAST(len(t) AS BIGINT) + 1)) AS p FROM {name}),
{name}s AS ({seeds.replace('FROM w', f'FROM {name}w')})"""  # noqa: E731
    told = "len(list_filter(range(1, CAST(len(it) AS BIGINT) + 1), lambda k: k + s >= 1 AND coalesce(dt[k + s] = it[k], false)))"
    near = f"""list_bool_or(list_transform(range(1, CAST(len(it) AS BIGINT) - {LOCAL} + 2), lambda f:
          len(list_filter(range(f, f + {LOCAL}), lambda k: k + s >= 1 AND coalesce(dt[k + s] = it[k], false))) >= {MIN_MATCH} * {LOCAL}))"""
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {cut} AS t FROM documents WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT item_id, {cut} AS t FROM benchmark WHERE item_id IS NOT NULL),
{side('d', 'doc_id')},
{side('b', 'item_id')},
e AS (SELECT item_id AS id, unnest(range(1, CAST(len(t) - ceil({MIN_MATCH} * len(t)) AS BIGINT) + 2)) AS p, t FROM b WHERE len(t) BETWEEN 1 AND {SHORT - 1}),
h AS (SELECT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS s FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed WHERE bs.id NOT IN (SELECT id FROM e)
      UNION SELECT dw.id, e.id, dw.p - e.p FROM dw JOIN e ON dw.t[dw.p] = e.t[e.p]),
l AS (SELECT DISTINCT h.doc_id, h.item_id, s, d.t AS dt, b.t AS it FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
v AS (SELECT doc_id, item_id, s, len(it) AS n, {told} AS m, len(it) >= {LOCAL} AND coalesce({near}, false) AS near FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m >= {MIN_MATCH} * n DESC, m DESC, s) AS r FROM v WHERE m >= {MIN_MATCH} * n OR near)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start, CAST(n AS BIGINT) AS n_tokens, CAST(m AS BIGINT) AS n_match FROM r WHERE r = 1
"""
