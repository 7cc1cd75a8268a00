"""Phrase search: matches from texts or from postings, BM25, all or any phrases, candidates, rerank, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.dates import age_months
from daybook.functions.text import let, phrase_count, tokens
from daybook.plans.scope import Filters

# BM25's constants, the page, and the candidates that are reranked.
K1, B = 1.2, 0.75
PAGE, CANDIDATES = 20, 400
LEAST_IDF = 1e-6


def newest_first() -> list[Column]:
    """A total order, so that pages never overlap."""
    return [F.desc("ts"), F.asc("path"), F.desc("offset")]


def matches_in_texts(entries: DataFrame, wanted: list[tuple[str, ...]], text: str = "text") -> DataFrame:
    """entries with dl (tokens) and tf (an array: how often each phrase occurs)."""
    both = let(tokens(F.col(text)), lambda tk: F.struct(F.size(tk).alias("dl"), F.array(*[phrase_count(tk, p) for p in wanted]).alias("tf")))
    return entries.withColumn("_m", both).select("*", "_m.dl", "_m.tf").drop("_m")


def matches_in_postings(postings: DataFrame, wanted: list[tuple[str, ...]], keys: tuple[str, ...] = ("path", "entry_id")) -> DataFrame:
    """keys and tf, of the entries that have at least one phrase. postings: keys, term, positions. Only the terms asked
    for are read; a phrase is where the positions of its terms, each set back by its place, meet."""
    terms = sorted({t for p in wanted for t in p})
    read = postings.where(F.col("term").isin(*terms))
    slots = read.groupBy(*keys).agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)])
    at = {t: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, t in enumerate(terms)}
    back = lambda t, k: F.transform(at[t], lambda x: x - k)
    starts = [reduce(F.array_intersect, [back(t, k) for k, t in enumerate(p)]) for p in wanted]
    return slots.select(*keys, F.array(*[F.size(s) for s in starts]).alias("tf")).where(F.exists("tf", lambda x: x > 0))


def frequencies(hits: DataFrame, wanted: list[tuple[str, ...]], keys: tuple[str, ...]) -> DataFrame:
    """keys and tf, of the entries that have at least one phrase. hits: keys, term, place (a row for each occurrence). The
    places of a term are gathered only where a phrase has several."""
    joint = sorted({t for p in wanted if len(p) > 1 for t in p})
    own = sorted({p[0] for p in wanted if len(p) == 1})
    slots = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_"), *[F.count_if(F.col("term") == t).alias(f"n{i}") for i, t in enumerate(own)], *[F.collect_list(F.when(F.col("term") == t, F.col("place"))).alias(f"p{i}") for i, t in enumerate(joint)])
    back = lambda t, k: F.transform(F.col(f"p{joint.index(t)}"), lambda x: x - k)
    count = lambda p: F.col(f"n{own.index(p[0])}").cast("int") if len(p) == 1 else F.size(reduce(F.array_intersect, [back(t, k) for k, t in enumerate(p)]))
    return slots.select(*keys, F.array(*[count(p) for p in wanted]).alias("tf")).where(F.exists("tf", lambda x: x > 0))


def _df(n_phrases: int) -> Column:
    return F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(n_phrases)]).alias("df")


def _score(n_phrases: int) -> Column:
    """BM25 from tf, dl, df, n and avgdl."""
    part = lambda i: (
        F.greatest(F.log((F.col("n") - F.get("df", F.lit(i)) + 0.5) / (F.get("df", F.lit(i)) + 0.5)), F.lit(LEAST_IDF))
        * F.get("tf", F.lit(i)) * (K1 + 1) / (F.get("tf", F.lit(i)) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    )
    return reduce(lambda a, b: a + b, [part(i) for i in range(n_phrases)])


def scored(matches: DataFrame, corpus: DataFrame, n_phrases: int) -> DataFrame:
    """matches (dl, tf) with score and n_matched. corpus: one row n, avgdl. How many entries have each phrase is counted
    over all matches, before any filter, so that filters change no score."""
    both = matches.crossJoin(F.broadcast(matches.agg(_df(n_phrases)).crossJoin(corpus)))  # one row each
    return both.withColumn("score", _score(n_phrases)).withColumn("n_matched", F.size(F.filter("tf", lambda x: x > 0))).drop("df", "n", "avgdl")


def ranked(matches: DataFrame, filters: Filters, n_phrases: int, corpus: DataFrame | None = None, told: tuple[list[int], int, float] | None = None) -> DataFrame:
    """The filtered entries that have every phrase, or, if none has, any; match says which. With score and n_matched.

    One pass over the matches finds all that concerns the whole: each phrase's entries, counted before any filter, and the
    most phrases that a filtered entry has. corpus: one row n, avgdl; without it matches are all entries, and it is
    counted in the same pass. told: how many entries have each phrase, n and avgdl, where they are known: with a single
    phrase nothing is left to be counted."""
    if told is not None and n_phrases == 1:
        df, n, avgdl = told
        known = {"df": F.array(*[F.lit(x).cast("long") for x in df]), "n": F.lit(n).cast("long"), "avgdl": F.lit(avgdl).cast("double")}
        kept = matches.where(filters.predicate() & F.exists("tf", lambda x: x > 0)).withColumns({"n_matched": F.lit(1), **known})
        return kept.withColumns({"score": _score(1), "match": F.lit("all")}).drop("df", "n", "avgdl")
    matches = matches.withColumn("n_matched", F.size(F.filter("tf", lambda x: x > 0)))
    most = F.max(F.when(filters.predicate(), F.col("n_matched"))).alias("_most")
    own = [] if corpus is not None else [F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")]
    sums = matches.agg(_df(n_phrases), most, *own)
    both = matches.where(filters.predicate() & (F.col("n_matched") > 0)).crossJoin(F.broadcast(sums if corpus is None else sums.crossJoin(corpus)))  # one row
    kept = both.where((F.col("n_matched") == n_phrases) | (F.col("_most") < n_phrases))
    match = F.when(F.col("_most") == n_phrases, "all").otherwise("any")
    return kept.withColumn("score", _score(n_phrases)).withColumn("match", match).drop("df", "n", "avgdl", "_most")


def candidates(found: DataFrame, offset: int = 0) -> DataFrame:
    return found.orderBy(F.desc("score"), *newest_first()).limit(max(CANDIDATES, offset + PAGE))


def is_echo(tool: str, caller_entry_id: str | None, session_id: str | None) -> Column:
    """An earlier answer of the tool itself, or the entry that asks."""
    own = (F.col("entry_id") == F.lit(caller_entry_id)) & (F.col("session_id") == F.lit(session_id))
    return ((F.col("kind") == "tool_result") & F.coalesce(F.col("name") == tool, F.lit(False))) | F.coalesce(own, F.lit(False))


def reranked(found: DataFrame, now: str) -> DataFrame:
    """With value: the score, halved after a month and falling on with age; an entry without a time comes last."""
    return found.withColumn("value", F.col("score") / (1 + age_months(F.col("ts"), now)))


def page(found: DataFrame, offset: int = 0, size: int = PAGE) -> DataFrame:
    return found.orderBy(F.desc_nulls_last("value"), *newest_first()).offset(offset).limit(size)


def listed(entries: DataFrame, filters: Filters, offset: int = 0, size: int = PAGE) -> DataFrame:
    return entries.where(filters.predicate()).orderBy(*newest_first()).offset(offset).limit(size)


def corpus_of(entries: DataFrame) -> DataFrame:
    """One row: n, avgdl. entries: dl."""
    return entries.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
