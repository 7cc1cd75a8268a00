"""Quality rules with risk-controlled cutoffs.

Each rule compares one statistic of a text with a cutoff. Cutoffs are chosen per stratum on labelled documents: a
cutoff is admissible if an exact binomial bound shows that it rejects at most ``alpha / rules`` of the good documents
of the stratum. Cutoffs of a rule are tested from lenient to strict and testing stops at the first that fails (a fixed
sequence needs no correction of its own); the error budget ``delta`` is divided over all pairs of stratum and rule.
Of the admissible cutoffs whose share of bad documents caught is at least ``lift`` times that of good ones lost, the one
that rejects most bad documents is taken, the most lenient of equals; a rule without such a cutoff, or with too few
labels for its bound, stays off. So with probability ``1 - delta`` no stratum
loses more than ``alpha`` of its good documents to the rules.

Only DataFrame operations are used. Defined cases: a null or empty text has no words and fails the base test; a null
``lang`` is a stratum of its own; a stratum with too few labels for its bound has no cutoffs; rows that repeat are
judged alike; a document with several label rows counts with its lowest quality; documents without label and labels
without document do not take part in the choice; empty tables give no cutoffs and no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import bare, fresh, let, small, stage, table, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule: its statistic, +1 if large values are bad and -1 if small ones are, cutoffs from lenient to strict.
RULES: dict[str, tuple[int, tuple[float, ...]]] = {
    "symbols_per_word": (1, (2.0, 1.5, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_line_share": (1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
    "repeat_word_share": (1, (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "long_words": (1, (12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0)),
    "short_words": (-1, (2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0)),
}


@dataclass(frozen=True)
class Risk:
    """alpha: share of good documents that may be lost per stratum; delta: chance that this fails anywhere; lift: how
    much larger the share of bad documents caught must be than that of good ones lost."""

    alpha: float = 0.02
    delta: float = 0.05
    lift: float = 10.0


def _repeat_words(found: Column) -> Column:
    """Words inside 3-word windows that occur at least twice. Windows are compared by hash first; only texts in which
    two hashes agree compare the words themselves."""

    def exact(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")),
        )

        def starts(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["t"] == x["t"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        covered = F.aggregate(
            let(F.sort_array(windows), starts),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        )
        return covered["n"]

    def checked(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        triples = let(
            h,
            lambda a: F.zip_with(
                F.zip_with(F.slice(a, F.lit(1), F.size(a) - 2), F.slice(a, F.lit(2), F.size(a) - 2), lambda x, y: F.xxhash64(x, y)),
                F.slice(a, F.lit(3), F.size(a) - 2),
                lambda x, y: F.xxhash64(x, y),
            ),
        )
        return F.when(F.size(F.array_distinct(triples)) == F.size(w) - 2, F.lit(0).cast("long")).otherwise(exact(w))

    return F.when(F.size(found) < 4, F.lit(0).cast("long")).otherwise(let(found, checked))


def statistics(docs: DataFrame, text: str = "text", into: str = "rules") -> DataFrame:
    """docs with a struct column of the counts and of the statistics that the rules compare."""
    t, w, lines = bare(F.col(text)), fresh("_words", docs.columns), fresh("_lines", docs.columns)
    held = docs.withColumn(w, words(F.col(text))).withColumn(
        lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    solid = F.length(F.translate(t, " \t\n\u000b\u000c\r", ""))
    n = F.size(w).cast("long")
    counted = F.struct(
        n.alias("n_words"),
        solid.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(w)).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    out = held.withColumn(into, counted).drop(w, lines)
    x = F.col(into)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.withColumn(
        into,
        F.struct(
            x["n_words"].alias("n_words"),
            x["word_chars"].alias("word_chars"),
            x["n_symbols"].alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"),
            ((x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])).alias("base_failed"),
            share(x["n_symbols"], x["n_words"]).alias("symbols_per_word"),
            share(x["n_dup_lines"], x["n_lines"]).alias("dup_line_share"),
            share(x["n_repeat_words"], x["n_words"]).alias("repeat_word_share"),
            share(x["word_chars"], x["n_words"]).alias("long_words"),
            share(x["word_chars"], x["n_words"]).alias("short_words"),
        ),
    )


def rejects(value: Column, rule: str, cutoff: Column | float) -> Column:
    return value > cutoff if RULES[rule][0] > 0 else value < cutoff


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, brought back by the recurrence; right to about 1e-12 for x >= 1."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    back = sum((F.log(x + float(j)) for j in range(10)), F.lit(0.0))
    return series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where that is below one half; 1 otherwise, as no level in use is that large. The sum
    runs down from k, where its terms fall at least geometrically; a million terms reach double precision for any n
    below 1e13."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    falling = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.lit(1e6)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")
        ),
    )["sum"]
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.exp(top) * falling)


def choose_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff, good, good_lost, bad, bad_caught): one row for each rule that holds in a stratum.

    measured: key, stratum and the struct ``rules``; labels: key and quality (1 good, 0 bad). Counting is one
    aggregation by stratum, so a stratum of any size is summed before it is shuffled."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_good"))
    seen = measured.where(~F.col("rules.base_failed")).select(
        F.col(key).alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.col(stratum).isNull().alias("_null"), "rules"
    )
    joined = seen.join(marks, "_key").withColumn("_good", F.col("_good") == 1)
    tests = [(r, i, c) for r, (_, grid) in RULES.items() for i, c in enumerate(grid)]
    sums = [F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")]
    for r, i, c in tests:
        hit = rejects(F.col(f"rules.{r}"), r, c)
        sums += [F.count_if(hit & F.col("_good")).alias(f"g_{r}_{i}"), F.count_if(hit & ~F.col("_good")).alias(f"b_{r}_{i}")]
    by_stratum = joined.groupBy("_stratum", "_null").agg(*sums)
    listed = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"g_{r}_{i}").alias("good_lost"), F.col(f"b_{r}_{i}").alias("bad_caught"))
            for r, i, c in tests
        ]
    )
    rows = by_stratum.select("_stratum", "_null", "good", "bad", F.inline(listed))
    level = risk.delta / len(RULES)
    strata = by_stratum.agg(F.count(F.lit(1)).alias("_strata"))
    tested = rows.crossJoin(F.broadcast(strata)).withColumn(
        "_passes", binomial_tail(F.col("good_lost"), F.col("good"), risk.alpha / len(RULES)) <= level / F.col("_strata")
    )
    held = tested.groupBy("_stratum", "_null", "rule").agg(
        F.min(F.when(~F.col("_passes"), F.col("step"))).alias("_fails_at"), F.max("good").alias("good"), F.max("bad").alias("bad"),
        F.sort_array(F.collect_list(F.struct("step", "cutoff", "good_lost", "bad_caught"))).alias("_steps"),
    )  # at most as many elements as a rule has cutoffs
    pays = lambda s: (s["bad_caught"] > 0) & (s["bad_caught"] * F.col("good") > risk.lift * s["good_lost"] * F.col("bad"))
    open_ = F.filter("_steps", lambda s: (F.col("_fails_at").isNull() | (s["step"] < F.col("_fails_at"))) & pays(s))
    best = F.array_max(F.transform(open_, lambda s: F.struct(s["bad_caught"].alias("caught"), (-s["step"]).alias("lenient"), s.alias("s"))))
    return held.withColumn("_best", best).where(F.col("_best").isNotNull()).select(
        F.when(~F.col("_null"), F.col("_stratum")).alias("stratum"), F.col("_null").alias("is_null"), "rule",
        F.col("_best.s.cutoff").alias("cutoff"), "good", F.col("_best.s.good_lost").alias("good_lost"), "bad", F.col("_best.s.bad_caught").alias("bad_caught"),
    )


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with boolean ``kept`` and the array ``broken`` of the rules that a document breaks. The cutoffs, a row for
    each stratum that has any, are broadcast if they were counted and are few; else the documents are shuffled to them."""
    wide = cutoffs.groupBy("stratum", "is_null").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    at = lambda null, value: F.when(null, "n").otherwise(F.concat(F.lit("v"), value))
    wide = wide.select(at(F.col("is_null"), F.col("stratum")).alias("_at"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    joined = measured.withColumn("_at", at(F.col(stratum).isNull(), F.col(stratum).cast("string"))).join(small(wide), "_at", "left")
    broken = F.array_compact(F.array(*[F.when(rejects(F.col(f"rules.{r}"), r, F.col(f"_cut_{r}")), F.lit(r)) for r in RULES]))
    out = joined.withColumn("broken", broken).drop("_at", *[f"_cut_{r}" for r in RULES])
    return out.withColumn("kept", ~F.col("rules.base_failed") & (F.size("broken") == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = stage(statistics(docs).select("doc_id", "lang", "rules"), "quality-statistics")
    cutoffs = stage(choose_cutoffs(measured, table(spark, sf_dir, "labels")), "quality-cutoffs")
    return judge(measured, cutoffs).select(
        "doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept",
        F.concat_ws(",", "broken").alias("broken"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, all columns as they came."""
    own = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"d_{c}") for c in own])
    measured = stage(statistics(renamed, "d_text"), "quality-documents")
    cutoffs = stage(choose_cutoffs(measured, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "d_doc_id"), "d_doc_id", "d_lang"), "quality-cutoffs")
    return judge(measured, cutoffs, "d_lang").where("kept").select(*[F.col(f"`d_{c}`").alias(c) for c in own])


def _sql_tests() -> str:
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule, {i} AS step, CAST({c} AS DOUBLE) AS cutoff, {RULES[r][0]} AS sign" for r, (_, grid) in RULES.items() for i, c in enumerate(grid)
    )


def op1_sql(risk: Risk = Risk()) -> str:
    p, level = risk.alpha / len(RULES), risk.delta / len(RULES)
    values = {"symbols_per_word": "n_symbols / n_words", "dup_line_share": "n_dup_lines / n_lines", "repeat_word_share": "n_repeat_words / n_words", "long_words": "word_chars / n_words", "short_words": "word_chars / n_words"}
    measured = " UNION ALL ".join(
        f"SELECT doc_id, lang, base_failed, '{r}' AS rule, coalesce(CAST({v.split(' / ')[0]} AS DOUBLE) / nullif({v.split(' / ')[1]}, 0), 0) AS v FROM b" for r, v in values.items()
    )
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, lang, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
a AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a),
m AS ({measured}),
l AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
c AS ({_sql_tests()}),
s AS (SELECT lang, c.rule, c.step, any_value(c.cutoff) AS cutoff, any_value(c.sign) AS sign, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS nb,
        count(*) FILTER (WHERE good AND sign * v > sign * cutoff) AS k, count(*) FILTER (WHERE NOT good AND sign * v > sign * cutoff) AS caught
      FROM m JOIN l USING (doc_id) JOIN c ON c.rule = m.rule WHERE NOT base_failed GROUP BY lang, c.rule, c.step),
q AS (SELECT *, CASE WHEN n <= 0 OR k >= n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END
        <= {level!r} / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM s) AS passes FROM s),
o AS (SELECT *, min(CASE WHEN NOT passes THEN step END) OVER (PARTITION BY lang, rule) AS stop FROM q),
best AS (SELECT lang, rule, arg_max(cutoff, caught * 1000 - step) AS cutoff, any_value(sign) AS sign FROM o
         WHERE (stop IS NULL OR step < stop) AND caught > 0 AND caught * n > {risk.lift!r} * k * nb GROUP BY lang, rule),
bad AS (SELECT m.doc_id, string_agg(m.rule, ',' ORDER BY list_position({list(RULES)!r}, m.rule)) AS broken FROM m
        JOIN best ON best.rule = m.rule AND best.lang IS NOT DISTINCT FROM m.lang WHERE sign * v > sign * cutoff GROUP BY m.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.broken IS NULL AS kept, coalesce(bad.broken, '') AS broken
FROM b LEFT JOIN bad ON bad.doc_id = b.doc_id
"""
