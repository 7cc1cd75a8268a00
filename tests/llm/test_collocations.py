"""Operator 11 against plain counting."""

import collections
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from daybook.llm import collocations
from daybook.llm.common import shared_dir

BREAKS, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score string"


def plain(rows, min_count, top=2000):
    """What the contract asks for, by counting all phrases."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in BREAKS.split(low):
            w = WORDS.findall(piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    covered = {(lang, p[i : i + k]) for lang, p in candidates for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[lang, p] >= f[lang, p[i : i + k]]}
    out = collections.defaultdict(list)
    for lang, p in candidates - covered:
        a = f[lang, p]
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "New", "york", "😀", "\x1c", "a\x00b"]
    fixed = ["New York City Hall", "the quick  brown\tfox jumps", "de facto standard", "é É", "x y z x y z x"]
    out = [(None, "en"), ("", None), (" \t ", "und"), ("!!..\r\n\x0b\x0c", "en"), ("lonely", "xx")]
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(fixed))
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for x in w)
        out.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    out += [(" ".join(["same words again and again here"] * 30), "en")] * 20
    out.append((" ".join(rng.choice(vocabulary) for _ in range(300_000)), "long"))
    return out


@pytest.mark.parametrize(("sample", "lowered"), [(0.1, 3), (0.0, 1), (1.0, 1), (0.3, 40)])
def test_any_sample_gives_the_exact_phrases(spark, texts, sample, lowered):
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    found = collocations.first_of_each(collocations.collocations(docs, 12, sample, lowered))
    assert rows_of(found) == plain(texts, 12)


def test_a_sieve_that_lets_all_through_changes_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "HELD_HASHES", 500)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 50)
    docs = spark.createDataFrame(texts[:300], "text string, lang string")
    assert rows_of(collocations.first_of_each(collocations.collocations(docs, 12))) == plain(texts[:300], 12)


def test_the_first_of_each_language_with_ties(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string")
    found = collocations.collocations(docs, 12)
    assert rows_of(collocations.first_of_each(found, 7)) == plain(texts, 12, 7)


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**9, 10**13, 3 * 10**9, 7)], "a long, n long, l long, r long")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = (F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)")
    got = row.select(over.alias("_over"), (wide("l") * wide("r")).cast("decimal(38,0)").alias("_under")).selectExpr("_over DIV _under AS s").first()["s"]
    assert got == 1000 * 10**9 * 10**13 // (3 * 10**9 * 7)


def test_query_with_clashing_columns_and_empty_tables(spark, texts):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    many = [(t, lang) for t, lang in texts[:200]] * 3
    spark.createDataFrame([(i % 50, t, lang, "clash", 1, "clash") for i, (t, lang) in enumerate(many)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = rows_of(collocations.op11_collocations(spark, path))
    assert got == plain(many, 100) and got
    none = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{none}/documents.parquet")
    assert collocations.op11_collocations(spark, none).collect() == []
