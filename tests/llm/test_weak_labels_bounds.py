"""Operator 10: what the driver holds is bounded by bytes, and very long texts take part."""

import random

import pyspark.sql.classic.dataframe as classic

from daybook.llm import weak_labels


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    rng = random.Random(10)
    text = lambda n: " ".join(f"word{rng.randrange(10**6)}" for _ in range(n)) + ". "
    rows = [(i, text(rng.choice([30, 60, 400]))) for i in range(120)] + [(500, text(60_000)), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r["score"] for r in weak_labels.classify(docs).collect()}
    assert len(whole) == 123 and all(0 <= x <= 1 for x in whole.values())
    taken, real = [], classic.DataFrame.toArrow
    monkeypatch.setattr(classic.DataFrame, "toArrow", lambda self: taken.append(real(self)) or taken[-1])
    small = weak_labels.classify(docs, sample_bytes=20_000).collect()
    features = [t for t in taken if "w" in t.column_names]
    assert len(small) == 123 and 1 < features[0].num_rows < 60
    assert sum(len(x.as_buffer()) for c in "dbw" for x in features[0].column(c)) <= 20_000
    assert len(weak_labels.classify(docs, sample_bytes=1).collect()) == 123
