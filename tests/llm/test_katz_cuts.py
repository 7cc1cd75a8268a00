"""Operator 8 when executors come or go between its passes."""

import random
import uuid

from daybook.llm import katz
from daybook.llm.common import shared_dir


def test_blocks_are_the_same_however_many_cores_there_are(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 1 << 14)
    rng = random.Random(8)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(rng.randrange(5, 80)))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    got = []
    try:
        for trained, used in (("8", "3"), ("3", "8"), ("2", "2")):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", trained)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            model = katz.train(read())
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", used)
            parts = read().rdd.getNumPartitions()
            got.append({r["doc_id"]: round(r["score"], 9) for r in katz.scored(read(), model).collect()})
            assert read().rdd.getNumPartitions() == parts  # the session's own settings are back
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] == got[2] and len(got[0]) == 3000
