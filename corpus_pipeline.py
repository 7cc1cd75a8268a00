"""The corpus pipeline: documents to packed sequences, one operator a stage.

Each stage works on all that the one before it kept, as a Parquet table in the shared folder. All but the last return
the columns of documents. A stage that filters keeps every document that its operator doesn't reject.

Defined cases: null, empty and very short texts fail the quality rules' base test and go there; rows that repeat are near
copies of each other, but only rows of another id go, so rows that repeat an id stay together; a row without an id is
judged by its text like any other, and stays where only ids tell copies apart; extra columns come through all stages but
the last, also where their names clash with an operator's own; an empty documents table gives no rows, empty labels no
cutoffs, an empty benchmark no leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm.common import stage, table
from daybook.llm.decontamination import drop_leaks
from daybook.llm.jaccard_join import keep_one
from daybook.llm.packing import pack_all
from daybook.llm.quality_rules import keep_good
from daybook.llm.secret_scan import without_secrets

STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", without_secrets),
    ("packing", pack_all),
]

#: Sketches, compression and packing can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
