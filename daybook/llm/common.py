"""What several operators share: table reading, staged tables, size-checked broadcasts, word columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 1_000_000
#: Spark's setting by which an execution removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='daybook-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/daybook-{spark.sparkContext.applicationId}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind: its result is a table, so nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and a lost executor loses no part of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged df, marked for broadcast if it has at most so many rows; else Spark joins it by shuffling."""
    return F.broadcast(df) if is_small(df, rows) else df


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores until no column has it (Spark compares names without case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use() mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def bare(text: Column) -> Column:
    """A text, or the empty text for null."""
    return F.coalesce(text, F.lit(""))
