"""Journals that hold nothing worth keeping: statistics, reasons, a preview, and the deletion of what was previewed."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.entries import SUMMARIES
from daybook.operators.index import Index
from daybook.operators.log import Held
from daybook.sources.journal import journals as journal_files

# Temporary folders, the quiet time, the replies of a trivial session.
TEMPORARY = ("/tmp", "/private/tmp", "/private/var/folders", "/var/folders")
QUIET_MS = 24 * 3_600_000
FEW_REPLIES = 2
#: Where previews lie beside the index.
JUNK = "junk"


def journal_stats(journals: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of each journal by what they are; a journal without entries has zeros."""
    n = lambda c: F.count_if(c).alias
    k = F.col("kind")
    counted = entries.groupBy("path").agg(n(k == "user")("users"), n(k == "custom")("messages"), n(k == "assistant")("replies"), n(k.isin(*SUMMARIES))("summaries"))
    return journals.join(counted, "path", "left").fillna(0, ["users", "messages", "replies", "summaries"])


def is_temporary(cwd: Column, roots: tuple[str, ...] | None = None) -> Column:
    roots = roots if roots is not None else tuple(dict.fromkeys((tempfile.gettempdir(), *TEMPORARY)))
    found = F.lit(False)
    for r in roots:
        found = found | (cwd == r) | cwd.startswith(r + "/")
    return F.coalesce(found, F.lit(False))


def junk_reason(roots: tuple[str, ...] | None = None) -> Column:
    """Why a journal is junk, from its statistics; null if it is kept. A journal with a summary always is."""
    return (
        F.when(F.col("summaries") > 0, None)
        .when(is_temporary(F.col("cwd"), roots), "temporary folder")
        .when((F.col("users") == 0) & (F.col("messages") == 0), "no instructions")
        .when(F.col("replies") <= FEW_REPLIES, "two replies or fewer")
    )


def candidates(stats: DataFrame, files: DataFrame, keep: list[str], now_ms: int, roots: tuple[str, ...] | None = None) -> DataFrame:
    """Junk journals that are still there, are not kept and have been quiet for a day; the largest first.

    files: path, size, modified (ms)."""
    judged = stats.withColumn("reason", junk_reason(roots)).where(F.col("reason").isNotNull() & ~F.col("path").isin(keep))
    there = judged.join(files, "path").where(F.lit(now_ms) - F.col("modified") >= QUIET_MS)
    # A journal with bytes that aren't indexed isn't known well enough to be judged.
    if "bytes" in there.columns:
        there = there.where(F.col("size") <= F.col("bytes"))
    return there.select("path", "cwd", "started_at", F.col("size").alias("bytes"), F.col("modified").alias("modified_ms"), "reason").orderBy(F.desc("bytes"), "path")


def by_reason(found: DataFrame) -> DataFrame:
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("journals"), F.sum("bytes").alias("bytes"))


@dataclass(frozen=True)
class Preview:
    """Candidates as a table, which is what a person confirms, and what is shown of them."""

    folder: str
    journals: int
    bytes: int
    reasons: dict[str, int]
    examples: tuple[tuple[int, str, str], ...]


def preview(index: Index, root: str, keep: list[str], now_ms: int | None = None, roots: tuple[str, ...] | None = None, examples: int = 8) -> Preview:
    """The candidates, staged beside the index: what is confirmed later is what was shown, not what a plan finds by then. The
    driver sees how many there are for each reason, and the largest few."""
    spark: SparkSession = index.spark
    files = spark.createDataFrame(journal_files(root), "path string, size bigint, modified bigint")
    stats = journal_stats(index.journals(), index.entries(joined=False))
    folder = f"{index.base}/{JUNK}/{uuid.uuid4().hex}"
    candidates(stats, files, keep, now_ms if now_ms is not None else int(time.time() * 1000), roots).write.parquet(folder)
    held = spark.read.parquet(folder)
    reasons = {r["reason"]: r for r in by_reason(held).orderBy(F.desc("journals"), "reason").collect()}
    shown = held.orderBy(F.desc("bytes"), "path").limit(examples).collect()
    return Preview(folder, sum(r["journals"] for r in reasons.values()), sum(r["bytes"] for r in reasons.values()), {k: r["journals"] for k, r in reasons.items()}, tuple((r["bytes"], r["reason"], r["path"]) for r in shown))


def deleted(found: DataFrame) -> DataFrame:
    """path, bytes, outcome: journals that haven't changed since are deleted by the tasks that have their rows. One that is
    gone counts as deleted, so a task that runs again says the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outcomes = []
            for path, size, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "modified_ms")), strict=True):
                try:
                    now = os.stat(path)
                    same = (now.st_size, now.st_mtime_ns // 1_000_000) == (size, modified)
                    if same:
                        os.remove(path)
                    outcomes.append("deleted" if same else "changed")
                except FileNotFoundError:
                    outcomes.append("deleted")
                except OSError:
                    outcomes.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(outcomes, pa.string())], ["path", "bytes", "outcome"])

    return found.mapInArrow(run, "path string, bytes long, outcome string")


def collect(index: Index, found: Preview, lease: Held | None = None) -> dict:
    """Deletes previewed journals that haven't changed since, and forgets them, in one step of the index."""
    if lease is not None:
        lease()
    told = f"{found.folder}-done"
    deleted(index.spark.read.parquet(found.folder)).write.mode("overwrite").parquet(told)
    done = index.spark.read.parquet(told)
    gone = done.where("outcome = 'deleted'")
    sums = done.agg(F.count_if(F.col("outcome") == "deleted").alias("deleted"), F.coalesce(F.sum(F.when(F.col("outcome") == "deleted", F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_if(F.col("outcome") != "deleted").alias("skipped")).first().asDict()
    if sums["deleted"]:
        index.forget(gone.select("path"), lease)
    for name in (found.folder, told):
        index.files.remove(name.removeprefix(f"{index.base}/"))
    return sums


def describe(found: Preview) -> str:
    if not found.journals:
        return "No junk journals."
    lines = [f"{found.journals:,} journals, {found.bytes / 1e6:.1f} MB: " + ", ".join(f"{n:,} {r}" for r, n in found.reasons.items())]
    lines += [f"{size / 1e6:.1f} MB  {reason}  {path}" for size, reason, path in found.examples]
    left = found.journals - len(found.examples)
    return "\n".join([*lines, *([f"... {left:,} more"] if left else [])])
