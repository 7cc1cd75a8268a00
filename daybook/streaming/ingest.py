"""Streaming ingest of journals into an index: bounded batches, the journals written last first."""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from daybook.operators.index import Index
from daybook.operators.log import Held
from daybook.sources.journal import lag_of, register

#: Bytes of journals that one batch reads.
MOST_BYTES = 1 << 30


def checkpoint_of(index: Index, checkpoint: str) -> str:
    """Where the stream keeps its place: an index that was thrown away begins a new one."""
    return f"{checkpoint}/{index.log.current().epoch}"


def ledger_of(index: Index, checkpoint: str) -> str:
    """Where a stream that keeps its place there keeps how far it has read each journal: beside the index, where executors
    read, too."""
    return f"{index.base}/ledgers/{hashlib.sha256(checkpoint_of(index, checkpoint).removeprefix('file://').encode()).hexdigest()[:16]}"


def follow(
    spark: SparkSession, root: str, index: Index, checkpoint: str, skip: tuple[str, ...] = (), every: str | None = None, lease: Held | None = None, added: list[int] | None = None, most_bytes: int | None = MOST_BYTES, only: tuple[str, ...] = (),
) -> StreamingQuery:
    """Keeps the index up with the journals; every: a processing-time trigger, or None to take one batch of at most
    ``most_bytes`` and end. A batch is named by its number and committed with its rows, so one that is run again after a
    failure changes nothing. What each batch added is told to ``added``; parts are merged when they have become many."""
    register(spark)

    def sink(batch: DataFrame, number: int) -> None:
        n = index.append(batch, number, lease)
        index.merge(lease)
        if added is not None:
            added.append(n)

    source = spark.readStream.format("journal").option("skip", "\n".join(skip)).option("only", "\n".join(only)).option("ledger", ledger_of(index, checkpoint))
    lines = (source.option("maxBytes", most_bytes) if most_bytes else source).load(root)
    writer = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_of(index, checkpoint))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Progress(StreamingQueryListener):
    """Keeps beside the index how many journals a query that follows them has done: register it with
    ``spark.streams.addListener`` and name the query."""

    def __init__(self, index: Index, query_id: str):
        self.index, self.query_id = index, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = lag_of(event.progress.sources[0].endOffset) if str(event.progress.id) == self.query_id and event.progress.sources else None
        if told:
            self.index.progress(told[1] - told[0], told[1])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def catch_up(
    spark: SparkSession, root: str, index: Index, checkpoint: str, skip: tuple[str, ...] = (), lease: Held | None = None, most_bytes: int | None = MOST_BYTES, only: tuple[str, ...] = (), stop: Callable[[], bool] = lambda: False,
) -> dict:
    """Indexes all that has been added, batch by batch until no journal lags or stop() says so between two batches. Says how
    many lines and entries that was, and how many journals are done. only: journals to look at, and no others."""
    added: list[int] = []
    batches = lines = 0
    while True:
        query = follow(spark, root, index, checkpoint, skip, None, lease, added, most_bytes, only)
        query.awaitTermination()
        ran = [p for p in query.recentProgress if p["numInputRows"]]
        told = lag_of(query.lastProgress["sources"][0]["endOffset"]) if query.lastProgress else None
        batches, lines = batches + len(ran), lines + sum(p["numInputRows"] for p in ran)
        if told:
            index.progress(told[1] - told[0], told[1], lease)
        if not ran or not told or not told[0] or only or stop():
            break
    return {"batches": batches, "lines": lines, "added": sum(added), "files": index.log.current().done}


def rebuild(spark: SparkSession, root: str, index: Index, checkpoint: str, lease: Held | None = None) -> dict:
    """Throws the index away and reads all journals again. It is thrown away in one step, and a new place of the stream goes
    with that, so a crash anywhere leaves an index that catches up."""
    before = checkpoint_of(index, checkpoint), ledger_of(index, checkpoint)
    index.clear(lease)
    for folder in before:
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    return catch_up(spark, root, index, checkpoint, lease=lease)
