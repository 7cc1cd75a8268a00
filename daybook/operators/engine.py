"""The engine as one object: commands and requests over a folder of journals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from daybook.operators import junk
from daybook.operators.history import History
from daybook.operators.index import Index
from daybook.plans.scope import Context, Request
from daybook.streaming.ingest import MOST_BYTES, catch_up, rebuild

BUSY = "Another writer is indexing; try again when it has ended."
USAGE = "Usage: status | index | rebuild | gc | gc confirm"


@dataclass
class Engine:
    spark: SparkSession
    root: str
    folder: str
    owner: str = "engine"
    ttl_ms: int = 120_000
    most_bytes: int | None = MOST_BYTES
    _previewed: junk.Preview | None = field(default=None, init=False)

    @property
    def index(self) -> Index:
        return Index(self.spark, f"{self.folder}/index")

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def refresh(self, skip: tuple[str, ...] = (), only: tuple[str, ...] = (), stop: Callable[[], bool] = lambda: False) -> dict | None:
        """Indexes what was added, the journals written last first; None if another writer holds the lease. only: these
        journals and no others; stop: asked between two batches."""
        with self.index.writing(self.owner, self.ttl_ms) as lease:
            return None if lease is None else catch_up(self.spark, self.root, self.index, self.checkpoint, skip, lease, self.most_bytes, only, stop)

    def query(self, request: Request, context: Context, now: str | None = None) -> dict:
        """Indexes first, so that an answer knows what has just been written: the caller's own journal where the context
        names it, and leaves the others to whoever follows them; else all."""
        if request.action == "read" and not request.entry_id:
            raise ValueError("entryId is missing: read shows one entry")
        self.refresh(only=(context.journal,) if context.journal else ())
        return History(self.index).answer(request, context, now)

    def command(self, line: str = "status", keep: tuple[str, ...] = (), now_ms: int | None = None, temporary: tuple[str, ...] | None = None) -> str:
        what = " ".join(line.split()) or "status"
        if what == "status":
            s = self.index.status().first()
            return f"{s['files']:,} journals, {s['sessions']:,} sessions, {s['entries']:,} entries, {s['summaries']:,} summaries, {s['indexed_bytes'] / 1e6:.1f} MB indexed"
        if what == "index":
            done = self.refresh()
            return BUSY if done is None else f"{done['lines']:,} lines read, {done['added']:,} entries added, {done['files']:,} journals indexed"
        if what == "rebuild":
            with self.index.writing(self.owner, self.ttl_ms) as lease:
                return BUSY if lease is None else f"{rebuild(self.spark, self.root, self.index, self.checkpoint, lease)['lines']:,} lines read"
        if what == "gc":
            # What another writer hasn't indexed yet would be judged by old rows.
            self._previewed = None
            if self.refresh() is None:
                return BUSY
            self._previewed = junk.preview(self.index, self.root, list(keep), now_ms, temporary)
            return junk.describe(self._previewed)
        if what == "gc confirm":
            if not self._previewed or not self._previewed.journals:
                return "Nothing to confirm: run gc first."
            with self.index.writing(self.owner, self.ttl_ms) as lease:
                if lease is None:
                    return BUSY
                done, self._previewed = junk.collect(self.index, self._previewed, lease), None
            return f"{done['deleted']:,} deleted, {done['bytes'] / 1e6:.1f} MB, {done['skipped']:,} changed since and kept"
        return USAGE
