"""Journals: append-only JSONL files, read by byte offset and by complete lines only.

``spark.readStream.format("journal").load(root)`` gives the lines that were added since the last batch;
``spark.read.format("journal").load(root)`` all complete lines. A file that has shrunk starts again at byte 0 under the
next generation. A span of more than ``splitBytes`` is read by several tasks: each takes the lines that begin in its part; short
spans share a task until it has ``packBytes``.

A stream admits at most ``maxBytes`` at a time (whole lines; one line at least), of the journals written last first. What
is left over is told with the offset, under the empty path: journals that lag, and journals there are. A journal that is
read to its end isn't opened again until its size changes. ``only`` names the journals that are looked at, a line each.
``ledger`` names a folder that executors read, too: how far each journal was read is kept there (``ledger.py``), offsets and
partitions only name what it has, and no process holds all journals. Without it the offset has every journal."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from daybook.sources.ledger import Ledger, beside, in_order, path_of

SCHEMA = "path string, generation int, offset bigint, length int, line string"
CHUNK = 1 << 20
#: The key of an offset that tells how many journals lag, and how many there are.
LAG = ""
#: The key of an offset that names a version of the ledger.
VERSION = "version"
SPLIT, PACK = 64 << 20, 4 << 20


def listed(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, modified at ms) of the regular *.jsonl files in root and one level down, in no order; what can't be
    read is left out."""
    yield from _listed_in(root)
    for folder in _entries(root):
        if folder.is_dir():
            yield from _listed_in(folder.path)


def _listed_in(folder: str) -> Iterator[tuple[str, int, int]]:
    for e in _entries(folder):
        try:
            if e.name.endswith(".jsonl") and e.is_file():
                yield e.path, e.stat().st_size, e.stat().st_mtime_ns // 1_000_000
        except OSError:
            continue


def _entries(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            yield from found
    except OSError:
        return


def newest(journal: tuple[str, int, int]) -> tuple[int, str]:
    return -journal[2], journal[0]


def journals(root: str) -> list[tuple[str, int, int]]:
    """What is listed, the latest first."""
    return sorted(listed(root), key=newest)


def complete_bytes(path: str, size: int) -> int:
    """Bytes up to and with the last newline, sought from the end."""
    try:
        with open(path, "rb") as f:
            at = size
            while at > 0:
                start = max(0, at - CHUNK)
                f.seek(start)
                cut = f.read(at - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                at = start
    except OSError:
        pass
    return 0


def next_line(path: str, start: int, size: int) -> int:
    """Where the line that begins at start ends, with its newline; start if it doesn't end before size."""
    try:
        with open(path, "rb") as f:
            f.seek(start)
            at = start
            while at < size:
                raw = f.read(min(CHUNK, size - at))
                cut = raw.find(b"\n")
                if cut >= 0:
                    return at + cut + 1
                if not raw:
                    break
                at += len(raw)
    except OSError:
        pass
    return start


@dataclass
class Span(InputPartition):
    path: str
    generation: int
    start: int
    stop: int
    begins: bool = True


def spans(path: str, generation: int, start: int, stop: int, split: int) -> list[Span]:
    return [Span(path, generation, a, min(stop, a + split), a == start) for a in range(start, stop, split)]


@dataclass
class Bundle(InputPartition):
    spans: list[Span]


def bundles(found: list[Span], pack: int) -> list[Bundle]:
    """Spans in their order, as many to a bundle as stay below so many bytes."""
    out, held = [], 0
    for s in found:
        if not out or held + s.stop - s.start > pack:
            out.append(Bundle([]))
            held = 0
        out[-1].spans.append(s)
        held += s.stop - s.start
    return out


@dataclass
class Planned(InputPartition):
    """So many spans of a plan, from one of its bytes on."""

    plan: str
    at: int
    count: int

    @property
    def spans(self) -> Iterator[Span]:
        with open(self.plan, "rb") as f:
            f.seek(self.at)
            yield from (Span(*json.loads(line)) for line in islice(f, self.count))


def planned(plan: str, pack: int) -> list[Planned]:
    """The spans of a plan, bundled alike."""
    out, held, at = [], 0, 0
    with open(plan, "rb") as f:
        for line in f:
            _, _, start, stop, _ = json.loads(line)
            if not out or held + stop - start > pack:
                out.append(Planned(plan, at, 0))
                held = 0
            out[-1].count += 1
            held += stop - start
            at += len(line)
    return out


def lines_of(span: Span) -> Iterator[tuple[str, int, int, int, str]]:
    """The lines that begin in the span; the last may end beyond it. Bytes that aren't UTF-8 become U+FFFD."""
    with open(span.path, "rb") as f:
        at = span.start
        if not span.begins:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(at)
        while at < span.stop:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            yield span.path, span.generation, at, len(raw) - 1, raw[:-1].decode("utf-8", "replace")
            at += len(raw)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.split, self.pack = options["path"], int(options.get("splitbytes", SPLIT)), int(options.get("packbytes", PACK))

    def partitions(self) -> list[Bundle]:
        return bundles([s for path, size, _ in journals(self.root) for s in spans(path, 0, 0, complete_bytes(path, size), self.split)], self.pack)

    def read(self, partition: Bundle) -> Iterator[tuple]:
        for span in partition.spans:
            yield from lines_of(span)


class _Look:
    """One look at the journals, the latest first: what of each is admitted."""

    def __init__(self, most: int | None, only: set[str]):
        self.left, self.only = most, only
        self.lag, self.admitted = 0, False

    def at(self, path: str, size: int, known: list[int] | None) -> list[int] | None:
        """Generation, first byte and end of what is read of a journal next; None if that is as far as it was read.
        known: generation and bytes read."""
        generation, done = known or [0, 0]
        if size < done:
            generation, done = generation + 1, 0
        if size == done and known:
            return None
        if self.only and path not in self.only or self.left is not None and self.left <= 0:
            self.lag += 1
            return None
        stop = max(done, complete_bytes(path, size))
        rest = None if self.left is None else self.left - (stop - done)
        if rest is not None and rest < 0:
            # No journal goes before one that was written later. A line that is longer than all that may be read at a
            # time is read whatever its length.
            stop, rest = max(done, complete_bytes(path, done + self.left)), 0
            stop = stop if stop > done or self.admitted else next_line(path, done, size)
            self.lag += 1
        self.left = rest
        if known == [generation, stop]:
            return None
        self.admitted = True
        return [generation, done, stop]


class _StreamReader(DataSourceStreamReader):
    """Offsets: {path: [generation, bytes]}, or with a ledger its version. What a restart replays teaches the reader where
    it was."""

    def __init__(self, options: dict):
        self.root, self.split, self.pack = options["path"], int(options.get("splitbytes", SPLIT)), int(options.get("packbytes", PACK))
        self.most = int(options["maxbytes"]) if options.get("maxbytes") else None
        self.skip = set(filter(None, options.get("skip", "").split("\n")))
        self.only = set(filter(None, options.get("only", "").split("\n")))
        self.ledger = Ledger(options["ledger"]) if options.get("ledger") else None
        #: Without a ledger where each journal was left; with one the last offset.
        self.known: dict = {}
        self.taken: str | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.ledger:
            return self._latest_version()
        look, files = _Look(self.most, self.only), 0
        for path, size, _ in journals(self.root):
            if path in self.skip:
                continue
            files += 1
            if found := look.at(path, size, self.known.get(path)):
                self.known[path] = [found[0], found[2]]
        if look.admitted:
            self.known[LAG] = [look.lag, files]
        return dict(self.known)

    def _latest_version(self) -> dict:
        look, files = _Look(self.most, self.only), 0

        def grown(before: str | None) -> Iterator[list]:
            """Path, size, time, and what is known, of the journals that have been written."""
            nonlocal files
            here = groupby(in_order((x for x in listed(self.root) if x[0] not in self.skip), path_of), path_of)
            # A folder that changes while it is listed may show a journal twice.
            for (path, size, at), known in beside((next(own) for _, own in here), self.ledger.known(before)):
                files += 1
                if not known or known[2] != size:
                    yield [path, size, at, known and known[1:]]

        def changed(put: Callable[[list], None]) -> Iterator[list]:
            for path, size, _, known in in_order(grown(before), newest):
                if found := look.at(path, size, known):
                    generation, start, stop = found
                    for s in spans(path, generation, start, stop, self.split):
                        put([s.path, s.generation, s.start, s.stop, s.begins])
                    yield [path, generation, stop]

        before, named = self.known.get(VERSION), True
        if before is None and self.known:
            # An offset from before there were ledgers.
            self.taken = self.taken or self.ledger.add(None, lambda _: in_order(([p, *v] for p, v in self.known.items() if p != LAG), path_of))
            before, named = self.taken, False
        token = self.ledger.add(before, lambda put: in_order(changed(put), path_of), named)
        if token:
            self.known = {LAG: [look.lag, files], VERSION: token}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.ledger and VERSION in end:
            self.known = dict(end)
            return [p for plan in self.ledger.plans(start.get(VERSION), end[VERSION]) for p in planned(plan, self.pack)]
        self.known = {k: list(v) for k, v in {**self.known, **end}.items()}
        out = []
        for path, (generation, stop) in end.items():
            if path == LAG:
                continue
            was, done = start.get(path, [0, 0])
            begin = done if was == generation else 0
            if stop > begin:
                out += spans(path, generation, begin, stop, self.split)
        return bundles(out, self.pack)

    def read(self, partition: Bundle | Planned) -> Iterator[tuple]:
        for span in partition.spans:
            yield from lines_of(span)

    def commit(self, end: dict) -> None:
        if self.ledger and VERSION in end:
            self.ledger.commit(end[VERSION])


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def lag_of(offset: str | None) -> tuple[int, int] | None:
    """Journals that lag, and journals there are, of an offset as a query's progress shows it."""
    told = re.search(r"""['"]{2}: \[(\d+), (\d+)\]""", offset or "")
    return (int(told[1]), int(told[2])) if told else None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JournalSource)


def line_text(path: str, offset: int, length: int) -> str | None:
    """The line that an index entry points at, or None if it can't be read."""
    try:
        with open(path, "rb") as f:
            f.seek(offset)
            raw = f.read(length)
    except OSError:
        return None
    return raw.decode("utf-8", "replace") if len(raw) == length else None
