"""The index: pointers, terms and statistics as Parquet, without any text.

A version is a list of parts, committed by the log (``log.py``). A part has four tables:

- ``entries``: a row for each entry, sorted by journal and offset, read for those that are shown or listed;
- ``facts``: a row for each block, with the offset, length in tokens, kind, role and time of each of its entries. A block
  has the entries that begin in one stretch of ``STRETCH`` bytes of a journal; blocks and the entries in them are numbered;
- ``postings``: a row for each term of each block: how many of its entries have the term, and each occurrence as the entry's
  number and the token's place in the block, both ascending. Rows lie in folders by a checksum of the term, as many as the
  part's tokens need, sorted by term, so a term is stored once for many blocks and a search opens few files;
- ``journals``: what each journal has: header, bytes, entries, tokens.

A block's journal and generation decide whether it is live; readers join the latest generations only, and merging leaves
the others out. Parts of one level are merged when there are ``FANOUT`` of them, so n batches leave about
``FANOUT * log(n)`` parts.

Spark broadcasts what it takes to be small: a scan or a cached table has its compressed bytes, a tenth of what a broadcast
puts into the driver, and a broadcast once planned stays, as shuffles would cost more. So joins with many journals or
entries shuffle both sides, by a hint where the side is known to be large, else by dealing both by the keys, which lets
Spark choose by what it has measured."""

from __future__ import annotations

import math
import posixpath
import random
import time
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from daybook.functions.entries import SUMMARIES, with_entries
from daybook.functions.redact import redact
from daybook.functions.text import tokens
from daybook.operators.log import LAYOUT, Fenced, Held, Leases, Log, Manifest, Part
from daybook.operators.search import frequencies
from daybook.sources.files import Files

ENTRIES = "path string, generation int, entry_id string, parent_id string, ts string, kind string, role string, name string, chars int, tokens_before double, offset bigint, length int, dl int"
FACTS = "part bigint, block int, path string, generation int, offsets array<bigint>, dls array<int>, kinds array<string>, roles array<string>, tss array<string>"
POSTINGS = "part bigint, block int, term string, df int, rows array<int>, places array<int>"
JOURNALS = "path string, generation int, session_id string, cwd string, started_at string, header_at bigint, bytes bigint, entries bigint, tokens bigint"
#: Bytes of a journal whose entries are one block, and tokens that make one folder of postings.
STRETCH, BUCKET_TOKENS, MOST_BUCKETS = 1 << 20, 1 << 20, 4096
FANOUT = 8
#: Shares that blocks are numbered in.
NUMBERED = 64
#: Journals, and entries, that may be broadcast whatever Spark takes them to be.
FEW_JOURNALS, FEW = 1 << 14, 1 << 15
#: Journals of a batch whose names are pushed down into the scan for entries known already.
NAMED = 500
KEYS = ("path", "generation", "offset")
OF_ENTRY = ("part", "block", "row")
#: By index: version, n, avgdl.
_sizes: dict[str, tuple] = {}
#: By index: version, rows of journals.
_listed: dict[str, tuple] = {}


def bucket_of(term: str, buckets: int) -> int:
    """The checksum that ``_bucket`` has, of a request's own term."""
    return zlib.crc32(term.encode()) % buckets


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def index_rows(lines: DataFrame) -> DataFrame:
    """Journal lines with header and entry, the entry's text redacted and cut into tokens; first of equal ids wins."""
    held = with_entries(lines)
    first = Window.partitionBy("path", "generation", "entry.entry_id").orderBy("offset")
    kept = held.withColumn("_n", F.row_number().over(first)).where("header IS NOT NULL OR entry IS NULL OR _n = 1").drop("_n")
    return kept.withColumn("tk", F.when(F.col("entry").isNotNull(), tokens(redact(F.col("entry.text")))))


def numbered(entries: DataFrame, many: bool = False) -> DataFrame:
    """entries (path, generation, offset, dl) with block, row in it, and start: the tokens of the block before it. Numbers
    are dealt in shares, so no task numbers all blocks. many: that there are many journals."""
    cut = entries.withColumn("_stretch", F.floor(F.col("offset") / STRETCH))
    own = ["path", "generation", "_stretch"]
    share = F.pmod(F.xxhash64(*own), F.lit(NUMBERED))
    blocks = cut.select(*own).distinct().withColumn("_share", share)
    blocks = blocks.withColumn("block", ((F.row_number().over(Window.partitionBy("_share").orderBy(*own)) - 1) * NUMBERED + F.col("_share")).cast("int"))
    inside = Window.partitionBy("block").orderBy("offset")
    start = F.coalesce(F.sum("dl").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    blocks = blocks.drop("_share").hint("merge") if many else blocks.drop("_share")
    # Each row has its block; a left join, as only the right side of it can be broadcast.
    return cut.join(blocks, own, "left").withColumns({"row": (F.row_number().over(inside) - 1).cast("int"), "start": start}).drop("_stretch")


def few(parts: tuple[Part, ...]) -> bool:
    return sum(p.entries for p in parts) <= FEW


class Index:
    def __init__(self, spark: SparkSession, folder: str, pinned: Manifest | None = None):
        self.spark, self.base, self._pinned = spark, folder.removeprefix("file://"), pinned
        self.files = Files(self.base)
        self.log, self.leases = Log(self.files), Leases(self.files)

    def pinned(self) -> Index:
        """The index as it is now, whatever is committed meanwhile."""
        return Index(self.spark, self.base, self.manifest)

    @property
    def manifest(self) -> Manifest:
        found = self._pinned or self.log.current()
        if found.layout != LAYOUT:
            raise ValueError(f"the index at {self.base} has layout {found.layout}, not {LAYOUT}: rebuild it")
        return found

    def _read(self, table: str, schema: str, parts: tuple[Part, ...] | None = None, terms: list[str] | None = None) -> DataFrame:
        parts, paths = self.manifest.parts if parts is None else parts, []
        for p in parts:
            own = f"{self.base}/{p.folder}/{table}"
            if table == "postings":
                wanted = p.filled if terms is None else sorted({bucket_of(t, p.buckets) for t in terms} & set(p.filled))
                paths += [f"{own}/tb={b}" for b in wanted]
            else:
                paths.append(own)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Writing

    def append(self, lines: DataFrame, batch: int, lease: Held | None = None) -> int:
        """Adds a batch of journal lines (path, generation, offset, length, line) and says how many entries that gave. A
        batch that is in already changes nothing."""
        now = self.manifest
        if batch <= now.batch:
            return 0
        rows = index_rows(lines).select(
            "path", "generation", "offset", "length", "header", *[F.col(f"entry.{c}").alias(c) for c in ("entry_id", "parent_id", "ts", "kind", "role", "name", "chars", "tokens_before")], "tk", F.size("tk").alias("dl"),
        ).persist()
        try:
            entries = rows.where("entry_id IS NOT NULL")
            if now.parts:
                # Only entries of the batch's own journals can be known already; a few names also spare the scan the rest.
                journals = rows.select("path").distinct()
                some = [r["path"] for r in journals.limit(NAMED + 1).collect()]
                before = self._read("entries", ENTRIES, now.parts)
                before = before.where(F.col("path").isin(*some)) if len(some) <= NAMED else before.join(journals, "path", "left_semi")
                before = before.select("path", "generation", "entry_id")
                entries = entries.join(before if few(now.parts) else before.hint("merge"), ["path", "generation", "entry_id"], "left_anti")
            held = numbered(entries).persist()
            try:
                hits = held.select("block", "row", "start", F.posexplode("tk").alias("pos", "term")).select("block", "row", (F.col("start") + F.col("pos")).alias("place"), "term")
                heads = rows.groupBy("path", "generation").agg(
                    F.min_by("header", F.when(F.col("header").isNotNull(), F.col("offset"))).alias("h"), F.min(F.when(F.col("header").isNotNull(), F.col("offset"))).alias("header_at"),
                    F.max(F.col("offset") + F.col("length") + 1).alias("bytes"),
                )
                added = held.groupBy("path", "generation").agg(F.count(F.lit(1)).alias("entries"), F.sum("dl").cast("long").alias("tokens"))
                heads = heads.join(added, ["path", "generation"], "left").fillna(0, ["entries", "tokens"])
                heads = heads.select("path", "generation", "h.session_id", "h.cwd", "h.started_at", "header_at", "bytes", "entries", "tokens")
                part = self._write(held, held, hits, heads, 0)
            finally:
                held.unpersist()
        finally:
            rows.unpersist()
        self.log.commit(lambda m: None if batch <= m.batch else replace(m, batch=batch, parts=(*m.parts, part)), lease and lease.number)
        return part.entries

    def _write(self, entries: DataFrame, facts: DataFrame, hits: DataFrame, journals: DataFrame, level: int) -> Part:
        """A part of these rows, which no version names yet. facts: block, row and what they tell of it."""
        number = random.getrandbits(62)
        part = Part(number, level, 0, 0, ())
        into = lambda df: df.write.option("compression", "zstd").option("parquet.writer.version", "v2")
        to = lambda table: f"{self.base}/{part.folder}/{table}"
        this = F.lit(number).cast("long").alias("part")
        own = [c.strip().split()[0] for c in ENTRIES.split(", ")]
        told = F.sort_array(F.collect_list(F.struct("row", "offset", "dl", "kind", "role", "ts")))
        by_block = facts.groupBy("block", "path", "generation").agg(told.alias("f"))
        lists = {"offsets": "offset", "dls": "dl", "kinds": "kind", "roles": "role", "tss": "ts"}
        into(journals).parquet(to("journals"))
        sums = self.spark.read.schema(JOURNALS).parquet(to("journals")).agg(F.sum("entries").alias("n"), F.sum("tokens").alias("t")).first()
        buckets = max(1, min(MOST_BUCKETS, 1 << math.ceil(math.log2(max(1, (sums["t"] or 0) / BUCKET_TOKENS)))))
        # Row and place in one number, which is sorted faster than a struct.
        both = F.shiftleft(F.col("row").cast("long"), 32).bitwiseOR(F.col("place"))
        each = hits.groupBy("block", "term").agg(F.sort_array(F.collect_list(both)).alias("h"))
        rows, places = F.transform("h", lambda x: F.shiftright(x, 32).cast("int")), F.transform("h", lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int"))
        posted = each.select(this, "block", "term", rows.alias("rows"), places.alias("places")).select("part", "block", "term", F.size(F.array_distinct("rows")).alias("df"), "rows", "places", _bucket(F.col("term"), buckets).alias("tb"))
        # A bucket with a term that stands everywhere is split when it is written.
        posted = posted.hint("rebalance", "tb").sortWithinPartitions("tb", "term", "block")
        writes = (
            lambda: into(posted).partitionBy("tb").parquet(to("postings")),
            lambda: into(entries.select(*own).hint("rebalance", "path").sortWithinPartitions("path", "generation", "offset")).parquet(to("entries")),
            lambda: into(by_block.select(this, "block", "path", "generation", *[F.col(f"f.{c}").alias(name) for name, c in lists.items()])).parquet(to("facts")),
        )
        # None waits for another: a small batch is mostly waiting.
        with ThreadPoolExecutor(len(writes)) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(w)) for w in writes]:
                done.result()
        filled = tuple(sorted(int(n[3:]) for n in self.files.names(f"{part.folder}/postings") if n.startswith("tb=")))
        return replace(part, entries=sums["n"] or 0, buckets=buckets, filled=filled)

    def _rewritten(self, parts: tuple[Part, ...], level: int, without: DataFrame | None = None) -> Part:
        """One part of the live rows of several. without: (path) journals that are left out."""
        kept = lambda df: self._of_live(df if without is None else df.join(without, "path", "left_anti"))
        old = kept(self._read("facts", FACTS, parts))
        each = old.select("part", "block", "path", "generation", F.posexplode(F.arrays_zip("offsets", "dls", "kinds", "roles", "tss")).alias("row", "f"))
        each = each.select("part", F.col("block").alias("was_block"), F.col("row").alias("was_row"), "path", "generation", F.col("f.offsets").alias("offset"), F.col("f.dls").alias("dl"), F.col("f.kinds").alias("kind"), F.col("f.roles").alias("role"), F.col("f.tss").alias("ts"))
        before = Window.partitionBy("part", "was_block").orderBy("was_row").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("was_start", F.coalesce(F.sum("dl").over(before), F.lit(0)).cast("int"))
        new = numbered(each, self._many()).persist()
        try:
            moved = new.select("part", "was_block", "was_row", "block", "row", (F.col("start") - F.col("was_start")).alias("shift"))
            hits = self._hits(self._read("postings", POSTINGS, parts)).withColumnsRenamed({"block": "was_block", "row": "was_row"})
            was = ["part", "was_block", "was_row"]
            hits = hits.repartition(*was).join(moved.repartition(*was), was).select("block", "row", (F.col("place") + F.col("shift")).alias("place"), "term")
            first = lambda c: F.min_by(c, "header_at").alias(c)
            heads = kept(self._read("journals", JOURNALS, parts)).groupBy("path", "generation").agg(first("session_id"), first("cwd"), first("started_at"), F.min("header_at").alias("header_at"), F.max("bytes").alias("bytes"), F.sum("entries").alias("entries"), F.sum("tokens").alias("tokens"))
            return self._write(kept(self._read("entries", ENTRIES, parts)), new, hits, heads, level)
        finally:
            new.unpersist()

    @staticmethod
    def _hits(postings: DataFrame) -> DataFrame:
        """part, block, row, place, term: a row for each occurrence."""
        return postings.select("part", "block", "term", F.inline(F.arrays_zip("rows", "places"))).withColumnsRenamed({"rows": "row", "places": "place"})

    def _swapped(self, old: tuple[Part, ...], new: Part, lease: Held | None) -> None:
        gone = {p.id for p in old}

        def change(m: Manifest) -> Manifest:
            if not gone <= {p.id for p in m.parts}:
                raise Fenced("the parts that were rewritten are no longer there")
            return replace(m, parts=(*[p for p in m.parts if p.id not in gone], new))

        self.log.commit(change, lease and lease.number)

    def forget(self, paths: list[str] | DataFrame, lease: Held | None = None) -> None:
        """Takes journals out, in one step: the parts that have rows of them become one without these."""
        gone = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        held = self.pinned()
        hit = tuple(p for p in held.manifest.parts if not held._read("journals", JOURNALS, (p,)).join(gone, "path", "left_semi").isEmpty())
        if hit:
            self._swapped(hit, held._rewritten(hit, max(p.level for p in hit), gone), lease)

    def merge(self, lease: Held | None = None) -> int:
        """Merges parts of a level while there are ``FANOUT`` of it; says how many merges that took. Then what no version
        names any more is removed."""
        done = 0
        while True:
            held = self.pinned()
            levels: dict[int, list[Part]] = {}
            for p in held.manifest.parts:
                levels.setdefault(p.level, []).append(p)
            full = next((level for level, own in sorted(levels.items()) if len(own) >= FANOUT), None)
            if full is None:
                break
            old = tuple(levels[full])
            self._swapped(old, held._rewritten(old, full + 1), lease)
            done += 1
        if done:
            self.log.clean()
        return done

    def compact(self, lease: Held | None = None) -> None:
        """All live rows as one part."""
        held = self.pinned()
        old = held.manifest.parts
        if old:
            self._swapped(old, held._rewritten(old, max(p.level for p in old) + 1), lease)
            self.log.clean()

    def progress(self, done: int, files: int, lease: Held | None = None) -> None:
        """Keeps how many journals are indexed to their end, and how many there are."""
        self.log.commit(lambda m: None if (m.done, m.files) == (done, files) else replace(m, done=done, files=files), lease and lease.number)

    def clear(self, lease: Held | None = None) -> Manifest:
        """Nothing is left, in one step; what is indexed from now on belongs to a new epoch."""
        return self.log.commit(lambda m: Manifest(version=m.version, epoch=m.epoch + 1, fence=m.fence), lease and lease.number)

    # Reading

    def _live(self) -> DataFrame:
        return self._read("journals", JOURNALS).groupBy("path").agg(F.max("generation").alias("generation"))

    def journals(self) -> DataFrame:
        """A row for each journal of its latest generation: the first header, the bytes indexed."""
        held = self._read("journals", JOURNALS)
        first = lambda c: F.min_by(c, "header_at").alias(c)
        summed = held.groupBy("path", "generation").agg(first("session_id"), first("cwd"), first("started_at"), F.min("header_at").alias("header_at"), F.max("bytes").alias("bytes"), F.sum("entries").alias("entries"), F.sum("tokens").alias("tokens"))
        latest = summed.groupBy("path").agg(F.max_by(F.struct("generation", "session_id", "cwd", "started_at", "header_at", "bytes", "entries", "tokens"), "generation").alias("j"))
        return latest.select("path", "j.*")

    def corpus(self) -> DataFrame:
        """One row: n, avgdl; from what each journal counts, so that no entry is read."""
        return self.journals().agg(F.sum("entries").alias("n"), (F.sum("tokens") / F.sum("entries")).alias("avgdl"))

    def size(self) -> tuple[int, float]:
        """n and avgdl as numbers, kept for the last version that was asked."""
        version = self.manifest.version
        if _sizes.get(self.base, (None,))[0] != version:
            row = self.corpus().first()
            _sizes[self.base] = (version, row["n"] or 0, row["avgdl"] or 0.0)
        return _sizes[self.base][1:]

    def entries(self, joined: bool = True) -> DataFrame:
        held = self._of_live(self._read("entries", ENTRIES))
        return self._with_journals(held) if joined else held

    def _many(self) -> bool:
        """Whether there are many journals; counted once for a version, and only where there are as many entries."""
        now = self.manifest
        if few(now.parts):
            return False
        if _listed.get(self.base, (None,))[0] != now.version:
            _listed[self.base] = (now.version, self._read("journals", JOURNALS, now.parts).count())
        return _listed[self.base][1] > FEW_JOURNALS

    def _of_live(self, rows: DataFrame) -> DataFrame:
        live = self._live()
        return rows.join(live.hint("merge") if self._many() else live, ["path", "generation"], "left_semi")

    def _with_journals(self, live: DataFrame) -> DataFrame:
        """Live rows, which all have a journal, with its session and folder."""
        own = self.journals().select("path", "generation", "session_id", "cwd")
        return live.join(own.hint("merge") if self._many() else own, ["path", "generation"], "left")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """What is joined by its block, dealt by that, so that it is measured, unless there are few entries."""
        return rows if few(self.manifest.parts) else rows.repartition("part", "block")

    def _blocks(self) -> DataFrame:
        """Live blocks with the session and folder of their journal."""
        return self._dealt(self._with_journals(self._of_live(self._read("facts", FACTS))))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """path, generation, offset, term, positions: of all terms, or of these; a row for each term of each entry."""
        held = self._read("postings", POSTINGS, terms=terms)
        held = held if terms is None else held.where(F.col("term").isin(*terms))
        each = self._hits(held).groupBy(*OF_ENTRY, "term").agg(F.sort_array(F.collect_list("place")).alias("places"))
        blocks = self._blocks().select("part", "block", "path", "generation", "offsets")
        return each.join(blocks, ["part", "block"]).select("path", "generation", F.get("offsets", F.col("row")).alias("offset"), "term", F.col("places").alias("positions"))

    def matches(self, wanted: list[tuple[str, ...]]) -> DataFrame:
        """What a search filters and ranks by, of the entries that have any of the phrases: path, generation, offset, kind,
        role, ts, session_id, cwd, dl, tf. Only the terms' postings and the blocks' facts are read, no entries."""
        terms = sorted({t for p in wanted for t in p})
        hits = self._hits(self._read("postings", POSTINGS, terms=terms).where(F.col("term").isin(*terms)))
        found = self._dealt(frequencies(hits, wanted, OF_ENTRY))
        at = lambda name, c: F.get(name, F.col("row")).alias(c)
        return found.join(self._blocks(), ["part", "block"]).select("path", "generation", at("offsets", "offset"), at("kinds", "kind"), at("roles", "role"), at("tss", "ts"), "session_id", "cwd", at("dls", "dl"), "tf")

    def frequency(self, wanted: list[tuple[str, ...]]) -> list[int] | None:
        """How many live entries have each phrase, from what postings say of their blocks, without the occurrences; None
        where a phrase has several terms, which only occurrences tell."""
        if any(len(p) > 1 for p in wanted):
            return None
        terms = sorted({p[0] for p in wanted})
        told = self._read("postings", POSTINGS, terms=terms).where(F.col("term").isin(*terms)).select("part", "block", "term", "df")
        live = self._dealt(self._of_live(self._read("facts", FACTS).select("part", "block", "path", "generation")).select("part", "block"))
        sums = {r["term"]: r["n"] for r in self._dealt(told).join(live, ["part", "block"], "left_semi").groupBy("term").agg(F.sum("df").alias("n")).collect()}
        return [sums.get(p[0], 0) for p in wanted]

    def at(self, hits: list[Row]) -> DataFrame:
        """The entries of a search's candidates, with session_id, cwd and score: journals and offsets are pushed down into the
        scan, whose files are sorted by them."""
        named = self.spark.createDataFrame([tuple(h[c] for c in (*KEYS, "session_id", "cwd", "score")) for h in hits], "path string, generation int, offset bigint, session_id string, cwd string, score double")
        held = self._read("entries", ENTRIES).where(F.col("path").isin(*{h["path"] for h in hits}) & F.col("offset").isin(*{h["offset"] for h in hits}))
        return held.join(F.broadcast(named), list(KEYS))  # no more rows than candidates

    def cwds(self, above: str | None = None) -> list[str]:
        """The distinct folders of the journals; above: only those that are this folder or lie above it, which are no more
        than its path has parts."""
        found = self.journals().select("cwd").dropna()
        if above is not None:
            path, parts = "", []
            for part in posixpath.normpath(above).strip("/").split("/"):
                path += f"/{part}"
                parts.append(path)
            # Folders that aren't written plainly are looked at by whoever asks.
            found = found.where(F.regexp_replace("cwd", "(?<=.)/+$", "").isin(*parts) | F.col("cwd").rlike(r"/\.\.?(/|$)|//"))
        return [r["cwd"] for r in found.distinct().collect()]

    def status(self) -> DataFrame:
        files = self.journals().agg(F.count(F.lit(1)).alias("files"), F.countDistinct("session_id").alias("sessions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("indexed_bytes"))
        rows = self.entries(joined=False).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("kind").isin(*SUMMARIES)).alias("summaries"))
        return files.crossJoin(rows)

    # One writer at a time

    def lease(self, owner: str, ttl_ms: int = 120_000, now_ms: int | None = None) -> bool:
        """Takes or renews the writer's lease; False while another holds one that has not run out."""
        return self.leases.take(owner, ttl_ms, now_ms if now_ms is not None else int(time.time() * 1000)) is not None

    def release(self, owner: str) -> None:
        self.leases.release(owner)

    @contextmanager
    def writing(self, owner: str, ttl_ms: int = 120_000) -> Iterator[Held | None]:
        """Holds the lease while it lasts, renewed by a heartbeat; None where another writer has it. The log knows its
        number before anything is written."""
        number = self.leases.take(owner, ttl_ms, int(time.time() * 1000))
        if number is None:
            yield None
            return
        held = Held(self.leases, number, owner, ttl_ms)
        try:
            self.log.commit(lambda m: None if m.fence == number else m, number)
            yield held
        finally:
            held.end()
