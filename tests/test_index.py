"""The index's log, lease, merges and bounded ingest, with crashes at every step."""

import itertools
import json
import os
import pickle
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from daybook.functions.text import phrases
from daybook.operators import index as index_module
from daybook.operators import log as log_module
from daybook.operators.engine import Engine
from daybook.operators.history import History, found
from daybook.operators.index import Index
from daybook.operators.log import KEPT, Fenced, Files, Held, Leases, Log, Manifest
from daybook.operators.search import matches_in_postings, ranked
from daybook.plans.scope import Context, Filters, Request
from daybook.sources.journal import _StreamReader, bundles, lag_of, next_line, register, spans
from daybook.streaming import ingest
from tests.test_engine import HOME, header, message, write

LINES = "path string, generation int, offset bigint, length int, line string"


def lines_df(spark, *entries):
    """entries: (path, generation, offset, id, text)."""
    rows = [(p, g, o, 10, json.dumps(header(i, "/w") if t is None else message(i, "user", t))) for p, g, o, i, t in entries]
    return spark.createDataFrame(rows, LINES)


def ids(index):
    return sorted((r["path"], r["entry_id"]) for r in index.entries(joined=False).collect())


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"))


class Crash(Exception):
    pass


def crashing(monkeypatch, step):
    """From now on the step-th change of a file, and the step-th write of a table, never happens."""
    count = itertools.count()

    def once(real):
        def call(*args, **more):
            if next(count) == step:
                raise Crash
            return real(*args, **more)

        return call

    for name in ("create", "replace", "remove"):
        monkeypatch.setattr(Files, name, once(getattr(Files, name)))
    monkeypatch.setattr(Index, "_write", once(Index._write))


# The log


def test_one_of_many_commits_at_a_time(tmp_path):
    log = Log(Files(str(tmp_path)))

    def commit():
        for _ in range(10):
            log.commit(lambda m: Manifest(version=m.version, batch=m.batch + 1))

    threads = [threading.Thread(target=commit) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert (log.current().version, log.current().batch) == (60, 59)
    log.clean()
    assert len(log.files.names("log")) == KEPT and log.current().version == 60


def test_clean_keeps_what_a_version_names(index, spark):
    index.append(lines_df(spark, ("a", 0, 0, "1", "x")), 0)
    folder = index.manifest.parts[0].folder
    os.makedirs(f"{index.base}/parts/left-by-a-crash")
    index.log.clean()
    assert index.files.names("parts") == [folder.removeprefix("parts/")]


def test_append_is_exactly_once(index, spark):
    assert index.append(lines_df(spark, ("a", 0, 0, "1", "x y"), ("a", 0, 10, "1", "again")), 0) == 1
    assert index.append(lines_df(spark, ("a", 0, 20, "2", "z")), 0) == 0
    assert index.append(lines_df(spark, ("a", 0, 20, "1", "known"), ("a", 0, 30, "2", "z")), 1) == 1
    assert ids(index) == [("a", "1"), ("a", "2")]


@pytest.mark.parametrize("step", range(3))
def test_a_crash_at_any_step_of_any_change(spark, tmp_path, monkeypatch, step):
    index = Index(spark, str(tmp_path / "index"))
    index.append(lines_df(spark, ("a", 0, 0, "1", "x"), ("b", 0, 0, "2", "y")), 0)
    index.append(lines_df(spark, ("b", 0, 20, "3", "y"), ("c", 0, 0, "4", "z")), 1)
    whole = [("a", "1"), ("b", "2"), ("b", "3"), ("c", "4")]
    changes = [
        (lambda: index.append(lines_df(spark, ("d", 0, 0, "5", "w")), 2), [*whole, ("d", "5")]), (lambda: index.forget(["b"]), [("a", "1"), ("c", "4"), ("d", "5")]),
        (index.compact, [("a", "1"), ("c", "4"), ("d", "5")]), (index.clear, []),
    ]
    before = whole
    if step == 2:  # only what removes old parts has a third step
        changes, before = [(index.compact, whole)], whole
    for change, after in changes:
        with monkeypatch.context() as m:
            crashing(m, step)
            try:
                change()
            except Crash:
                pass
        assert ids(index) in (before, after)
        change()
        assert ids(index) == after
        before = after


def test_readers_keep_their_version(index, spark):
    index.append(lines_df(spark, ("a", 0, 0, "1", "x"), ("b", 0, 0, "2", "y")), 0)
    old = index.pinned()
    index.forget(["a"])
    index.compact()
    assert ids(old) == [("a", "1"), ("b", "2")] and ids(index) == [("b", "2")]
    assert old.matches(phrases("x")).count() == 1 and index.matches(phrases("x")).count() == 0


# Merging


def test_merges_keep_parts_few_and_answers_equal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "FANOUT", 3)
    monkeypatch.setattr(index_module, "STRETCH", 40)
    monkeypatch.setattr(log_module, "KEPT", 2)
    rng = random.Random(4)
    vocabulary = ["otter", "shield", "the", "that", "é", "x2"]
    entries, at = [], dict.fromkeys("abc", 0)
    for i in range(60):
        path = rng.choice("abc")
        entries.append((path, 1 if path == "c" and i > 30 else 0, at[path], str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))))
        at[path] += 20
    many, one = Index(spark, str(tmp_path / "many")), Index(spark, str(tmp_path / "one"))
    most = 0
    for i in range(10):
        many.append(lines_df(spark, *entries[6 * i : 6 * i + 6]), i)
        many.merge()
        most = max(most, len(many.manifest.parts))
    one.append(lines_df(spark, *entries), 0)
    assert most <= 2 * 3 and len(many.files.names("parts")) <= 6 + 3
    assert ids(many) == ids(one)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for query in ("otter", "the that", "shield-otter x2", "nothing"):
        wanted = phrases(query)
        columns = ["path", "generation", "offset", "kind", "role", "ts", "dl", "tf"]
        assert rows(many.matches(wanted).select(columns)) == rows(one.matches(wanted).select(columns))
        # From the entries' own postings, and from their texts.
        plain = matches_in_postings(many.postings(), wanted, ("path", "generation", "offset"))
        assert rows(plain) == rows(many.matches(wanted).select("path", "generation", "offset", "tf"))
        texts = {(p, g, o): t.split() for p, g, o, _, t in entries if (p, g) != ("c", 0)}
        want = {k: [sum(tuple(w[i : i + len(p)]) == p for i in range(len(w))) for p in wanted] for k, w in ((k, [x.replace("é", "e") for x in t]) for k, t in texts.items())}
        assert {tuple(r[:3]): r["tf"] for r in many.matches(wanted).select("path", "generation", "offset", "tf").collect()} == {k: v for k, v in want.items() if any(v)}
        if all(len(p) == 1 for p in wanted):
            assert many.frequency(wanted) == [sum(v[i] > 0 for v in want.values()) for i in range(len(wanted))]
    assert many.frequency(phrases("a-b")) is None
    many.compact()
    assert len(many.manifest.parts) == 1 and ids(many) == ids(one)
    assert all(r["generation"] == 1 for r in many._read("journals", index_module.JOURNALS).where("path = 'c'").collect())
    with monkeypatch.context() as m:
        m.setattr(Index, "_rewritten", None)
        many.merge()  # nothing to merge


def test_stored_statistics_give_the_same_scores(index, spark):
    rng = random.Random(7)
    index.append(lines_df(spark, ("a", 0, 0, "h", None), *[("a", 0, 20 * i, str(i), " ".join(rng.choice("pqrstuv") for _ in range(9))) for i in range(1, 80)]), 0)
    wanted = phrases("p")
    score = lambda df: sorted((r["offset"], round(r["score"], 12)) for r in df.collect())
    filters = Filters(kinds=("user",), session_id="h")
    assert score(found(index, wanted, filters)) == score(ranked(index.matches(wanted), filters, 1, index.corpus())) != []


def test_a_search_reads_entries_for_its_candidates_only(index, spark, monkeypatch):
    index.append(lines_df(spark, ("a", 0, 0, "h", None), *[("a", 0, 20 * i, str(i), f"word w{i}") for i in range(1, 60)]), 0)
    asked = []
    real = Index._read
    monkeypatch.setattr(Index, "_read", lambda self, table, *a, **k: asked.append(table) or real(self, table, *a, **k))
    got = History(index).answer(Request("search", query="w7", scope="global"), Context("h", "/w", HOME))
    assert [e["entryId"] for e in got["entries"]] == ["7"] and asked.count("entries") == 1
    hits = found(index, phrases("w7"), Filters()).collect()
    assert index.at(hits).count() == 1
    plan = index.at(hits)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "(path" in plan and "(offset" in plan


# One writer


def test_a_batch_longer_than_the_lease_keeps_it(index, spark):
    with index.writing("a", 300) as lease:
        time.sleep(1.2)
        assert not index.lease("b", 60_000)
        lease()
        index.append(lines_df(spark, ("a", 0, 0, "1", "x")), 0, lease)
    assert index.lease("b", 60_000)


def test_a_slow_writer_is_fenced(index, spark, monkeypatch):
    """Its heart stops, another takes over: nothing it does afterwards gets in."""
    monkeypatch.setattr(Held, "_beats", lambda self: None)
    with index.writing("slow", 50) as slow:
        time.sleep(0.1)
        with index.writing("next", 60_000) as following:
            assert following is not None and following.number > slow.number
            for change in (lambda: index.append(lines_df(spark, ("a", 0, 0, "1", "x")), 0, slow), lambda: index.clear(slow), lambda: index.progress(1, 1, slow), slow):
                with pytest.raises(Fenced):
                    change()
            index.append(lines_df(spark, ("a", 0, 0, "2", "y")), 0, following)
        assert ids(index) == [("a", "2")]
    with index.writing("third", 60_000) as third:
        assert third is not None


def test_a_dead_writer_is_followed_by_one(tmp_path):
    """No lock is left behind by who died while taking the lease; of those that wait one gets it."""
    leases = Leases(Files(str(tmp_path)))
    assert leases.take("dead", 1000, 0) == 1
    got, start = [], threading.Barrier(8)

    def take(i):
        start.wait()
        got.append(leases.take(f"w{i}", 60_000, 2000))

    threads = [threading.Thread(target=take, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(x for x in got if x) == [2]
    assert not leases.renew(1, "dead", 1000, 2500)


# Bounded ingest


def admitted(reader):
    """Batches of offsets until nothing is left over, as Spark asks for them."""
    out, was = [], {}
    while True:
        now = json.loads(json.dumps(reader.latestOffset()))
        if now == was:
            return out
        out.append((reader.partitions(was, now), now))
        was = now


def test_batches_stay_below_the_cap_and_newest_come_first(tmp_path):
    root = str(tmp_path)
    for i in range(5):
        write(f"{root}/{i}.jsonl", *["x" * 9] * 10)
        os.utime(f"{root}/{i}.jsonl", (i, i))
    write(f"{root}/long.jsonl", "y" * 500, "z")
    os.utime(f"{root}/long.jsonl", (10, 10))
    batches = admitted(_StreamReader({"path": root, "maxbytes": "150", "packbytes": "64", "splitbytes": "60"}))
    size = lambda b: sum(s.stop - s.start for x in b for s in x.spans)
    assert [size(b) for b, _ in batches] == [501, 142, 150, 150, 60][: len(batches)] and sum(size(b) for b, _ in batches) == 1003
    order = list(dict.fromkeys(os.path.basename(s.path) for b, _ in batches for x in b for s in x.spans))
    assert order == ["long.jsonl", *[f"{i}.jsonl" for i in (4, 3, 2, 1, 0)]]
    assert batches[0][1][""][1] == 6 and batches[0][1][""][0] > 0 and batches[-1][1][""] == [0, 6]
    assert lag_of(str(batches[-1][1])) == (0, 6) and lag_of(None) is None


def test_only_and_skip_and_opening(tmp_path, monkeypatch):
    root = str(tmp_path)
    for name in "abc":
        write(f"{root}/{name}.jsonl", name)
    one = _StreamReader({"path": root, "only": f"{root}/b.jsonl", "skip": f"{root}/c.jsonl"})
    assert one.latestOffset() == {f"{root}/b.jsonl": [0, 2], "": [1, 2]}
    whole = _StreamReader({"path": root})
    first = whole.latestOffset()
    monkeypatch.setattr("daybook.sources.journal.complete_bytes", lambda *a: 1 / 0)
    assert whole.latestOffset() == first  # nothing is opened again


def test_lines_and_bundles(tmp_path):
    path = str(tmp_path / "x")
    with open(path, "w") as f:
        f.write("ab\n" + "c" * (3 << 20) + "\nhalf")
    size = os.path.getsize(path)
    assert [next_line(path, at, size) for at in (0, 3, size - 4)] == [3, 4 + (3 << 20), size - 4]
    assert next_line(str(tmp_path / "none"), 0, 5) == 0
    held = bundles(spans("a", 0, 0, 10, 100) + spans("b", 0, 0, 95, 50) + spans("c", 0, 0, 3, 9), 60)
    assert [[(s.path, s.start, s.stop) for s in b.spans] for b in held] == [[("a", 0, 10), ("b", 0, 50)], [("b", 50, 95), ("c", 0, 3)]]


def journals(root, n=6):
    for i in range(n):
        write(f"{root}/{i}.jsonl", header(f"s{i}", "/w"), *[message(f"{i}-{j}", "user", f"word{i} common") for j in range(4)])
        os.utime(f"{root}/{i}.jsonl", (1000 + i, 1000 + i))


def test_a_first_pass_of_many_batches_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "journals"), str(tmp_path / "engine"), most_bytes=900)
    journals(engine.root)
    register(spark)
    real, calls = Index.append, []

    def append(self, lines, batch, lease=None):
        calls.append((batch, sorted({os.path.basename(r["path"]) for r in lines.select("path").distinct().collect()}), lines.agg(F.sum(F.col("length") + 1)).first()[0]))
        if len(calls) == 2:
            raise Crash("in the middle")
        return real(self, lines, batch, lease)

    with monkeypatch.context() as m:
        m.setattr(Index, "append", append)
        with pytest.raises(Exception, match="in the middle"):
            engine.refresh()
        # The journal written last is there already, and answers say what is not.
        got = History(engine.index).answer(Request("search", query="word5", scope="global"), Context("x", "/", HOME))
        assert got["totalMatches"] > 0 and "journals are still to be indexed" in got["indexing"]
        done = engine.refresh()
    assert done["files"] == 6 and done["batches"] >= 3
    assert all(size <= 900 for _, _, size in calls) and calls[0][1] == ["4.jsonl", "5.jsonl"] and calls[-1][1][0] == "0.jsonl" and calls[1][0] == calls[2][0] == 1
    assert len(ids(engine.index)) == 24
    assert "indexing" not in History(engine.index).answer(Request("search", query="common", scope="global"), Context("x", "/", HOME))


def test_stop_between_batches_and_the_callers_own_journal(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "journals"), str(tmp_path / "engine"), most_bytes=900)
    journals(engine.root, 4)
    register(spark)
    assert engine.refresh(stop=lambda: True)["batches"] == 1
    assert {p for p, _ in ids(engine.index)} == {f"{engine.root}/3.jsonl"}
    own = f"{engine.root}/0.jsonl"
    got = engine.query(Request("search", query="word0", scope="global"), Context("s0", "/w", HOME, journal=own))
    assert got["totalMatches"] == 4 and "indexing" in got
    assert {p for p, _ in ids(engine.index)} == {own, f"{engine.root}/3.jsonl"}
    engine.refresh()
    assert len(ids(engine.index)) == 16 and engine.index.manifest.done == engine.index.manifest.files == 4


def test_a_crash_in_a_rebuild_leaves_an_index_that_catches_up(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "journals"), str(tmp_path / "engine"))
    journals(engine.root, 2)
    engine.refresh()
    with monkeypatch.context() as m:
        m.setattr(ingest, "catch_up", lambda *a, **k: (_ for _ in ()).throw(Crash()))
        with pytest.raises(Crash):
            engine.command("rebuild")
    assert ids(engine.index) == []
    engine.refresh()
    assert len(ids(engine.index)) == 8


def test_a_followed_folder_tells_its_progress(spark, tmp_path):
    root, index = str(tmp_path / "journals"), Index(spark, str(tmp_path / "index"))
    journals(root, 3)
    query = ingest.follow(spark, root, index, str(tmp_path / "checkpoint"), every="200 milliseconds", most_bytes=900)
    listener = ingest.Progress(index, str(query.id))
    spark.streams.addListener(listener)
    try:
        until = time.time() + 90
        while time.time() < until and index.log.current().done < 3:
            time.sleep(0.2)
        write(f"{root}/late.jsonl", message("late", "user", "later"))
        while time.time() < until and index.log.current().done < 4:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    assert (index.log.current().done, index.log.current().files) == (4, 4) and len(ids(index)) == 13


# What a stream has read, as files


def test_a_ledger_admits_what_the_whole_offset_does_and_names_no_journal(tmp_path, monkeypatch):
    """The same batches as without one, also from a new reader each time; offsets and partitions don't grow with the
    journals, and rows are sorted in pieces."""
    monkeypatch.setattr("daybook.sources.ledger.HELD", 3)
    root, folder = str(tmp_path / "journals"), str(tmp_path / "ledger")
    for i in range(40):
        write(f"{root}/{i % 3}/{i}.jsonl", *["x" * 9] * (i % 7))
        os.utime(f"{root}/{i % 3}/{i}.jsonl", (i % 5, i % 5))
    write(f"{root}/long.jsonl", "y" * 500, "z")
    options = {"path": root, "maxbytes": "150", "packbytes": "64", "splitbytes": "60"}
    whole, was, now, batches = _StreamReader(options), {}, {}, 0
    shown = lambda parts: [[(s.path, s.generation, s.start, s.stop, s.begins) for s in p.spans] for p in parts]
    plain = lambda parts: {s for p in shown(parts) for s in p}
    grown = 0
    while True:
        one = _StreamReader(options | {"ledger": folder})
        one.partitions(now, now)
        if now:
            one.commit(now)
        expected, got = json.loads(json.dumps(whole.latestOffset())), json.loads(json.dumps(one.latestOffset()))
        if expected == was:
            assert got == now
            if grown == 2:
                break
            # A journal that has grown, one that was rewritten, one without a whole line, one that is new.
            with open(f"{root}/1/1.jsonl", "a") as f:
                f.write("more\n")
            write(f"{root}/0/6.jsonl", "short")
            write(f"{root}/0/new{grown}.jsonl", "n")
            with open(f"{root}/half.jsonl", "a") as f:
                f.write("half")
            grown += 1
            continue
        assert got[""] == expected[""] and len(json.dumps(got)) < 100
        parts = one.partitions(now, got)
        assert shown(parts) == shown(_StreamReader(options | {"ledger": folder}).partitions(now, got))
        assert plain(parts) == plain(whole.partitions(was, expected))
        assert max(len(pickle.dumps(p)) for p in parts) < 300 if parts else True
        assert sum(x.count for x in parts) == len(plain(parts))
        was, now, batches = expected, got, batches + 1
    assert batches > 8 and len(os.listdir(folder)) < 20


def test_a_ledger_takes_over_an_offset_that_has_every_journal(tmp_path):
    root, folder = str(tmp_path / "journals"), str(tmp_path / "ledger")
    for i in range(6):
        write(f"{root}/{i}.jsonl", str(i))
    before = _StreamReader({"path": root}).latestOffset()
    write(f"{root}/7.jsonl", "7")
    for _ in range(2):  # the second time after a crash before the offset was kept
        one = _StreamReader({"path": root, "ledger": folder})
        one.partitions(before, before)
        after = one.latestOffset()
        assert [(s.path, s.start, s.stop) for p in one.partitions(before, after) for s in p.spans] == [(f"{root}/7.jsonl", 0, 2)]
    again = _StreamReader({"path": root, "ledger": folder})
    again.partitions(after, after)
    assert again.latestOffset() == after and len(again.partitions(before, after)) == 1
    with pytest.raises(ValueError, match="rebuild"):
        again.partitions(after, {"version": "gone"})


def test_offsets_of_a_stream_name_no_journal(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "journals"), str(tmp_path / "engine"), most_bytes=900)
    journals(engine.root, 9)
    engine.refresh()
    folder = f"{engine.checkpoint}/{engine.index.log.current().epoch}/offsets"
    held = [open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.isdigit()]
    assert len(held) > 3 and not any(".jsonl" in x for x in held) and len(ids(engine.index)) == 36
    engine.command("rebuild")
    assert len(ids(engine.index)) == 36 and len(os.listdir(f"{engine.index.base}/ledgers")) == 1


def test_joins_of_a_large_index_broadcast_no_table_by_its_compressed_size(index, monkeypatch):
    """Many entries that compress well: neither a search, a listing nor a merge broadcasts a scan or a cached table of
    them, or a row for each journal."""
    spark = index.spark
    rows = spark.range(3000).select(F.concat(F.lit("/" + "j" * 200), F.col("id"), F.lit(".jsonl")).alias("path"), "id")
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.col("id").cast("string").alias("id"), F.struct(F.lit("user").alias("role"), F.lit("common words").alias("content")).alias("message")))
    lines = rows.select("path", F.lit(0).alias("generation"), F.lit(0).cast("bigint").alias("offset"), F.lit(10).alias("length"), line.alias("line"))
    monkeypatch.setattr(index_module, "FEW", 100, raising=False)
    monkeypatch.setattr(index_module, "FEW_JOURNALS", 100, raising=False)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "100k")
    try:
        index.append(lines.where("id < 1500"), 0)
        index.append(lines.where("id >= 1500"), 1)
        plans = []
        real = Index._write

        def write(self, entries, facts, hits, journals, level):
            plans.extend([entries, hits])
            return real(self, entries, facts, hits, journals, level)

        monkeypatch.setattr(Index, "_write", write)
        index.compact()
        hits = index.matches([("common",), ("words",)])
        assert index.entries().count() == hits.count() == 3000 and index.frequency([("common",)]) == [3000]
        listed = index.entries()
        assert {tuple(r) for r in listed.groupBy("session_id").count().collect()} == {(None, 3000)}
        for df in (plans[0], listed, hits):
            df.collect()
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    finally:
        spark.conf.unset(limit)
