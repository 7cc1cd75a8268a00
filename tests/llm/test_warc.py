import base64
import hashlib
import io
import random
import time
import uuid

import pytest

from daybook.llm import warc
from daybook.llm.common import shared_dir


def archive(n=6, zipped=True):
    raw = [warc.record("response", f"urn:x-page:{i}", "http://a/", f"<p>{i} é</p>".encode() * (i + 1)) for i in range(n)]
    return [warc.member(x) if zipped else x for x in raw]


@pytest.mark.parametrize("zipped", [True, False])
def test_records_and_gaps_cover_every_byte(zipped):
    parts = archive(zipped=zipped)
    rng = random.Random(5)
    for _ in range(60):
        data = bytearray(b"".join(parts))
        start = rng.randrange(len(data))
        for i in range(start, min(len(data), start + rng.randrange(1, 40))):
            data[i] = rng.randrange(256)
        if rng.random() < 0.5:
            del data[rng.randrange(len(data)) :]
        at, good = 0, []
        for offset, size, got in warc.salvage(bytes(data)):
            assert offset == at and size > 0
            at += size
            if not isinstance(got, str):
                good.append(got.headers["warc-record-id"])
        assert at == len(data)
        whole = [f"<urn:x-page:{i}>" for i, p in enumerate(parts) if bytes(data[sum(map(len, parts[:i])) :][: len(p)]) == p]
        assert set(whole) <= set(good)


def test_later_records_are_recovered():
    parts = archive()
    damaged = parts[0] + parts[1][:-9] + parts[2] + b"rubbish" + parts[3]
    got = list(warc.salvage(damaged))
    assert [g if isinstance(g, str) else g.headers["warc-record-id"][-2] for _, _, g in got] == ["0", got[1][2], "2", "no version line", "3"]
    assert isinstance(got[1][2], str)


def test_equal_payloads_are_stored_once(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "other"), (5, "u", "other"), (None, "u", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    pages.write.parquet(f"{path}/pages.parquet")
    got = sorted((r.asDict() for r in warc.op5_warc(spark, path).collect()), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    first = {"same": 1, "": 3, "other": 5, "lone": None}
    assert len(got) == len(rows)
    for r, (page, _, html) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        payload = (html or "").encode()
        assert r["page_id"] == page and r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["refers_to"] == (None if page == first[html or ""] else first[html or ""])
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")


def test_repeated_and_null_ids(spark):
    rows = [(1, "same"), (5, "same"), (5, "other"), (7, "other"), (None, "same"), (2, "two"), (6, "two"), (6, "same"), (None, "lone"), (None, "lone"), (9, "é" * 300_000)]
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, first string")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    pages.write.parquet(f"{path}/pages.parquet")
    first = {}
    for i, h in rows:
        first[h] = min((x for x in (i, first.get(h)) if x is not None), default=None)
    want = sorted(((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), first[h] if i != first[h] else None) for i, h in rows), key=str)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.op5_warc(spark, path).collect()]
    assert sorted(got, key=str) == want


def test_gaps_are_logged_and_large_files_streamed(spark, tmp_path):
    parts = [warc.record("response", f"urn:x-page:{i}", "http://a/", random.Random(i).randbytes(200_000)) for i in range(12)]
    zipped = [warc.member(x) for x in parts]
    zipped[3] = zipped[3][:1000] + b"?" * 50 + zipped[3][1050:]
    parts[5] = parts[5][:-30]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(zipped))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(parts))
    for through_spark in (False, True):
        read = warc.read_archives(spark, f"file://{tmp_path}/in", through_spark=through_spark)
        log = f"file://{tmp_path}/gaps-{through_spark}"
        records = warc.logged(read, log).select("path", "record_id", "payload_bytes").collect()
        assert len(records) == 22
        gaps = {r["path"][-7:]: (r["offset"], r["length"]) for r in spark.read.parquet(log).collect()}
        assert gaps == {"warc.gz": (sum(map(len, zipped[:3])), len(zipped[3])), "/b.warc": (sum(map(len, parts[:5])), len(parts[5]))}


def test_empty_table(spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert warc.op5_warc(spark, path).collect() == []


class Counting(io.BytesIO):
    """Tells the largest piece that was read at once."""

    most = 0

    def read(self, n=-1):
        got = super().read(n)
        self.most = max(self.most, len(got))
        return got


def test_a_wrong_length_costs_no_reading_of_what_it_spans(monkeypatch):
    parts = [warc.record("response", f"urn:x-page:{i}", "http://a/", random.Random(i).randbytes(20_000)) for i in range(3000)]
    length = parts[0].split(b"Content-Length: ")[1].split(b"\r\n")[0]
    longer = str(sum(map(len, parts)) - 500).encode()
    for wrong in (longer, b"99999999999", b"99999999999999999999999999"):
        first = parts[0].replace(b"Content-Length: " + length + b"\r\n\r\nHTTP", b"Content-Length: " + wrong + b"\r\n\r\nHTTP")
        assert first != parts[0]
        stream = Counting(b"".join([first, *parts[1:]]))
        began = time.process_time()
        got = list(warc.salvage(stream))
        assert time.process_time() - began < 20 and stream.most < 1 << 20
        assert (got[0][0], got[0][1]) == (0, len(first)) and got[0][2] in ("bad length", "too long")
        assert [g.headers["warc-record-id"] for _, _, g in got[1:]] == [f"<urn:x-page:{i}>" for i in range(1, 3000)]


def test_records_and_members_that_are_too_long(monkeypatch):
    monkeypatch.setattr(warc, "MOST", 100_000)
    monkeypatch.setattr(warc, "HEAD", 2000)
    short, long = (warc.record("response", "urn:x-page:1", "http://a/", b"x" * n) for n in (1000, 150_000))
    bomb = warc.member(b"\0" * 50_000_000)
    for parts in ([long, short], [warc.member(long), warc.member(short)], [bomb, warc.member(short)], [bomb, short]):
        got = list(warc.salvage(b"".join(parts)))
        assert [g if isinstance(g, str) else "record" for _, _, g in got] == ["too long", "record"]
        assert [(at, n) for at, n, _ in got] == [(0, len(parts[0])), (len(parts[0]), len(parts[1]))]
