"""Web archives: round trips, revisits, ranges that cut records anywhere, and bytes that only look like records."""

import base64
import gzip
import hashlib
import io
import random

import pytest

pytest.importorskip("chronomart.llm")

from chronomart.llm import warc

KIND = "page_id long, url string, html string, path string, key int"
PAGES = [
    (5, "http://a/1", "same", "x", 1), (9, "http://a/2", "same", "x", 1), (7, None, "same", "x", 1), (None, "http://a/4", "same", "x", 1), (9, "http://a/5 \n", "same", "x", 1), (1, "http://é", None, "x", 1),
    (2, "", "", "x", 1), (3, "http://a/8", "é\r\n\r\n\x1f\u008b\x08 WARC/1.1\r\n\r\n" * 50, "x", 1), (4, "http://a/9", "z" * 300_000, "x", 1), (4, "http://a/9", "other", "x", 1),
    (None, "n", "only null ids", "x", 1), (None, "n", "only null ids", "x", 1), (12, "http://a/12", "once", "x", 1),
]


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def want(pages, least=0):
    out = []
    for i, url, html, *_ in pages:
        b = (html or "").encode()
        ids = [j for j, _, h, *_ in pages if (h or "").encode() == b and j is not None]
        told = max(ids, default=None) if len(b) >= least else None
        again = told is not None and i != told
        url = url and url.replace(" ", "%20").replace("\n", "%0A").replace("é", "%C3%A9")
        out.append((i, url, "revisit" if again else "response", len(b), sha(b), told if again else None, None if again else b))
    return sorted(out, key=repr)


def rows(df):
    d = df.filter("record_type <> 'warcinfo'").select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    return sorted(((*r[:6], r[6] if r[6] is None else bytes(r[6])) for r in d.collect()), key=repr)


def test_round_trip_over_any_ranges(spark):
    d = spark.createDataFrame(PAGES, KIND)
    files = warc.write_archives(d, most=3000)
    assert files.count() > 1 and files.agg({"records": "sum"}).first()[0] == len(PAGES)
    for split in (None, 1 << 20, 997, 64):
        assert rows(warc.read_archives(files, split=split)) == want(PAGES)
    assert warc.read_archives(files, payloads=False).filter("payload is not null").count() == 0
    assert rows(warc.read_archives(warc.write_archives(d, least=5))) == want(PAGES, 5)
    assert rows(warc.read_archives(warc.write_archives(d.limit(0)))) == []


def member(payload, level=6, kind="response"):
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return gzip.compress(warc.record(kind, [("WARC-Payload-Digest", "sha1:" + sha(payload))], block), level)


def test_magic_within_records_is_no_record():
    g = random.Random(1)
    payloads = [bytes(g.randrange(256) for _ in range(g.randrange(400))) + warc.MAGIC * g.randrange(4) + gzip.compress(b"not a record") * g.randrange(3) for _ in range(40)]
    data = b"".join(member(p, level=g.choice([0, 6])) for p in payloads)
    whole = [k for k, _, _ in warc.records_of(io.BytesIO(data), 0, len(data), len(data))]
    assert len(whole) == 40
    for step in (1, 13, 500, len(data)):
        got = [(k, b.partition(b"\r\n\r\n")[2]) for s in range(0, len(data), step) for k, _, b in warc.records_of(io.BytesIO(data), s, min(s + step, len(data)), len(data))]
        assert got == list(zip(whole, payloads, strict=True))


def test_the_window_moves_over_long_files(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 64)
    data = b"\0" * 150 + member(b"a" * 5000) + b"junk" * 40 + member(b"b")
    assert [b.partition(b"\r\n\r\n")[2][:1] for _, _, b in warc.records_of(io.BytesIO(data), 0, len(data), len(data))] == [b"a", b"b"]


def test_nested_archives_need_whole_files():
    inner = member(b"inner")
    data = member(inner * 3, level=0) + member(b"after")
    assert len(list(warc.records_of(io.BytesIO(data), 0, len(data), len(data)))) == 2


def test_broken_records_are_errors():
    good = member(b"payload" * 100)
    list(warc.records_of(io.BytesIO(good), 0, len(good), len(good)))
    for bad in (good[:-9], good[:-8] + bytes(4) + good[-4:], gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(bad), 0, len(bad), len(bad)))
    fields, block = next(iter([(f, b) for _, f, b in warc.records_of(io.BytesIO(good), 0, len(good), len(good))]))
    with pytest.raises(ValueError):
        warc._row(0, fields, block + b"x", True)
