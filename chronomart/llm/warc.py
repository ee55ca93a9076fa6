"""Web archives: a writer of one gzip member a record with revisits of equal payloads, and a reader that many tasks share a file by."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import new_folder, slices, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WINDOW = 1 << 20
WRITTEN = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, path string, offset long"


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, key, refers_to): of equal payloads of at least so many bytes, those with the largest page_id are told by all others.

    A null html is an empty payload; a null page_id is below all others, and rows that are all without one are told by none. Rows that
    share the largest page_id and the payload are all responses. Payloads are compared by SHA-256. Only ids and digests are grouped and
    joined to find the copies; payloads move at most once, to meet what their page refers to.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    narrow = d.filter(F.octet_length("html") >= least).select("page_id", "key")
    told = narrow.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1 and refers_to is not null").drop("_n")
    copies = narrow.join(told, "key").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    copies = written(copies.withColumnsRenamed({"page_id": "_id", "key": "_key"}), "revisits")
    return d.join(copies, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("page_id", "url", "html", "key", "refers_to")


def record_id(page_id: int | None, key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{key}'.encode()).digest()[:16], version=5)}>"


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: bytes, key: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the headers of one."""
    again = refers_to is not None
    fields = [
        ("WARC-Record-ID", record_id(page_id, key)), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(html).digest()).decode()), ("WARC-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"),
    ]
    if again:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, key)), ("WARC-Refers-To-Page-ID", refers_to)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    return record("revisit" if again else "response", fields, http if again else http + html)


def write_archives(pages: DataFrame, folder: str | None = None, *, least: int = 0, level: int = 6, most: int = 1 << 30, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives into a folder of the shared file system; gives (path, records, bytes) of each file.

    Each task streams its rows into files of about `most` bytes at most, one gzip member a record, a warcinfo record first. A file gets
    its name when it is whole, and the names are those of the attempts that succeeded: what a lost task left behind is in no list. Which
    pages are revisits: see with_revisits. Control characters and spaces of an address are percent-encoded; a null one is left out.
    An empty table gives no files; other columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, done = None, []
        info = gzip.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level, mtime=0)

        def close() -> None:
            out.close()
            store.move(f"{path}.part", path)
            done.append((uri, records, size))

        for b in slices(batches):
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "key", "refers_to")), strict=True):
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = fs.FileSystem.from_uri(uri)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, records, size = store.open_output_stream(f"{path}.part"), 0, len(info)
                    out.write(info)
                i, url, html, key, refers_to = row
                member = gzip.compress(page_record(i, url, html.encode(), key, refers_to, date), level, mtime=0)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= most:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return written(with_revisits(pages, least).mapInArrow(write, WRITTEN), "archives")


class Reader:
    """A file through a window that moves on."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size, self.base, self.held = f, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        n = max(min(n, self.size - pos), 0)
        if not self.base <= pos <= pos + n <= self.base + len(self.held):
            self.f.seek(pos)
            self.base, self.held = pos, self.f.read(min(max(n, WINDOW), self.size - pos))
        return self.held[pos - self.base : pos - self.base + n]

    def find(self, pos: int, end: int) -> int | None:
        """The first gzip magic that starts in [pos, end)."""
        while pos < end:
            part = self.at(pos, min(WINDOW, end - pos + len(MAGIC) - 1))
            k = part.find(MAGIC)
            if k >= 0:
                return pos + k
            pos += max(len(part) - len(MAGIC) + 1, 1)
        return None

    def member(self, start: int) -> tuple[dict[str, str], bytes, int] | None:
        """The header fields and block of the record whose gzip member begins here, and where it ends; None where no such member begins.

        The first bytes must inflate to a record's head, and the whole to just the block it declares. A member that begins as a record and then breaks is an error.
        """
        z, parts, pos, step, said = zlib.decompressobj(31), [], start, 1 << 14, False
        try:
            while not z.eof:
                chunk = z.unconsumed_tail or self.at(pos, step)
                if not z.unconsumed_tail:
                    pos, step = pos + len(chunk), min(step * 2, WINDOW)
                if not chunk:
                    raise zlib.error("the file ends within a member")
                parts.append(z.decompress(chunk, 0 if said else 5))  # first only so much that the head shows
                if not said and sum(map(len, parts)) >= 5:
                    if not b"".join(parts).startswith(b"WARC/"):
                        return None
                    said = True
        except zlib.error as e:
            if said:
                raise ValueError(f"the record at {start} is broken") from e
            return None
        data, end = b"".join(parts), pos - len(z.unused_data)
        head, mark, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not mark or not first.startswith(b"WARC/"):
            return None
        fields = {}
        for line in lines:
            if line[:1] in (b" ", b"\t") and fields:  # a folded line
                fields[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        n = fields.get("content-length", "")
        if not n.isdigit() or rest[int(n) :] != b"\r\n\r\n":
            raise ValueError(f"the record at {start} is not as long as it says")
        return fields, rest[: int(n)], end


def records_of(f, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose members start in [start, end): offset, header fields, block."""
    reader, pos = Reader(f, size), start
    while (pos := reader.find(pos, end)) is not None:
        found = reader.member(pos)
        if found is None:
            pos += 1
            continue
        fields, block, after = found
        yield pos, fields, block
        pos = after


def _row(offset: int, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    kind, digest, n, payload = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = len(payload)
        if kind == "revisit":
            told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            n, payload = int(told[0]) if told else None, None
        else:
            real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, real):
                raise ValueError(f"the payload of the record at {offset} does not have its digest")
            digest = real
    return number("warc-page-id"), fields.get("warc-target-uri"), kind, n, digest, number("warc-refers-to-page-id"), payload if payloads else None, offset


def read_archives(archives: DataFrame, *, split: int | None = 32 << 20, payloads: bool = True) -> DataFrame:
    """Every record of archives (path, bytes), gzip with a member a record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, path, offset.

    Files are cut into byte ranges of `split` bytes. A task looks in its range for the gzip magic, takes a place as a record if a member
    inflates there to a record's head, and owns the records that start in its range; the last of them it reads on beyond it. Magic bytes
    within compressed data are no records, as they do not inflate to a head. Payloads are checked against their digests; a revisit has the
    length and digest of the full payload. A broken record is an error. Other record types have no payload.

    One case needs split=None, a task a file: a record that holds another archive's records without compressing them and lies across the
    edge of a range. The writer above makes none, since UTF-8 text cannot hold the magic. Empty files have no records; other columns are left out.
    """
    d = archives.filter("bytes > 0").select(F.col("path").alias("uri"), F.col("bytes").alias("size"))
    step = F.col("size") if split is None else F.lit(split).cast("long")
    d = d.withColumns({"begin": F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step))}).withColumn("end", F.least(F.col("begin") + step, F.col("size")))
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split(" ")[1]] for c in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for uri, size, begin, end in zip(*(b.column(c).to_pylist() for c in ("uri", "size", "begin", "end")), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for offset, fields, block in records_of(f, begin, end, size):
                        *values, at = _row(offset, fields, block, payloads)
                        rows.append((*values, uri, at))
                        held += len(block) if payloads else 200
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    pieces = d.count()
    return d.repartition(max(1, min(pieces, 100_000))).mapInArrow(read, RECORD)
