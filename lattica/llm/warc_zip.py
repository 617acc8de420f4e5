"""Operator 6: WARC records in ZIP archives, and a reader that needs no extraction.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``
(one gzip member for each record) and ``indexes/index.cdxj`` (a line of JSON
for each record with offset and length). The reader finds the end of the
central directory (or its ZIP64 form), the two members in it, reads the index
and then the records by ranges; neighbouring records come with one range.

Recovery: a writing task gives its archives names of their own and reports
them; only reported archives are ever read, so what a lost or repeated attempt
left behind is ignored. Archives lie in the shared folder and are reached by
``pyarrow.fs``.

Nulls: a null html is an empty payload; a null url is written as the empty
string; a null page_id stays null. Rows that repeat
the smallest page_id of a payload are the same page written again: all of them
are responses. A payload met only with null ids has no page to refer to: its
rows are responses. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records from which an archive is closed; the reader's ranges are at most RANGE bytes or one record.
ARCHIVE, RANGE = 32 << 20, 4 << 20
LEAST = 100
MAX32 = 0xFFFFFFFF


# ---- ZIP -----------------------------------------------------------------

class ZipWriter:
    """Stored members one after the other; ZIP64 records where sizes or offsets need them, or always if asked for."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.entries = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: Iterator[bytes], size: int, crc: int) -> int:
        """Write a member of known size and CRC; its data offset."""
        start, big = self.at, self.zip64 or size >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        s = MAX32 if big else size
        raw = name.encode()
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra)) + raw + extra)
        data = self.at
        for p in parts:
            self._put(p)
        if self.at - data != size:
            raise ValueError("size of the member")
        self.entries.append((raw, crc, size, start))
        return data

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start in self.entries:
            big = self.zip64 or size >= MAX32 or start >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            s, o = (MAX32, MAX32) if big else (size, start)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        length, n = self.at - begin, len(self.entries)
        if self.zip64 or begin >= MAX32 or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, begin))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, length, begin = 0xFFFF, MAX32, MAX32
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, length, begin, 0))


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, data offset, size) of a ZIP archive. ``read(offset, length)`` reads a range."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, n, length, begin = struct.unpack_from("<HHHHII", tail, at + 4)
    if n == 0xFFFF or length == MAX32 or begin == MAX32:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == b"PK\6\7":
            record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of a central directory")
            n, length, begin = struct.unpack_from("<QQQ", record, 32)
    directory, out, p = read(begin, length), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, p + 20)
        offset, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + name_n].decode()
        extra, e = directory[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, e)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, e + 4))
                full = next(wide) if full == MAX32 else full
                packed = next(wide) if packed == MAX32 else packed
                offset = next(wide) if offset == MAX32 else offset
            e += 4 + m
        local = read(offset, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("broken local header")
        out[name] = (method, offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        p += 46 + name_n + extra_n + comment_n
    return out


# ---- WARC ----------------------------------------------------------------

def record(kind: str, page: int | None, url: str | None, digest: str, length: int, payload: bytes, refers: int | None) -> bytes:
    """One WARC record, gzip-compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>", "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page": "" if page is None else str(page), "WARC-Payload-Length": str(length),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page": str(refers)}
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (behind the HTTP header) of a record that was decompressed."""
    cut = raw.index(b"\r\n\r\n")
    lines = raw[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = raw[cut + 4 : cut + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


# ---- Spark ---------------------------------------------------------------

def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, length, first): ``first`` is the page that holds the payload, for those that revisit it.

    First pages come from an aggregation with partial sums; only digests met more than once are joined back, without the payload's bytes in the aggregation.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    full = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("length"))
    key = F.when(F.col("length") >= LEAST, F.col("digest"))
    firsts = full.where(F.col("length") >= LEAST).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return full.join(firsts, key == firsts["d"], "left").drop("d")


def write_archives(planned: DataFrame, path: str, zip64: bool = False) -> DataFrame:
    """Write archives under ``path``; the manifest (archive, bytes, records), itself a written table."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        parts, lines, at, crc = [], [], 0, 0

        def close():
            name, index = f"{base}/{uuid.uuid4().hex}.wacz", "".join(lines).encode()
            with fs.open_output_stream(name) as out:
                z = ZipWriter(out, zip64)
                z.member(DATA, iter(parts), at, crc)
                z.member(INDEX, iter([index]), len(index), zlib.crc32(index))
                z.close()
            return pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "bytes": [z.at], "records": [len(lines)]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for r in batch.slice(lo, 500).to_pylist():
                    revisit = r["type"] == "revisit"
                    raw = record(r["type"], r["page_id"], r["url"], r["digest"], r["length"], (r["html"] or "").encode(), r["refers_to"] if revisit else None)
                    lines.append(json.dumps({"page": r["page_id"], "offset": at, "length": len(raw)}) + "\n")
                    parts.append(raw)
                    at, crc = at + len(raw), zlib.crc32(raw, crc)
                    if at >= ARCHIVE:
                        yield close()
                        parts, lines, at, crc = [], [], 0, 0
        if lines:
            yield close()

    return written(planned.mapInArrow(run, "archive string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """A row for each record: page_id, url, record_type, payload_bytes, payload_digest, refers_to and (responses) payload.

    The digest of a response is computed from what was read and must be the one in its header.
    """
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['archive']}") as f:
                    read = lambda offset, length: f.read_at(length, offset)
                    found = members(read, f.size())
                    for name in (DATA, INDEX):
                        if found[name][0]:
                            raise ValueError(f"{name} is not stored")
                    entries = [json.loads(x) for x in read(*found[INDEX][1:]).splitlines()]
                    rows, i = [], 0
                    while i < len(entries):
                        j, begin = i, entries[i]["offset"]
                        while j < len(entries) and (j == i or entries[j]["offset"] + entries[j]["length"] - begin <= RANGE):
                            j += 1
                        data = read(found[DATA][1] + begin, entries[j - 1]["offset"] + entries[j - 1]["length"] - begin)
                        for e in entries[i:j]:
                            raw = zlib.decompress(data[e["offset"] - begin : e["offset"] - begin + e["length"]], 31)
                            head, payload = parse(raw)
                            kind, digest, length = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
                            if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                                raise ValueError(f"{row['archive']}: broken record at {e['offset']}")
                            page, refers = head["WARC-Page"], head.get("WARC-Refers-To-Page")
                            rows.append((int(page) if page else None, head["WARC-Target-URI"], length, digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                        i = j
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names)
                        rows = []

    return manifest.select("archive").repartition(4 * n, F.xxhash64("archive")).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, zip64: bool = False) -> DataFrame:
    """Write a record for each page, then read them back from the archives."""
    spark = pages.sparkSession
    planned = plan_records(pages)
    kind = F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    rows = planned.withColumn("type", kind).select("page_id", "url", F.when(F.col("type") == "response", F.col("html")).alias("html"), "digest", "length", "type", F.col("first").alias("refers_to"))
    path = new_path(spark, "archives")
    return read_archives(write_archives(rows, path, zip64), path)
