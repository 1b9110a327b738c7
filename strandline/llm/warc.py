"""WARC records in ZIP packages: write stored members with an index, read records back by ranges, without extraction."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import new_folder, park, table

# Fixed values of the ZIP format: signatures and the limits beyond which ZIP64 fields stand.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD_ID = "<urn:strandline:page:%s>"


# --- files, local or of any store that Arrow reaches -------------------------------------------------------------------------


def _store(path: str):
    """(filesystem or None for local files, path in it)."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def written(path: str):
    """A file that appears under its name only when whole, so a repeated or lost attempt leaves nothing half written."""
    store, at = _store(path)
    task = TaskContext.get()
    part = f"{at}.{task.taskAttemptId() if task else os.getpid()}.part"
    if store is None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(part, "wb") as f:
            yield f
        os.replace(part, at)
    else:
        store.create_dir(os.path.dirname(at), recursive=True)
        with store.open_output_stream(part) as f:
            yield f
        store.move(part, at)


def opened(path: str):
    store, at = _store(path)
    return open(at, "rb") if store is None else store.open_input_file(at)


def _range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends at {start + len(data)}, {start + length} expected")
    return data


# --- ZIP packages ------------------------------------------------------------------------------------------------------------


class StoredZip:
    """Writes stored members one after another to a stream that can't seek back: sizes follow in data descriptors."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # room for ZIP64 sizes makes the descriptor hold long ones
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Append to the open member; where in it the data begins."""
        before = self.open[2]
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])
        self._put(data)
        return before

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.open[3], self.open[2], self.open[2]))
        self.members.append(self.open)

    def close(self) -> None:
        start = self.at
        for raw, at, size, crc in self.members:
            long = self.zip64 or max(at, size) >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if long else b""
            s, a = (FULL32, FULL32) if long else (size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra)
        n, size = len(self.members), self.at - start
        if self.zip64 or n >= FULL16 or max(start, size) >= FULL32:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


def members(f) -> dict[str, tuple[int, int]]:
    """name: (offset of its data, size) of every member, from the central directory and ZIP64 fields; only stored members are allowed."""
    size = f.seek(0, 2)
    tail = _range(f, max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    base = max(0, size - 65_557) + at
    if n == FULL16 or FULL32 in (length, start):
        sign, _, end64, _ = struct.unpack("<IIQI", _range(f, base - 20, 20))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, *_, n, length, start = struct.unpack("<IQHHIIQQQQ", _range(f, end64, 56))
        if sign != END64:
            raise ValueError("no ZIP64 end of central directory")
    directory, found, at = _range(f, start, length), {}, 0
    for _ in range(n):
        sign, _, _, _, method, _, _, _, packed, plain, name, extra, note, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if sign != CENTRAL:
            raise ValueError("broken central directory")
        raw = directory[at + 46 : at + 46 + name].decode()
        fields, end = at + 46 + name, at + 46 + name + extra
        while fields + 4 <= end:
            kind, width = struct.unpack_from("<HH", directory, fields)
            if kind == 1:
                longs = iter(struct.unpack_from(f"<{width // 8}Q", directory, fields + 4))
                plain, packed, where = (next(longs) if x == FULL32 else x for x in (plain, packed, where))
            fields += 4 + width
        at = end + note
        if method:
            raise ValueError(f"{raw} is compressed; only stored members can be read by ranges")
        name, extra = struct.unpack("<HH", _range(f, where + 26, 4))
        found[raw] = (where + 30 + name + extra, packed)
    return found


# --- WARC records ------------------------------------------------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response or revisit record. A revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {RECORD_ID % page_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {RECORD_ID % refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parsed(data: bytes) -> dict:
    """Fields of a gzipped record; the payload of a response is checked against its digest."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length")).split(":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (payload_digest(payload), len(payload)) != (digest, size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: None if x in (None, RECORD_ID % None) else int(x.rpartition(":")[2].rstrip(">"))
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None}


# --- Spark -------------------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to ZIP packages in ``folder``, one a task; (path, records, bytes) of each.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id becomes a
    response and the others revisit it. Only (digest, largest id) of digests that repeat are joined to the
    pages, an outer join on the digest that adaptive execution splits where one digest is hot.

    Nulls: a null html is an empty payload, a null url leaves its field out, a null page_id is less than
    any other (it refers and is written as None). Of rows that repeat the largest id all are responses.
    An empty table writes no package. Other columns are left out.
    """
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    repeats = sized.select("sha1", "page_id", F.octet_length("html").alias("n")).where(F.col("n") >= least).groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies"))
    repeats = repeats.where("copies > 1 and largest is not null").select("sha1", "largest")
    planned = sized.join(repeats, "sha1", "left").select("page_id", "url", "html", "largest")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task = TaskContext.get()
        path, n = f"{folder}/part-{task.partitionId():06d}.zip", 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with written(path) as out:
            package, index = StoredZip(out), []
            package.begin(WARC_MEMBER)
            for batch in (b for part in ([first], batches) for b in part):
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "largest")), strict=True):
                    page_id, url, html, largest = (x.as_py() for x in row)
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = largest is not None and page_id != largest
                    digest = payload_digest(payload)
                    data = record(page_id, url, payload, len(payload), digest, largest, revisit)
                    at = package.write(data)
                    index.append(json.dumps({"id": page_id, "digest": digest, "offset": at, "length": len(data)}) + "\n")
                    n += 1
            package.end()
            package.begin(INDEX_MEMBER)
            for i in range(0, len(index), 10_000):
                package.write("".join(index[i : i + 10_000]).encode())
            package.end()
            package.close()
            size = package.at
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return planned.mapInArrow(write, "path string, records long, bytes long")


def read_archives(packages: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """The records of the packages at ``packages.path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    A first step reads each package's directories and index and cuts its records into ranges of about
    ``range_bytes``; the ranges are dealt over all tasks, and each is one read of the stored WARC member.
    Records without an id have a null page_id. No package: no rows.
    """

    def locate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    found = members(f)
                    base, _ = found[WARC_MEMBER]
                    entries = [json.loads(x) for x in _range(f, *found[INDEX_MEMBER]).splitlines()]
                starts, cuts = [], []
                for e in entries:
                    if not starts or e["offset"] + e["length"] - starts[0] > range_bytes:
                        if starts:
                            cuts.append(starts)
                        starts = [e["offset"]]
                    starts.append(e["offset"] + e["length"])
                if starts:
                    cuts.append(starts)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cuts)), pa.array([[base + s for s in c] for c in cuts], pa.list_(pa.int64()))], names=["path", "starts"])

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in kind.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, starts in zip(batch.column("path").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                with opened(path) as f:
                    data = _range(f, starts[0], starts[-1] - starts[0])
                rows = [parsed(data[a - starts[0] : b - starts[0]]) for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    ranges = packages.select("path").mapInArrow(locate, "path string, starts array<long>")
    # rows of offsets are so small that adaptive execution would join them into one task: the number of tasks follows the bytes to be read
    tasks = min(max(1, -(-(packages.agg(F.sum("bytes")).first()[0] or 0) // range_bytes)), 50_000)
    return ranges.repartition(tasks, "path", "starts").mapInArrow(fetch, kind)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = park(write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc")), "packages")
    return read_archives(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, n, hex, max(page_id) OVER (PARTITION BY html) AS largest, count(*) OVER (PARTITION BY html) AS copies,
    array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i + 1])] FOR i IN range(40)], '') AS bits
  FROM p),
d AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(bits[g * 5 + 1] AS INT) + 8 * CAST(bits[g * 5 + 2] AS INT) + 4 * CAST(bits[g * 5 + 3] AS INT) + 2 * CAST(bits[g * 5 + 4] AS INT) + CAST(bits[g * 5 + 5] AS INT), 1) FOR g IN range(32)], '') AS digest
  FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN copies > 1 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN copies > 1 AND page_id <> largest THEN largest END AS refers_to
FROM d
"""
