"""WARC records in ZIP packages, and their reader.

A package is a ZIP file whose members are stored, not compressed: archives
(``archive/*.warc.gz``, a gzip member a record) and indexes
(``indexes/*.cdxj``, a line a record with its offset and length). The reader
parses the central directory from the file's tail, ZIP64 records included,
finds the data of the stored members through their local headers, and reads
each record by its byte range, without extraction; an archive without an index
is read record by record. Nothing but the directory, one index and one record
is held at a time.

A payload written before is not written again: of the records with equal
payloads, the one with the largest id is the response and the others revisit
it. Null payloads are empty. Rows repeated with the same id have the same
type; a null id comes after all others. An empty table gives no package.

Packages go to the shared checkpoint folder, each under a name of its own; only
those that a finished task has reported are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, named

#: A package is closed when its archive has this many bytes.
PACKAGE_BYTES = 32 << 20
#: Packages are read in this many tasks at most; a task then reads several.
MAX_TASKS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
RECORD_NAMES = [f.split()[0] for f in RECORDS.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path)


# ---- writing

def record(doc_id, url, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. Fields beyond the standard's carry the row's id."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(doc_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
        if refers_to is not None:
            fields.append(("Row-Refers-To", refers_to))
    if doc_id is not None:
        fields.append(("Row-Id", doc_id))
    fields += [("Row-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False) -> None:
    """A ZIP file of stored members; ZIP64 records where sizes need them or ``zip64`` asks for them."""
    directory, at = [], 0
    big = 0xFFFFFFFF
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= big or at >= big
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        size = big if wide else n
        head = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size,
                           len(raw), len(extra)) + raw + extra
        out.write(head)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 0, 0, 0x21,
                                     crc, size, size, len(raw), len(extra), 0, 0, 0, 0, big if wide else at)
                         + raw + extra)
        at += len(head) + n
    listing = b"".join(directory)
    out.write(listing)
    count = len(members)
    if zip64 or at >= big or count >= 0xFFFF:
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(listing), at))
        out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(listing), 1))
        out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, big, big, 0))
    else:
        out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, count, count, len(listing), at, 0))


def write_packages(df: DataFrame, stages: Stages, min_revisit_bytes: int = 0, date: str = "2026-01-01T00:00:00Z",
                   package_bytes: int = PACKAGE_BYTES, zip64: bool = False, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row; returns ``(path, records)`` of the packages."""
    rows = df.select(named(id_col).cast("long").alias("id"), named(url_col).cast("string").alias("url"),
                     F.coalesce(named(payload_col).cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("sha", F.sha1("payload"))
    small = F.octet_length("payload") < min_revisit_bytes
    # one row a payload; the hot payload is summed up before the shuffle and its rows are split in the join
    last = rows.groupBy("sha").agg(F.max("id").alias("last"))
    typed = rows.join(last, "sha").select(
        "id", "url", "payload", F.when(~small, F.col("last")).alias("refers_to"),
        (~small & ~F.col("id").eqNullSafe(F.col("last"))).alias("revisit"))
    folder = stages.path("packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)

        def close(body: io.BytesIO, lines: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            about = {"resources": [{"path": "archive/data.warc.gz"}, {"path": "indexes/index.cdxj"}]}
            with fs.open_output_stream(f"{root}/{name}") as out:
                write_zip(out, [("datapackage.json", json.dumps(about).encode()),
                                ("archive/data.warc.gz", body.getvalue()),
                                ("indexes/index.cdxj", b"".join(lines))], zip64)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(lines)]})

        body, lines = io.BytesIO(), []
        for batch in batches:
            for doc, url, payload, refers, revisit in zip(*batch.columns):
                data = record(doc.as_py(), url.as_py(), payload.as_py(), refers.as_py(), revisit.as_py(), date)
                at = body.tell()
                where = {"filename": "data.warc.gz", "offset": str(at), "length": str(len(data))}
                lines.append(f"{doc.as_py()} {json.dumps(where)}\n".encode())
                body.write(data)
                if body.tell() >= package_bytes:
                    yield close(body, lines)
                    body, lines = io.BytesIO(), []
        if lines:
            yield close(body, lines)

    return stages.table(typed.mapInArrow(run, "path string, records long"), "manifest")


# ---- reading

class Package:
    """The stored members of a ZIP file, by range reads."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError("the package ends early")
        return data

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Local header offset and length of each stored member."""
        tail = min(self.size, 22 + 0xFFFF)
        end = self.read(self.size - tail, tail)
        at = end.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", end, at + 20)[0] != len(end):
            at = end.rfind(b"PK\x05\x06", 0, at)          # the mark may also stand in the comment
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, count, length, start = struct.unpack_from("<HHHII", end, at + 6)[0:5]
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self.size - tail + at - 20
            mark, _, record_at, _ = struct.unpack("<4sIQI", self.read(locator, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", self.read(record_at, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
        listing, members, p = self.read(start, length), {}, 0
        for _ in range(count):
            (mark, _, _, flags, method, _, _, _, packed, n, names, extras, comments, _, _, _,
             offset) = struct.unpack_from("<4sHHHHHHIIIHHHHHII", listing, p)
            if mark != b"PK\x01\x02":
                raise ValueError("broken central directory")
            name = listing[p + 46:p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = listing[p + 46 + names:p + 46 + names + extras]
            while len(extra) >= 4:                        # ZIP64 extra: only the fields that are full, in this order
                tag, width = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    n = wide.pop(0) if n == 0xFFFFFFFF else n
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + width:]
            if method == 0 and not flags & 1:             # stored, not encrypted
                members[name] = (offset, n)
            elif name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
                raise ValueError(f"{name} is not stored")
            p += 46 + names + extras + comments
        return members

    def data(self, name: str) -> tuple[int, int]:
        """Offset and length of a member's data, which its local header leads to."""
        offset, n = self.members[name]
        mark, *_, names, extras = struct.unpack("<4sHHHHHIIIHH", self.read(offset, 30))
        if mark != b"PK\x03\x04":
            raise ValueError("broken local header")
        return offset + 30 + names + extras, n

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Offset and length in the package of every record, from the indexes, or by
        walking through an archive that no index lists."""
        starts: dict[str, int] = {}                       # of the archives that an index lists
        for name in sorted(m for m in self.members if m.startswith("indexes/") and m.endswith((".cdxj", ".cdx"))):
            at, n = self.data(name)
            for line in self.read(at, n).splitlines():
                where = json.loads(line[line.index(b"{"):])
                member = f"archive/{where['filename']}"
                if member not in starts:
                    starts[member] = self.data(member)[0]
                yield starts[member] + int(where["offset"]), int(where["length"])
        for name in sorted(m for m in self.members if m.startswith("archive/") and m.endswith(".warc.gz")):
            if name not in starts:
                at, n = self.data(name)
                yield from self.walk(at, at + n)

    def walk(self, at: int, end: int, step: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """The gzip members between two offsets."""
        while at < end:
            unpack, here = zlib.decompressobj(31), at
            while not unpack.eof:
                chunk = self.read(here, min(step, end - here))
                if not chunk:
                    raise ValueError("a record ends early")
                unpack.decompress(chunk)
                here += len(chunk)
            here -= len(unpack.unused_data)
            yield at, here - at
            at = here


def parse(raw: bytes) -> dict:
    """Fields of a record and its payload."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    return fields | {"payload": payload}


def read_packages(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """Every record of the packages in ``path_col``: id, payload_bytes, payload_digest
    (checked against the payload of responses), record_type, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                package, rows, held = Package(path), [], 0
                for at, n in package.ranges():
                    r = parse(package.read(at, n))
                    told = r["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r["WARC-Type"] == "response" and digest(r["payload"]) != told:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    whole = r.get("Row-Payload-Length", len(r["payload"]))
                    rows.append((int(r["Row-Id"]) if "Row-Id" in r else None, int(whole), told, r["WARC-Type"],
                                 int(r["Row-Refers-To"]) if "Row-Refers-To" in r else None, r["payload"]))
                    held += len(r["payload"])
                    if held >= 8 << 20 or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # as many tasks as packages (to a point): the paths are too few bytes to tell how much there is to read
    tasks = max(1, min(packages.count(), MAX_TASKS))
    return packages.select(path_col).repartition(tasks, path_col).mapInArrow(run, RECORDS)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD_TYPES)], names=RECORD_NAMES)


def archive_round_trip(df: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", **columns) -> DataFrame:
    """Write the rows as packages and read the packages back."""
    stages = Stages(df.sparkSession, "warc")
    packages = write_packages(df, stages, min_revisit_bytes, id_col=id_col, **columns)
    return read_packages(packages).withColumnRenamed("id", id_col)
