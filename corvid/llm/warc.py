"""WARC records in ZIP packages: written by executors to a shared folder, read back by ranges without extraction.

A package holds stored (not deflated) members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdx``, a line a record. The reader takes the end-of-directory records, ZIP64 ones included, finds the
members' places, reads the index, and then fetches each record's range alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def open_fs(uri: str):
    """(file system, path) of a URI that pyarrow knows: file, s3, gs, hdfs and the like; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit that keeps the HTTP head and names the response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{f'uuid:{uuid.uuid4()}' if page_id is None else f'page:{page_id}'}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record, and its payload as it is stored (none for a revisit)."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in top.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode("ascii", "replace").split("\r\n")[1:])
    number = lambda k: int(fields[k].strip("<>").removeprefix("urn:page:")) if fields.get(k, "").startswith("<urn:page:") else None
    return {"type": fields["WARC-Type"], "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To"), "size": int(http["Content-Length"]), "payload": payload}


class ZipWriter:
    """Stored members one after the other; ZIP64 fields wherever a size or place needs them, or always if ``zip64``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks) -> None:
        """Writes a member of unknown size: sizes follow it in a data descriptor, eight bytes each."""
        begin, crc, size, raw = self.at, 0, 0, name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
            self._put(chunk)
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))
        self.members.append((raw, begin, crc, size))

    def close(self) -> None:
        start = self.at
        for raw, begin, crc, size in self.members:
            large = self.zip64 or size >= 0xFFFFFFFF or begin >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, begin) if large else b""
            small = (0xFFFFFFFF,) * 3 if large else (size, size, begin)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, small[0], small[1], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or start >= 0xFFFFFFFF or size >= 0xFFFFFFFF or n >= 0xFFFF:
            at = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, at, 1))
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


def directory(read, length: int) -> dict[str, tuple[int, int]]:
    """Place and size of each stored member's bytes. ``read(at, n)`` fetches a range of a package of ``length`` bytes."""
    tail_at = max(0, length - 22 - 0xFFFF)
    tail = read(tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == n or 0xFFFFFFFF in (size, start):
        where = tail_at + end - 20
        locator = read(where, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack("<Q", locator[8:16])
        n, _, size, start = struct.unpack("<QQQQ", read(at, 56)[24:56])
    raw, out, p = read(start, size), {}, 0
    for _ in range(n):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags_method = struct.unpack("<HH", raw[p + 8 : p + 12])
        packed, whole, name_n, extra_n, comment_n = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
        (begin,) = struct.unpack("<I", raw[p + 42 : p + 46])
        name = raw[p + 46 : p + 46 + name_n].decode()
        extra, q = raw[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            tag, m = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                wide, r = extra[q + 4 : q + 4 + m], 0
                if whole == 0xFFFFFFFF:
                    (whole,), r = struct.unpack("<Q", wide[r : r + 8]), r + 8
                if packed == 0xFFFFFFFF:
                    (packed,), r = struct.unpack("<Q", wide[r : r + 8]), r + 8
                if begin == 0xFFFFFFFF:
                    (begin,) = struct.unpack("<Q", wide[r : r + 8])
            q += 4 + m
        if flags_method[1] == 0 and not flags_method[0] & 1:
            name_here, extra_here = struct.unpack("<HH", read(begin + 26, 4))
            out[name] = (begin + 30 + name_here + extra_here, packed)
        p += 46 + name_n + extra_n + comment_n
    return out


def with_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of ``min_bytes`` or more the row of the smallest
    page_id is the response; of rows that repeat that id, all are responses. Other rows with that payload revisit it, also
    those without page_id; rows of a payload that no row with page_id has are all responses.

    Only payloads that occur more than once are looked up, in a written table, so that Spark can split a very common one."""

    def digests(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            payloads = [(h or "").encode("utf-8", "replace") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payloads, pa.binary()), pa.array([sha1_base32(p) for p in payloads], pa.string())], names=["page_id", "url", "payload", "digest"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(digests, "page_id long, url string, payload binary, digest string")
    sizes = rows.select("page_id", "digest", F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    first = materialize(sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "first")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, zip64: bool = False, records_per_package: int = 1 << 16) -> DataFrame:
    """Writes packages under ``folder``; (package, n_records). A row without page_id gets a record id of its own.

    A name is used once, so a repeated task writes another file and only the manifest's are read. The manifest is a
    written table.
    """
    typed = with_types(pages, min_bytes)

    def run(batches) -> Iterator:
        import pyarrow as pa

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done = []
        row = next(rows, None)
        fs, base = open_fs(folder)
        while row is not None:
            name = f"{uuid.uuid4().hex}.zip"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as out:
                index, state = [], {"row": row, "at": 0, "n": 0}

                def records(index=index, state=state):
                    while state["row"] is not None and state["n"] < records_per_package:
                        page_id, url, payload, digest, refers = state["row"]
                        data = gzip.compress(record(page_id, url, payload, digest, refers), 4, mtime=0)
                        index.append(f"{page_id} {state['at']} {len(data)}\n")
                        state["at"] += len(data)
                        state["n"] += 1
                        yield data
                        state["row"] = next(rows, None)

                z = ZipWriter(out, zip64)
                z.member(DATA, records())
                z.member(INDEX, (line.encode() for line in index))
                z.close()
            done.append((name, state["n"]))
            row = state["row"]
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["package", "n_records"])

    return materialize(typed.mapInArrow(run, "package string, n_records long"), "packages")


def ranges(packages: DataFrame, folder: str, records_per_range: int = 512) -> DataFrame:
    """(package, at, lengths): ranges of whole neighbouring records, from each package's directory and index."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        fs, base = open_fs(folder)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for name in batch.column("package").to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    places = directory(lambda at, n, f=f: f.read_at(n, at), f.size())
                    (data, _), (index, size) = places[DATA], places[INDEX]
                    lines = f.read_at(size, index).decode().splitlines()
                for i in range(0, len(lines), records_per_range):
                    part = [tuple(map(int, x.split(" ")[1:])) for x in lines[i : i + records_per_range]]
                    out[0].append(name)
                    out[1].append(data + part[0][0])
                    out[2].append([n for _, n in part])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["package", "at", "lengths"])

    return packages.mapInArrow(run, "package string, at long, lengths array<long>")


def read(packages: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the packages, fetched by range. ``digest_ok``: a response's stored payload has the stated digest and
    length. With ``payloads``, a last column has a response's payload."""
    schema = READ + (", payload binary" if payloads else "")

    def run(batches) -> Iterator:
        import pyarrow as pa

        fs, base = open_fs(folder)
        for batch in batches:
            for name, at, lengths in zip(*(batch.column(c).to_pylist() for c in ("package", "at", "lengths")), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    raw, p = memoryview(f.read_at(sum(lengths), at)), 0
                rows = []
                for n in lengths:
                    r, p = parse(gzip.decompress(raw[p : p + n])), p + n
                    ok = r["type"] == "revisit" or (len(r["payload"]) == r["size"] and sha1_base32(r["payload"]) == r["digest"])
                    rows.append((r["page_id"], r["url"], r["size"], r["digest"], r["type"], r["refers_to"], ok, r["payload"] if r["type"] == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())[: 7 + payloads]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=[s.split()[0] for s in schema.split(", ")])

    where = ranges(packages, folder)
    n = max(1, packages.sparkSession.sparkContext.defaultParallelism * 2)
    return where.repartition(n, "package", "at").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to packages in the shared folder, then reads them back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder)
