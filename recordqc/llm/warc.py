"""WARC archives: written as monolithic gzip, normalised to one member a record with a sidecar offset index.

``write`` streams pages into archives of bounded size, each one gzip stream. ``normalise`` inflates every archive once,
writes each record as a gzip member of its own and an index line with its place. ``read`` goes by the index and inflates
single members. Files lie in the shared folder; tasks write under an attempt's own name and move the finished file, so
a task that runs again replaces equal bytes.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is a response, the others are
revisits of it without payload; their HTTP header states the full length. Rows repeated with that same id are responses
each. A null id is smaller than any other; null payloads are empty; a null address is left out. An empty table
gives no archives and no records. Extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordqc.llm.common import fresh_path, stored

CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


class _Placed:
    """A file that appears under its name when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def close(self):
        self.out.close()
        self.fs.move(self.own, self.path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(pairs) -> bytes:
    clean = lambda v: "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(v))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in pairs if v is not None) + b"\r\n"


def record(page_id, url, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    return _header([("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url),
                    ("WARC-Refers-To", name(refers_to) if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
                    ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response"),
                    ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``page_id, url, html`` and returns the stored list of archives: ``archive, records``."""
    import pyarrow as pa
    from pyspark import TaskContext

    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    copies = stored(rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("__n"))
                    .where("__n > 1").select("digest", "refers_to"), "warc-copies")
    rows = rows.join(copies, "digest", "left").select("page_id", "url", "html", "refers_to")

    def made(batches):
        part, number, count, placed, deflate = TaskContext.get().partitionId(), 0, 0, None, None
        done = []

        def close():
            placed.write(deflate.flush())
            placed.close()
            done.append((f"{folder}/part-{part:06d}-{number:06d}.warc.gz", count))

        for b in batches:
            for page_id, url, html, refers_to in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if placed is None:
                    placed = _Placed(f"{folder}/part-{part:06d}-{number:06d}.warc.gz")
                    deflate, count = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                revisit = refers_to is not None and refers_to != page_id
                placed.write(deflate.compress(record(page_id, url, html.encode(), refers_to, revisit, date)))
                count += 1
                if placed.size >= archive_bytes:
                    close()
                    placed, number = None, number + 1
        if placed:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], names=["archive", "records"])

    return stored(rows.mapInArrow(made, "archive string, records long"), "warc-list")


def _inflated(stream):
    """Chunks of a gzip file, read once; further members are part of it."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if got := inflate.decompress(data):
                yield got
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    if got := inflate.flush():
        yield got


def parse_header(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if x)


def records(chunks):
    """(header fields, whole record) of a WARC stream; a stream that ends inside a record is an error."""
    buffer = bytearray()
    chunks = iter(chunks)

    def fill(test):
        while not test():
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while fill(lambda: len(buffer) > 0):
        if not fill(lambda: b"\r\n\r\n" in buffer):
            raise ValueError("the archive ends inside a header")
        end = buffer.index(b"\r\n\r\n") + 4
        fields = parse_header(bytes(buffer[:end]))
        whole = end + int(fields["Content-Length"]) + 4
        if not fill(lambda: len(buffer) >= whole):
            raise ValueError("the archive ends inside a record")
        yield fields, bytes(buffer[:whole])
        del buffer[:whole]


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites listed archives; returns the stored list ``archive, normal, index, records``."""
    import pyarrow as pa

    def made(batches):
        for b in batches:
            for archive in b.column(0).to_pylist():
                source, path = _fs(archive)
                normal = archive.removesuffix(".warc.gz") + ".members.warc.gz"
                members, index, n = _Placed(normal), _Placed(normal + ".idx"), 0
                with source.open_input_stream(path, compression=None) as stream:
                    for fields, whole in records(_inflated(stream)):
                        at = members.size
                        members.write(gzip.compress(whole, 6, mtime=0))
                        line = {"offset": at, "length": members.size - at, "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        n += 1
                members.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([normal]), pa.array([normal + ".idx"]), pa.array([n])], names=["archive", "normal", "index", "records"])

    n = max(1, archives.count())  # one row an archive: a task each
    return stored(archives.select("archive").repartition(n).mapInArrow(made, "archive string, normal string, index string, records long"), "warc-normal")


def read(normal: DataFrame) -> DataFrame:
    """Records by the index: ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``; the payload of a revisit is null."""
    import pyarrow as pa

    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[10:-1])

    def rows_of(path, index):
        files, place = _fs(index)
        with files.open_input_stream(place, compression=None) as f:
            lines = f.read().splitlines()
        files, place = _fs(path)
        with files.open_input_file(place) as f:
            for line in map(json.loads, lines):
                f.seek(line["offset"])
                fields, whole = next(records([gzip.decompress(f.read(line["length"]))]))
                block = whole[whole.index(b"\r\n\r\n") + 4:-4]
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(parse_header(head)["Content-Length"])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']} in {path}")
                revisit = fields["WARC-Type"] == "revisit"
                yield number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), None if revisit else payload

    def made(batches):
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block, held = [], 0
                for row in rows_of(path, index):
                    block.append(row)
                    held += row[1]
                    if held > 8 * CHUNK or len(block) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*block), kind)], schema=kind)
                        block, held = [], 0
                if block:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*block), kind)], schema=kind)

    n = max(1, normal.count())
    return normal.select("normal", "index").repartition(n).mapInArrow(
        made, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
