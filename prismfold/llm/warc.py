"""WARC archives with a two-level capture index.

Writing: records go into archive files, one gzip member per record, in the shared folder. Of captures with equal
payloads of at least `min_bytes`, the one with the smallest id is a response record; the others are revisit
records that name it and keep its HTTP headers. Each task writes under a name of its own and renames the file
when it is whole, so a task that runs again leaves one archive.

Index: captures are sorted by reversed-host URL key and written as compressed blocks of lines. Beside each index
file lies its sparse directory: an entry per block (first key, first page, byte range, lines), then the entries'
places and their number, so that an entry is read by range. A lookup binary-searches the files by their first
entries and then the entries of one file, all by range reads, reads the blocks that hold the key one at a time,
binary-searches their lines and reads each record by range. A revisit's line holds the archive and range of the
response that it names, so that its payload takes one more range read, however often a URL was captured. A full
read goes over all blocks in parallel, deals their captures to the archives and reads each archive's ranges in order.

Null html: an empty payload. Null url: an empty key, sorted first. Null ids order before others. Repeated rows
are captures of their own; among equal ids the smallest URL is the response, and whole repeats are responses alike.
A URL that was not captured: no rows. Empty tables: an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, binaries, filesystem, id_key, materialise, new_path, shuffle_partitions

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
#: Neighbouring ranges at most so far apart are read at once.
READ_GAP, READ_BYTES = 64 << 10, 8 << 20
_EPOCH = "1970-01-01T00:00:00Z"


def _uri(path: str) -> str:
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:/") else path


def url_key(url: str) -> str:
    """Sort key: host labels reversed, then port, path and query; scheme, fragment and user are left out."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower().rstrip("."), u.port
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def record(kind: str, page: int, url: str, payload: bytes, digest: str, size: int, refers: int | None, refers_url: str | None) -> bytes:
    """The bytes of one WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{page}>", f"WARC-Date: {_EPOCH}",
        f"WARC-Target-URI: {_header(url)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{refers}>", f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _header(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def plan(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The pages with size, digest, and for a revisit the capture it refers to."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(id_key("page_id").alias("k"), F.coalesce("url", F.lit("")).alias("url"), "html", F.sha2(html, 256).alias("digest"), F.length(html).cast("long").alias("size"))
    facts = base.select("k", "url", "digest", "size").where(F.col("size") >= min_bytes)
    first = facts.groupBy("digest").agg(F.min(F.struct("k", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = facts.join(first, "digest").where(F.struct("k", "url") > F.col("first")).select("k", "url", "digest", F.col("first.k").alias("refers"), F.col("first.url").alias("refers_url")).distinct()
    joined = base.join(repeats, ["k", "url", "digest"], "left")
    # A revisit keeps no payload; dropping it here keeps it out of the writers.
    return joined.withColumn("html", F.when(F.col("refers").isNull(), F.col("html")))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records; (url_key, page, url, kind, digest, archive, offset, length) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part, n = TaskContext.get().partitionId(), 0
        out, name, at, entries = None, "", 0, []
        temporary = ""

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal out, entries
            if out is not None:
                out.close()
                fs.move(temporary, f"{root}/{name}")
                out = None
            if entries:
                cols = list(zip(*entries, strict=True))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["url_key", "page", "url", "kind", "digest", "archive", "offset", "length"])
                entries = []

        for b in batches:
            get = {c: b.column(i).to_pylist() for i, c in enumerate(b.schema.names) if c != "html"}
            for i, payload in enumerate(binaries(b.column(b.schema.get_field_index("html")))):
                if out is None:
                    name, at = f"part-{part:05d}-{n:04d}.warc.gz", 0
                    temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
                    out, n = fs.open_output_stream(temporary), n + 1
                page, url, refers = get["k"][i], get["url"][i], get["refers"][i]
                kind = "response" if refers is None else "revisit"
                deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = deflate.compress(record(kind, page, url, payload, get["digest"][i], get["size"][i], refers, get["refers_url"][i])) + deflate.flush()
                out.write(member)
                entries.append((url_key(url), page, url, kind, get["digest"][i], name, at, len(member)))
                at += len(member)
                if at >= archive_bytes:
                    yield from finish()
        yield from finish()

    return planned.select("k", "url", "html", "size", "digest", "refers", "refers_url").mapInArrow(run, "url_key string, page long, url string, kind string, digest string, archive string, offset long, length long")


def targets(captures: DataFrame) -> DataFrame:
    """The captures, revisits with the archive and range of a response of their payload."""
    kept = captures.where("kind = 'response'").groupBy("digest").agg(F.min(F.struct("archive", "offset", "length")).alias("to"))
    again = captures.where("kind = 'revisit'")
    # One row for each digest meets its revisits: Spark may split a frequent digest.
    found = again.join(kept.join(again.select("digest").distinct(), "digest"), "digest").select(*captures.columns, "to")
    return captures.where("kind = 'response'").withColumn("to", F.lit(None).cast("struct<archive:string,offset:bigint,length:bigint>")).unionByName(found)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures, write compressed blocks and directories; the blocks: (first_key, first_page, file, offset, length, lines, bytes)."""
    parts = max(1, shuffle_partitions(captures.sparkSession) // 4)
    ordered = captures.repartitionByRange(parts, "url_key", "page").sortWithinPartitions("url_key", "page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, temporary = f"index-{TaskContext.get().partitionId():08d}.gz", f"{root}/.{uuid.uuid4().hex}.tmp"
        out, at, rows, lines = None, 0, [], []

        def block() -> None:
            nonlocal at, lines
            data = gzip.compress("".join(x[2] for x in lines).encode(), 6, mtime=0)
            out.write(data)
            rows.append((lines[0][0], lines[0][1], name, at, len(data), len(lines), sum(x[3] for x in lines)))
            at, lines = at + len(data), []

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out = fs.open_output_stream(temporary)
                to = [r["to"][c] for c in ("archive", "offset", "length")] if r["to"] else None
                line = json.dumps([*(r[c] for c in ("url_key", "page", "url", "kind", "digest", "archive", "offset", "length")), to], ensure_ascii=False) + "\n"
                lines.append((r["url_key"], r["page"], line, r["length"]))
                if len(lines) == block_lines:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
            fs.move(temporary, f"{root}/{name}")
            entries = [json.dumps([k, page, offset, length, n], ensure_ascii=False).encode() for k, page, _, offset, length, n, _ in rows]
            places = list(itertools.accumulate(map(len, entries), initial=0))
            with fs.open_output_stream(temporary) as f:
                f.write(b"".join(entries) + struct.pack(f"<{len(places) + 1}q", *places, len(entries)))
            fs.move(temporary, f"{root}/{name.removesuffix('.gz')}.dir")
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["first_key", "first_page", "file", "offset", "length", "lines", "bytes"])

    return ordered.select("url_key", "page", "url", "kind", "digest", "archive", "offset", "length", "to").mapInArrow(run, "first_key string, first_page long, file string, offset long, length long, lines long, bytes long")


class Directory:
    """The sparse directory of an index file, read entry by entry."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path = fs, path
        self.end = fs.get_file_info(path).size - 8
        (self.count,) = struct.unpack("<q", read_range(fs, path, self.end, 8))
        self.known: dict[int, list] = {}

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> list:
        """First key, first page, offset, length and lines of a block."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        if i not in self.known:
            a, b = struct.unpack("<2q", read_range(self.fs, self.path, self.end - 8 * (self.count + 1 - i), 16))
            self.known[i] = json.loads(read_range(self.fs, self.path, a, b - a))
        return self.known[i]


def read_range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_block(fs: pafs.FileSystem, path: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in gzip.decompress(read_range(fs, path, offset, length)).decode().split("\n")[:-1]]


class CaptureIndex:
    """The archives of a folder, looked up by URL or read whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, _uri(folder)
        self.directory = spark.read.parquet(f"{folder}/directory")

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        spark = pages.sparkSession
        folder = folder or new_path(spark, "warc")
        fs, root = filesystem(_uri(folder))
        fs.create_dir(root, recursive=True)
        captures = materialise(write_archives(plan(pages, min_bytes), _uri(folder), archive_bytes), "captures")
        write_index(targets(captures), _uri(folder), block_lines).write.mode("overwrite").parquet(f"{folder}/directory")
        return cls(spark, folder)

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of the blocks that may hold a key, in order."""
        fs, root = filesystem(self.folder)
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("index-") and x.extension == "dir")
        # The block before the first that starts at or after the key may hold it as well.
        f = bisect.bisect_left(files, key, key=lambda path: Directory(fs, path)[0][0])
        for path in files[max(0, f - 1) :]:
            entries = Directory(fs, path)
            for i in range(max(0, bisect.bisect_left(entries, key, key=lambda e: e[0]) - 1), len(entries)):
                first, _, offset, length, _ = entries[i]
                if first > key:
                    return
                yield f"{path.removesuffix('.dir')}.gz", offset, length

    def lookup(self, url: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and payload of each capture of a URL, one at a time; a revisit's payload is that of the record it names."""
        key = url_key(url)
        fs, root = filesystem(self.folder)
        whole = lambda archive, offset, length: parse(gzip.decompress(read_range(fs, f"{root}/{archive}", offset, length)))
        for file, offset, length in self.blocks(key):
            lines = read_block(fs, file, offset, length)
            for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
                if line[0] != key:
                    break
                fields, _, payload = whole(*line[5:8])
                yield fields, whole(*line[8])[2] if line[8] else payload

    def entries(self) -> DataFrame:
        """All captures, from the index blocks."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = filesystem(folder)
            for b in batches:
                for r in b.to_pylist():
                    cols = list(zip(*read_block(fs, f"{root}/{r['file']}", r["offset"], r["length"]), strict=True))[:8]
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["url_key", "page", "url", "kind", "digest", "archive", "offset", "length"])

        many = self.directory.repartition(shuffle_partitions(self.spark), "file", "offset")
        return many.mapInArrow(run, "url_key string, page long, url string, kind string, digest string, archive string, offset long, length long")

    def read(self) -> DataFrame:
        """Every record, read back from the archives: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

        A response's size and digest are those of the payload that was read; a revisit's come from its headers.
        """
        folder = self.folder
        stripe = F.floor(F.col("offset") / READ_BYTES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = filesystem(folder)
            for b in batches:
                names, offsets, lengths = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
                i, rows, held = 0, [], 0
                while i < len(names):
                    j, end = i, offsets[i] + lengths[i]
                    while j + 1 < len(names) and names[j + 1] == names[i] and 0 <= offsets[j + 1] - end <= READ_GAP and offsets[j + 1] + lengths[j + 1] - offsets[i] <= READ_BYTES:
                        j += 1
                        end = offsets[j] + lengths[j]
                    data = read_range(fs, f"{root}/{names[i]}", offsets[i], end - offsets[i])
                    for k in range(i, j + 1):
                        a = offsets[k] - offsets[i]
                        fields, http, payload = parse(zlib.decompress(data[a : a + lengths[k]], 31))
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        page = int(fields["WARC-Record-ID"][len("<urn:capture:") : -1])
                        if kind == "response":
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"capture {page}: the payload differs from its digest")
                            rows.append((page, fields["WARC-Target-URI"], kind, None, len(payload), digest, payload))
                        else:
                            rows.append((page, fields["WARC-Target-URI"], kind, int(fields["WARC-Refers-To"][len("<urn:capture:") : -1]), int(http["Content-Length"]), digest, None))
                        held += len(payload)
                    i = j + 1
                    if held > READ_BYTES or i == len(names):
                        cols = list(zip(*rows, strict=True))
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                        rows, held = [], 0

        # So many tasks that each reads about four stripes of archives.
        size = self.directory.agg(F.sum("bytes")).first()[0] or 0
        parts = max(shuffle_partitions(self.spark), -(-size // (4 * READ_BYTES)))
        dealt = self.entries().select("archive", "offset", "length").withColumn("stripe", stripe).repartition(parts, "archive", "stripe").sortWithinPartitions("archive", "offset")
        out = dealt.select("archive", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
        back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
        return out.select(back("page_id"), "url", "record_type", back("refers_to"), "payload_bytes", "payload_digest", "payload")
