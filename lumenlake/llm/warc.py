"""WARC archives with a two-level capture index.

Writing: one record per page, each a gzip member of its own; equal payloads of at least REVISIT_FROM bytes are stored
once, with the smallest page_id, and the others become revisit records that refer to it.  Every task writes its own
archive into the shared folder under a name never used before, and hands on where its records lie; a rerun task writes
another archive, and only records that were handed on are ever read.

Index: captures are range-partitioned and sorted by reversed-host URL key and page_id; a shard's lines are compressed
in blocks of BLOCK lines, and a sparse directory keeps each block's first key and place.  Lookup: the shards' first
keys (as many as there are shuffle partitions) are binary-searched to route a key, then the shard's directory to find
its block, then the block's lines; the records found are read by ranges, in the order of the archives.

Defined cases: null html is an empty payload, a null URL an empty key; a null page_id is kept, never the one that is
referred to unless all are null, in which case there are only responses; rows with the smallest page_id of a payload
are all responses; repeated rows are repeated records; other columns play no part; an empty table gives no archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.lineage import durable, shared_dir
from lumenlake.llm.common import frugal

#: Payloads below this many bytes are always stored.
REVISIT_FROM = 100
#: Lines of an index block, bytes after which a task opens a new archive, bytes that are read at once.
BLOCK, ARCHIVE_BYTES, READ_BYTES = 1024, 512 << 20, 4 << 20

_NAMESPACE = uuid.UUID("6f1dd2a2-6c0f-4d5e-9a51-0f4f6f4f2c11")
_LOWEST = -(1 << 63)


def url_key(url: Column) -> Column:
    """The sort key of a URL: its host's labels in reverse, then what follows the host.

    Line and field ends are escaped here, as in the archives, so that keys are sorted, stored and searched alike.
    """
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    for c in "\t\r\n":
        key = F.replace(key, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return key


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC record as a gzip member; a revisit if `first` is given."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload
    if first is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(first, digest)), ("X-Refers-To-Page", str(first))]
        body = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 4, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one record; raises if length, end or digest are wrong."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"wrong payload in {fields['WARC-Record-ID']}")
    return fields, payload


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives below folder; returns the captures: key, page_id, file, start, length."""
    rows = _payloads(pages)
    long = rows.where(F.octet_length("payload") >= REVISIT_FROM).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # Page by page, so that a payload of very many pages is spread like any other.
    later = long.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct().select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    marked = rows.join(later, rows["page_id"].eqNullSafe(later["p"]) & (rows["digest"] == later["d"]), "left")

    @frugal
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        out, name, size = None, "", 0
        try:
            for part in parts:
                keys, ids, urls, payloads, digests, firsts = (part.column(k) for k in range(6))
                files, starts, lengths = [], [], []
                for page_id, url, payload, digest, first_id in zip(ids.to_pylist(), urls.to_pylist(), payloads, digests.to_pylist(), firsts.to_pylist(), strict=True):
                    raw = record(page_id, url, payload.as_py(), digest, first_id)
                    if out is None or size >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(raw)
                    files.append(name)
                    starts.append(size)
                    lengths.append(len(raw))
                    size += len(raw)
                yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), ids, pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["key", "page_id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    written = marked.select(url_key(F.col("url")).alias("key"), "page_id", "url", "payload", "digest", "first").mapInArrow(write, "key string, page_id long, file string, start long, length long")
    return durable(written)  # written once: a second reader must not write the archives again


def _sortable(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.encode(), _LOWEST if page_id is None else page_id


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the index shards below folder; returns the directory: shard, key, page_id, start, length of each block."""
    keyed = captures.withColumn("page", F.coalesce("page_id", F.lit(_LOWEST)))
    ordered = keyed.repartitionByRange("key", "page", "file", "start").sortWithinPartitions("key", "page", "file", "start").select("key", "page", "file", "start", "length")

    @frugal
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        shard, at, lines, blocks = f"captures-{uuid.uuid4().hex}.cdx.gz", 0, [], []
        with fs.open_output_stream(f"{top}/{shard}", compression=None) as out:
            def flush() -> None:
                nonlocal at
                raw = gzip.compress("".join(f"{k}\t{p}\t{f}\t{s}\t{n}\n" for k, p, f, s, n in lines).encode(), 4, mtime=0)
                out.write(raw)
                blocks.append((shard, lines[0][0], lines[0][1], at, len(raw)))
                at += len(raw)
                lines.clear()

            for part in parts:
                for k, p, f, s, n in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    lines.append((k, p, f, s, n))
                    if len(lines) == BLOCK:
                        flush()
            if lines:
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "key", "page", "start", "length"])

    return durable(ordered.mapInArrow(write, "shard string, key string, page long, start long, length long"))


class Shard:
    """A shard of the index: its directory and the block read last."""

    def __init__(self, fs: pafs.FileSystem, path: str, directory: list[tuple[str, int, int, int]]):
        self.file = fs.open_input_file(path)
        self.directory = sorted(directory, key=lambda b: _sortable(b[0], b[1]))
        self.firsts = [_sortable(b[0], b[1]) for b in self.directory]
        self.block, self.lines, self.keys = -1, [], []

    def close(self) -> None:
        self.file.close()

    def _open(self, block: int) -> None:
        if block != self.block:
            _, _, start, length = self.directory[block]
            self.file.seek(start)
            text = zlib.decompress(self.file.read(length), 31).decode()
            self.lines = [line.split("\t") for line in text.split("\n")[:-1]]
            self.keys = [_sortable(line[0], int(line[1])) for line in self.lines]
            self.block = block

    def find(self, key: str, page: int) -> Iterator[tuple[str, int, int]]:
        """(archive, start, length) of all captures of the key and page."""
        want = _sortable(key, page)
        block = max(0, bisect.bisect_left(self.firsts, want) - 1)  # equal captures may begin in the block before
        while block < len(self.directory) and self.firsts[block] <= want:
            self._open(block)
            for i in range(bisect.bisect_left(self.keys, want), len(self.keys)):
                if self.keys[i] != want:
                    return
                yield self.lines[i][2], int(self.lines[i][3]), int(self.lines[i][4])
            block += 1


def look_up(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Resolves wanted(key, page_id) through the index: page_id, file, start, length of every capture."""
    spark = wanted.sparkSession
    # As many rows as the index has shards, that is, shuffle partitions.
    ends = directory.groupBy("shard").agg(F.min(F.struct("key", "page")).alias("first")).collect()
    fences = sorted((_sortable(r["first"]["key"], r["first"]["page"]), r["shard"]) for r in ends)
    firsts, shards = spark.sparkContext.broadcast([f for f, _ in fences]), [s for _, s in fences]

    @frugal
    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = firsts.value
        for part in parts:
            keys, pages = part.column(0).to_pylist(), part.column(1).to_pylist()
            to, rows = [], []
            for i, (k, p) in enumerate(zip(keys, pages, strict=True)):
                want = _sortable(k, p)
                at = max(0, bisect.bisect_left(known, want) - 1)
                while at < len(known) and (known[at] <= want or at == 0):
                    to.append(at)
                    rows.append(i)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([keys[i] for i in rows], pa.string()), pa.array([pages[i] for i in rows], pa.int64())], ["shard", "key", "page"])

    asked = wanted.select("key", F.coalesce("page_id", F.lit(_LOWEST)).alias("page")).distinct().mapInArrow(route, "shard int, key string, page long")
    names = spark.createDataFrame(list(enumerate(shards)), "number int, shard string")
    blocks = directory.join(F.broadcast(names), "shard").select(F.col("number").alias("shard"), F.lit(0).alias("kind"), "key", "page", "start", "length")
    both = blocks.unionByName(asked.select("shard", F.lit(1).alias("kind"), "key", "page", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("length")))

    @frugal
    def resolve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        now, blocks, shard = None, [], None
        for part in parts:
            found = []
            for number, kind, key, page, start, length in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if number != now:
                    if shard is not None:
                        shard.close()
                    now, blocks, shard = number, [], None
                if kind == 0:
                    blocks.append((key, page, start, length))
                    continue
                if shard is None:
                    shard = Shard(fs, f"{top}/{shards[number]}", blocks)
                found += [(None if page == _LOWEST else page, *place) for place in shard.find(key, page)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "file", "start", "length"])
        if shard is not None:
            shard.close()

    # A shard's directory, then the keys asked of it in order.
    return both.repartition("shard").sortWithinPartitions("shard", "kind", "key", "page").mapInArrow(resolve, "page_id long, file string, start long, length long")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Reads records by ranges: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""

    @frugal
    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(folder)
        name, file, buffer, base = "", None, b"", 0
        for part in parts:
            rows = []
            for file_name, start, length in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if file_name != name:
                    if file is not None:
                        file.close()
                    name, file, buffer, base = file_name, fs.open_input_file(f"{top}/{file_name}"), b"", 0
                if not base <= start <= start + length <= base + len(buffer):
                    file.seek(start)
                    buffer, base = file.read(max(length, READ_BYTES)), start
                rows.append(parse(buffer[start - base : start - base + length]))
            page = [int(f["X-Page-Id"]) if f["X-Page-Id"] else None for f, _ in rows]
            refers = [int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None for f, _ in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(page, pa.int64()), pa.array([int(f["X-Payload-Length"]) for f, _ in rows], pa.int64()), pa.array([f["WARC-Payload-Digest"][7:] for f, _ in rows], pa.string()),
                pa.array([f["WARC-Type"] for f, _ in rows], pa.string()), pa.array(refers, pa.int64()), pa.array([f["WARC-Target-URI"] for f, _ in rows], pa.string())],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if file is not None:
            file.close()

    stretch = F.floor(F.col("start") / (64 << 20))  # archives are dealt out in stretches, so a long one does not hold up a task
    ordered = places.select("file", "start", "length").repartition("file", stretch).sortWithinPartitions("file", "start")
    return ordered.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives with their index, then looks every page up and reads its record back."""
    folder = shared_dir(pages.sparkSession)
    captures = write_archives(pages, f"{folder}/warc")
    directory = build_index(captures, f"{folder}/index")
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    return read_records(look_up(wanted, directory, f"{folder}/index"), f"{folder}/warc")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_FROM} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
