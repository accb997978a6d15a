"""WARC archives with a two-level capture index.

Records are written one gzip member each.  The index sorts captures by reversed-host URL key into compressed blocks;
a sparse directory at the end of each index file keeps its blocks' first keys and places, and a table of index files their
first keys.  A lookup bisects the files, then a file's directory, reads one block, bisects it, and reads one range of one
archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.util import bound_batches, number_of_partitions, pieces_of, shared_path, small_or_shuffled, stored

#: Captures in a compressed index block, and bytes after which a task begins a new archive.
BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.com:80/x?y`` -> ``com,a,www:80)/x?y``; a null or hostless url keeps its text."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        host, port, parts = "", None, None
    if not host:
        return (url or "").lower()
    key = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, is_revisit: bool = False) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    #: Line ends would end the header, so a url is written in one line.
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """(WARC headers, payload held, length of the full payload)."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return headers, payload, full


def _page_of(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("", "null") else int(value)


def _opened(uri: str):
    """File system and path of a uri; Hadoop's names of object stores become those of Arrow."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


class _Appender:
    """An archive or index file that appears under its name only once it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _opened(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.tmp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.out, self.at = self.fs.open_output_stream(self.tmp, compression=None), 0

    def append(self, data: bytes) -> int:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


class RangeReader:
    """Range reads; keeps a few files open."""

    def __init__(self, most: int = 32):
        self.open, self.most = {}, most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            fs, path = _opened(uri)
            self.open[uri] = fs.open_input_file(path)
        return self.open[uri].read_at(length, offset)


CAPTURES = "url_key string, page_id long, archive string, offset long, length long, payload_digest string, record_type string"
FILES = "first_key string, first_id long, index_file string, directory_offset long, directory_length long, n_blocks long, n_lines long"


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record a row under ``uri``; returns the captures, already stored.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is the response and
    the others are revisits of it; shorter payloads are responses.  A null payload is empty; a null id ranks above all
    others and never is referred to unless all are null; rows that repeat the smallest id are responses too; urls may
    be null; other columns are ignored.  Each task writes archives named by its partition and renames them when whole,
    so a task that runs again after a loss writes the same bytes to the same name.
    """
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    shared = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = small_or_shuffled(shared.select("sha1", "first_id"))
    rows = rows.join(shared, "sha1", "left")
    revisit = F.col("first_id").isNotNull() & (F.octet_length("html") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("first_id"), F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def write(batches):
        part, k, out = TaskContext.get().partitionId(), 0, None
        for b in pieces_of(batches):
            made = []
            for page_id, url, html, first_id, is_revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "revisit"))):
                if out and out.at >= ARCHIVE_BYTES:
                    out.close()
                    out, k = None, k + 1
                if out is None:
                    name = f"{uri}/part-{part:06d}-{k:04d}.warc.gz"
                    out = _Appender(name)
                data = html.encode()
                digest = digest_of(data)
                record = build_record(page_id, url, data, digest, first_id, is_revisit)
                made.append((url_key(url), page_id, name, out.append(record), len(record), digest, "revisit" if is_revisit else "response"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 7, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[c.split()[0] for c in CAPTURES.split(", ")])
        if out:
            out.close()

    return stored(rows.mapInArrow(write, CAPTURES), "warc-captures")


def _order(key: str, page_id) -> tuple[str, int]:
    """Captures are sorted by key and id, null ids first."""
    return key, -(1 << 63) if page_id is None else page_id


def build_index(captures: DataFrame, uri: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by (url key, id), write compressed blocks and their directory under ``uri``; returns the stored table of
    index files.

    Ranges are dealt by key and id together, so one hot host or url spreads over tasks.  A directory has a line for each
    ``block_lines`` captures of its file; the table has a row a file, that is a task.
    """
    # keys are compared by code point in Python and by UTF-8 bytes in Spark, which is the same order
    ordered = captures.repartitionByRange(F.col("url_key"), F.col("page_id"), F.col("archive"), F.col("offset")).sortWithinPartitions("url_key", "page_id", "archive", "offset")

    def write(batches):
        part, out, lines, blocks = TaskContext.get().partitionId(), None, [], []

        def flush():
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            blocks.append((lines[0][0], lines[0][1], out.append(data), len(data), len(lines)))
            lines.clear()

        for b in batches:
            if out is None and b.num_rows:
                name = f"{uri}/index-{part:06d}.cdxz"
                out = _Appender(name)
            for row in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(row)
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        rows = []
        if out:
            data = zlib.compress(json.dumps(blocks).encode())
            rows.append((blocks[0][0], blocks[0][1], name, out.append(data), len(data), len(blocks), sum(x[4] for x in blocks)))
            out.close()
        types = (pa.string(), *[pa.int64()], pa.string(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=[c.split()[0] for c in FILES.split(", ")])

    return stored(ordered.mapInArrow(write, FILES), "warc-files")


class Index:
    """Bisects the index files (given as sorted rows), a file's directory and a block; keeps the last few of both."""

    def __init__(self, files: list[tuple], reader: RangeReader, most: int = 16):
        self.files, self.reader, self.most = files, reader, most
        self.first = [_order(f[0], f[1]) for f in files]
        self.held: dict = {}

    def _read(self, uri: str, offset: int, length: int, load) -> tuple[list, list]:
        """(sort keys, rows) of a directory or block."""
        if (uri, offset) not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            rows = load(zlib.decompress(self.reader.read(uri, offset, length)).decode())
            self.held[uri, offset] = [_order(x[0], x[1]) for x in rows], rows
        return self.held[uri, offset]

    def captures(self, low: tuple, high: tuple):
        """Captures from ``low`` to ``high`` (key and id), in order."""
        f = max(0, bisect_left(self.first, low) - 1)
        while f < len(self.files) and self.first[f] <= high:
            uri, offset, length = self.files[f][2:5]
            keys, blocks = self._read(uri, offset, length, json.loads)
            k = max(0, bisect_left(keys, low) - 1)
            while k < len(blocks) and keys[k] <= high:
                order, lines = self._read(uri, blocks[k][2], blocks[k][3], lambda x: [json.loads(y) for y in x.split("\n")])
                yield from lines[bisect_left(order, low) : bisect_right(order, high)]
                k += 1
            f += 1


def sorted_files(files: DataFrame) -> list[tuple]:
    """The table of index files, a row a task that wrote one."""
    return sorted((tuple(r) for r in files.collect()), key=lambda r: _order(r[0], r[1]))


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_captures(files: DataFrame, wanted: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every capture of the ``wanted`` (url_key, page_id), found in the index, read by a range read and verified by its digest.

    What is wanted is sorted, so that a task's lookups fall into neighbouring blocks; tasks are counted by the blocks that the
    index has, 64 a task at most.
    """
    rows = sorted_files(files)
    blocks = sum(r[5] for r in rows)
    tasks = max(1, min(blocks, max(number_of_partitions(files.sparkSession), -(-blocks // 64))))

    def read(batches):
        reader = RangeReader()
        index = Index(rows, reader)
        for b in pieces_of(batches, 256):
            made = []
            found = [x for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in index.captures(_order(key, page_id), _order(key, page_id))]
            for _, page_id, archive, at, size, digest, kind in sorted(found, key=lambda x: (x[2], x[3])):
                headers, payload, full = parse_record(reader.read(archive, at, size))
                said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if said != digest or headers["WARC-Type"] != kind or kind == "response" and (digest_of(payload) != digest or len(payload) != full):
                    raise ValueError(f"{archive} at {at} is damaged")
                made.append((page_id, headers.get("WARC-Target-URI", ""), full, said, kind, _page_of(headers.get("WARC-Refers-To")), payload if with_payload else None))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=[c.split()[0] for c in RECORDS.split(", ")])

    keys = wanted.select("url_key", "page_id").distinct()
    dealt = keys.repartitionByRange(tasks, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return dealt.mapInArrow(read, RECORDS)


def lookup(files: DataFrame, url: str) -> list[dict]:
    """All captures of one url."""
    reader, found, key = RangeReader(), [], url_key(url)
    for x in Index(sorted_files(files), reader).captures((key, -(1 << 63)), (key, 1 << 63)):
        headers, payload, full = parse_record(reader.read(x[2], x[3], x[4]))
        found.append({"page_id": x[1], "url": headers["WARC-Target-URI"], "record_type": x[6], "payload_digest": x[5], "payload_bytes": full, "payload": payload})
    return found


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write and index ``pages`` in the shared folder and read every page back through the index.

    A row for each input row, null and repeated ids and urls included; other columns are ignored; an empty table gives none.
    """
    uri = shared_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{uri}/archive", min_revisit_bytes=min_revisit_bytes)
    return read_captures(build_index(captures, f"{uri}/index"), captures)
