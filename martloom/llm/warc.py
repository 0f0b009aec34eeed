"""WARC archives as a Spark data source, written and read by Python tasks.

Writing: each task streams its rows into ``part-*.warc.gz`` files, one gzip member per record. The
member header carries its length (the ``sl`` extra field), so a reader can step over a record
without inflating it. File names are new for every attempt; only files of committed tasks enter
``manifest.json``, so a repeated or lost task leaves nothing that is read.

Reading: files are packed into partitions by size. Equality, ``IN``, prefix and null tests on header
columns are pushed down. A record is inflated only up to the end of its headers; the rest is
inflated only if the record passes and the payload is asked for (option ``payload``, default true).
Archives of other writers (plain or gzip, without ``sl``) are read too.

A ``response`` holds an HTTP message; its payload is the body. A ``revisit`` holds the HTTP headers
only; ``payload_length`` is then their Content-Length. Null texts are written as empty payloads,
control characters in header values are percent-encoded. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import json
import posixpath
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull,
    IsNull, StringStartsWith, WriterCommitMessage,
)

from martloom.llm.shared import file_system

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_length bigint, payload binary"
)
_HEADERS = {  # column: header
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "date": "warc-date", "refers_to": "warc-refers-to",
}
_BREAK = b"\r\n\r\n"


# --- records ---------------------------------------------------------------------------------

def record(row: dict) -> bytes:
    """One WARC record: ``record_type``, ``record_id``, ``target_uri``, ``date``, ``refers_to``,
    ``payload_digest`` (hex SHA-1), ``payload_length``, ``payload``."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_length']}\r\n\r\n"
    ).encode()
    block = http + (row["payload"] or b"") if row["record_type"] == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}"]
    for column, name in (
        ("record_id", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"),
        ("date", "WARC-Date"), ("refers_to", "WARC-Refers-To"),
    ):
        value = row.get(column)
        if value is not None:
            value = quote(value, safe=string.punctuation)
            in_brackets = column in ("record_id", "refers_to")
            lines.append(f"{name}: <{value}>" if in_brackets else f"{name}: {value}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _BREAK + block + _BREAK


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose ``sl`` field holds its own and the inflated length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = struct.pack("<BBBBIBB", 31, 139, 8, 4, 0, 0, 255)
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Window:
    """A forward-only view of a file with a bounded buffer."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.step, self.buffer, self.at, self.ended = file, step, b"", 0, False

    def ask(self, n: int) -> bool:
        """Whether ``n`` bytes from here on are there; reads as needed."""
        parts, have = [self.buffer[self.at:]], len(self.buffer) - self.at
        if have >= n:
            return True
        while have < n and not self.ended:
            more = self.file.read(max(self.step, n - have))
            self.ended = not more
            parts.append(more)
            have += len(more)
        self.buffer, self.at = b"".join(parts), 0
        return have >= n

    def find(self, mark: bytes) -> int:
        """Length from here to the end of ``mark``; -1 if it doesn't come."""
        start = 0
        while True:
            found = self.buffer.find(mark, self.at + start)
            if found >= 0:
                return found + len(mark) - self.at
            have = len(self.buffer) - self.at
            start = max(0, have - len(mark))
            if not self.ask(have + 1):
                return -1

    def take(self, n: int) -> bytes:
        self.ask(n)
        out = self.buffer[self.at:self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
            return
        self.buffer, self.at = b"", 0
        self.file.seek(n - have, 1)


class _Inflated:
    """One gzip member, inflated step by step; ``close`` moves the window behind it."""

    def __init__(self, window: Window):
        self.window, self.data, self.raw = window, b"", zlib.decompressobj(31)
        window.ask(24)
        head = window.buffer[window.at:window.at + 24]
        self.size = struct.unpack_from("<I", head, 16)[0] if head[3] == 4 and head[12:14] == b"sl" else 0
        self.used = 0
        self.todo = b""

    def more(self, n: int) -> bool:
        while len(self.data) < n and not self.raw.eof:
            if not self.todo:
                # Output can still wait inside the decompressor.
                waiting = self.raw.decompress(b"", n - len(self.data))
                self.data += waiting
                if waiting or self.raw.eof:
                    continue
                step = min(1 << 16, self.size - self.used) if self.size else 1 << 16
                self.todo = self.window.take(step)
                self.used += len(self.todo)
                if not self.todo:
                    raise EOFError("an archive ends inside a record")
            self.data += self.raw.decompress(self.todo, n - len(self.data))
            self.todo = self.raw.unconsumed_tail
        return len(self.data) >= n

    def head(self) -> int:
        n = 1 << 10
        while (found := self.data.find(_BREAK)) < 0:
            if not self.more(n):
                if (found := self.data.find(_BREAK)) < 0:
                    raise ValueError("a record has no end of its headers")
                break
            n += len(self.data)
        return found + len(_BREAK)

    def body(self, start: int, length: int) -> bytes:
        self.more(start + length)
        return self.data[start:start + length]

    def extended(self, start: int, block: bytes, length: int) -> bytes:
        """``block``, the first bytes of the record's block, read on up to ``length``."""
        return self.body(start, length)

    def close(self) -> None:
        if self.size:
            self.window.skip(self.size - self.used)
            return
        while not self.raw.eof:
            self.more(len(self.data) + (1 << 20))
        back = self.raw.unused_data
        window = self.window
        window.buffer, window.at = back + window.buffer[window.at:], 0


class _Plain:
    def __init__(self, window: Window):
        self.window, self.left = window, 0

    def head(self) -> int:
        n = self.window.find(_BREAK)
        if n < 0:
            raise ValueError("a record has no end of its headers")
        self.data = self.window.take(n)
        return n

    def body(self, start: int, length: int) -> bytes:
        got = self.window.take(length)
        self.left -= len(got)
        return got

    def extended(self, start: int, block: bytes, length: int) -> bytes:
        return block + self.body(start, length - len(block))

    def close(self) -> None:
        self.window.skip(max(0, self.left))


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _header_end(block: bytes) -> int:
    """Where the HTTP headers end; a block without their end is headers alone."""
    found = block.find(_BREAK)
    return len(block) if found < 0 else found + len(_BREAK)


def _digest(value: str | None) -> str | None:
    """Hex of a base32 SHA-1; other digests stay as they are."""
    if value and value.startswith("sha1:") and len(value) == 37:
        return base64.b32decode(value[5:]).hex()
    return value


def records(file, keep, payload: bool) -> Iterator[tuple]:
    """Rows of one archive. ``keep`` judges the header columns before anything else is decoded."""
    window = Window(file)
    while window.ask(1):
        if window.buffer[window.at] in b"\r\n":
            window.skip(1)
            continue
        # A member can begin with the last byte that is buffered.
        packed = window.ask(2) and window.buffer[window.at:window.at + 2] == b"\x1f\x8b"
        one = _Inflated(window) if packed else _Plain(window)
        start = one.head()
        fields = _fields(one.data[:start])
        length = int(fields.get("content-length", 0))
        one.left = length
        row = {c: fields.get(h) for c, h in _HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        row["payload_digest"] = _digest(fields.get("warc-payload-digest"))
        if keep(row):
            body, size = None, length
            http = fields.get("content-type", "").startswith("application/http")
            if http and not payload and row["record_type"] == "response":
                # The block without its HTTP headers, which are mostly short.
                block = one.body(start, min(length, 1 << 14))
                while _BREAK not in block and len(block) < length:
                    more = min(length, 2 * len(block))
                    if len(longer := one.extended(start, block, more)) == len(block):
                        break
                    block = longer
                size = length - _header_end(block)
            elif http:
                block = one.body(start, length)
                cut = _header_end(block)
                if row["record_type"] == "revisit":
                    size = int(_fields(block[:cut]).get("content-length", 0))
                else:
                    body = block[cut:]
                    size = len(body)
            elif payload:
                body = one.body(start, length)
            yield (*row.values(), size, body)
        one.close()


# --- data source -----------------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]  # name, bytes, records


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("file_bytes", 128 << 20))
        self.level = int(options.get("level", 4))

    def write(self, iterator) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        done, out, name, size, count = [], None, "", 0, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(posixpath.join(root, name), compression=None)
                data = member(record(row), self.level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= self.limit:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        return Written(done)

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files = [list(f) for m in messages if m for f in m.files]
        with system.open_output_stream(posixpath.join(root, "manifest.json")) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for message in messages:
            for name, _, _ in message.files if message else ():
                system.delete_file(posixpath.join(root, name))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 16 << 20))
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        columns = {*_HEADERS, "payload_digest"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in columns:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull | IsNull):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def keep(self, row: dict) -> bool:
        for column, how, value in self.tests:
            have = row[column]
            if how == "null":
                if (have is None) != value:
                    return False
            elif have is None or not (have in value if how == "in" else have.startswith(value)):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.path)
        manifest = posixpath.join(root, "manifest.json")
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                files = [(n, b) for n, b, _ in json.loads(f.read())]
        else:
            found = system.get_file_info(fs.FileSelector(root))
            files = [(f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        out, size = [], 0
        for name, n in sorted(files):
            if not out or size + n > self.partition_bytes:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def read(self, partition):
        system, root = file_system(self.path)
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(posixpath.join(root, name)) as file:
                for row in records(file, self.keep, self.payload):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*_HEADERS, "payload_digest", "payload_length", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
    )


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def write_warc(df: DataFrame, path: str, **options: str) -> None:
    """``df`` has the columns of ``SCHEMA``; ``path`` must be new and reachable by all tasks."""
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").options(**options).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


# --- pages -----------------------------------------------------------------------------------

URN = "urn:page:"


def page_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Record rows of ``page_id, url, html``. Of equal payloads of at least ``min_bytes`` bytes the
    one with the largest ``page_id`` is the response (repeated ids: each of its rows), the others
    are revisits. A null id is smaller than any other."""
    sized = pages.select(
        "page_id", F.col("url").alias("target_uri"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"payload_length": F.octet_length("payload").cast("long")}).withColumn(
        "payload_digest", F.sha1("payload")
    )
    # Equal payloads are counted on digests alone and combined before the shuffle.
    repeated = (
        sized.where(F.col("payload_length") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    urn = lambda c: F.concat(F.lit(URN), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return sized.join(repeated, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"), "target_uri",
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn("first_id")).alias("refers_to"),
        "payload_digest", "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(urn: str) -> Column:
    """The page id in a record id; null for a page without one."""
    return F.expr(f"try_cast(substring({urn}, {len(URN) + 1}) as bigint)")
