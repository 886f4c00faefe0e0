"""WARC archives as a Spark data source, in Python.

Writing: each task writes compressed files, a gzip member for each record. The member's extra field `sl` holds its
compressed and plain length, so that a reader can step over it. A driver-side manifest lists the files of committed
tasks with offsets at which they may be split; files of lost or repeated attempts are in no manifest.

Reading: partitions are file ranges from the manifest, or whole files where there is none. A record's headers are
decoded first; predicates on record_type, record_id, target_uri, payload_digest and refers_to that Spark pushes down
are applied to them, and the payload of a record that fails, or every payload with the option payload=false, is never
inflated. Foreign archives, plain or compressed without `sl`, are read too, by inflating or seeking through them.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs) and that all executors share.

Cases: a null payload is written as an empty one; a null target_uri has no header; white space and control characters
in a URI are percent-encoded; repeated rows give a record each; an empty table gives an archive without records.
"""

from __future__ import annotations


import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from assaylake.llm.common import work_path

FORMAT = "assaylake_warc"
MANIFEST = "_records.json"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
#: A file may be split, and a batch is handed on, about every so many bytes.
SPLIT, BATCH = 32 << 20, 4 << 20
#: From this many payload bytes on, equal payloads are stored once.
LEAST_REVISIT = 1000
MEMBER = struct.Struct("<4sIBBHBBHII")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# --- records


def _uri(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_bytes(record_id: str, record_type: str, target_uri: str | None, digest: str, size: int, refers_to: str | None, payload: bytes, date: str) -> bytes:
    http = b""
    if record_type == "response":
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_uri(target_uri)}"] if target_uri is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(plain: bytes, level: int) -> bytes:
    """A gzip member with its lengths in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    head = MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, ord("s"), ord("l"), 8, MEMBER.size + len(body) + 8, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _length(head: dict[str, str]) -> int:
    """The length a record's headers give; 0 where a foreign record has none."""
    value = head.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() else 0


class _Lazy:
    """A record's plain bytes, inflated no further than asked."""

    def __init__(self, packed: bytes | None, plain: bytes | None = None):
        self._inflate, self._rest, self._have = (zlib.decompressobj(31), packed, b"") if plain is None else (None, b"", plain)

    def upto(self, mark: bytes, start: int = 0) -> int:
        while (at := self._have.find(mark, start)) < 0 and self._rest:
            self._more(2048)
        return at

    def _more(self, most: int) -> None:
        self._have += self._inflate.decompress(self._rest, most)
        self._rest = self._inflate.unconsumed_tail

    def all(self) -> bytes:
        if self._rest:
            self._more(0)
        return self._have


def _members(source, start: int, end: int) -> Iterator[tuple[_Lazy, int]]:
    """The records that begin in [start, end) of a file."""
    source.seek(start)
    at = start
    while at < end and (head := source.read(MEMBER.size)):
        if head[:2] != b"\x1f\x8b":  # plain WARC
            text = head
            while (stop := text.find(b"\r\n\r\n")) < 0 and (more := source.read(4096)):
                text += more
            if stop < 0:  # what is left is no record
                return
            length = stop + 4 + _length(_headers(text[:stop])) + 4
            text = text[:length] + source.read(max(0, length - len(text)))
            yield _Lazy(None, text), len(text)
            at += length
            source.seek(at)
        elif len(head) == MEMBER.size and head[3] == 4 and head[12:14] == b"sl":
            length = MEMBER.unpack(head)[8]
            yield _Lazy(head + source.read(length - len(head))), length
            at += length
        else:  # a member whose length only inflating tells
            inflate, plain, packed, read = zlib.decompressobj(31), b"", head, len(head)
            while not inflate.eof and packed:
                plain += inflate.decompress(packed)
                if not inflate.eof:
                    packed = source.read(65536)
                    read += len(packed)
            length = read - len(inflate.unused_data)
            yield _Lazy(None, plain), length
            at += length
            source.seek(at)


def read_records(source, start: int, end: int, keep, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA; keep(row without payload) decides from the headers alone."""
    bare = lambda x: x[1:-1] if x and x[0] == "<" else x
    for record, _ in _members(source, start, end):
        stop = record.upto(b"\r\n\r\n")
        head = _headers(record.all()[:stop] if stop < 0 else record._have[:stop])
        digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
        size = int(head["x-payload-length"]) if "x-payload-length" in head else None
        row = (bare(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-target-uri"), digest, size, bare(head.get("warc-refers-to")))
        if not keep(row):
            continue
        body = None
        if payload and row[1] != "revisit":
            plain = record.all()
            begin = stop + 4
            stop_at = begin + _length(head)
            if "application/http" in head.get("content-type", ""):
                begin = plain.find(b"\r\n\r\n", begin, stop_at) + 4
            body = plain[begin:stop_at]
        yield (*row, body)


# --- the data source


@dataclass
class Files(WriterCommitMessage):
    files: list


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.level, self.date = int(options.get("level", "3")), options.get("date", "2020-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        out, at, splits = None, 0, [0]
        store, folder = _open_fs(self.path)
        name = f"{uuid.uuid4().hex}.warc.gz"
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload")]
            for values in zip(*columns, strict=True):
                *head, body = (v.as_py() for v in values)
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                packed = member(record_bytes(*head, body or b"", self.date), self.level)
                if at - splits[-1] >= SPLIT:
                    splits.append(at)
                out.write(packed)
                at += len(packed)
        if out is not None:
            out.close()
        return Files([{"name": name, "size": at, "splits": splits}] if at else [])

    def commit(self, messages: list) -> None:
        store, folder = _open_fs(self.path)
        store.create_dir(folder, recursive=True)
        old = [] if self.overwrite else _manifest(store, folder) or []
        files = old + [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{folder}/{MANIFEST}.part", compression=None) as out:
            out.write(json.dumps(files).encode())
        store.move(f"{folder}/{MANIFEST}.part", f"{folder}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        store, folder = _open_fs(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{folder}/{f['name']}")


def _manifest(store: fs.FileSystem, folder: str) -> list | None:
    if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{folder}/{MANIFEST}") as x:
        return json.loads(x.read())


class WarcReader(DataSourceReader):
    COLUMNS = {"record_id": 0, "record_type": 1, "target_uri": 2, "payload_digest": 3, "refers_to": 5}

    def __init__(self, options: dict):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[int, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = self.COLUMNS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column is not None and isinstance(f, EqualTo):
                self.tests.append((column, "in", frozenset([f.value])))
            elif column is not None and isinstance(f, In):
                self.tests.append((column, "in", frozenset(f.value)))
            elif column is not None and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, at = _open_fs(self.path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [Range(self.path, 0, store.get_file_info(at).size)]
        if (files := _manifest(store, at)) is None:
            found = store.get_file_info(fs.FileSelector(at, recursive=True))
            files = [{"name": f.path[len(at) :].lstrip("/"), "size": f.size, "splits": [0]} for f in found if f.path.endswith((".warc", ".warc.gz"))]
        return [Range(f"{self.path}/{f['name']}", a, b) for f in files for a, b in zip(f["splits"], [*f["splits"][1:], f["size"]], strict=True)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        tests = self.tests

        def keep(row: tuple) -> bool:
            return all(row[c] is not None and (row[c] in v if how == "in" else row[c].startswith(v)) for c, how, v in tests)

        store, at = _open_fs(partition.path)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        with store.open_input_file(at) as raw:
            source = io.BufferedReader(raw, 1 << 20)
            rows, held = [], 0
            for row in read_records(source, partition.start, partition.end, keep, self.payload):
                rows.append(row)
                held += 200 + len(row[6] or b"")
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


# --- pages as an archive


def revisits(pages: DataFrame) -> DataFrame:
    """Of pages(page_id, url, html) the records to write: the largest page_id of equal payloads answers, others revisit it.

    Rows that repeat the largest page_id all answer. A page without an id revisits the largest id of its payload; where no page of
    a payload has an id, all its pages answer.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    long = F.col("payload_bytes") >= LEAST_REVISIT
    # Partial aggregation leaves a row for each payload and task, however many copies there are.
    firsts = rows.filter(long).groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(firsts, "same", "left")
    again = long & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return rows.select(
        F.coalesce(name("page_id"), F.lit("urn:page:")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        "payload_digest", "payload_bytes", F.when(again, name("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )



def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = work_path(spark, "warc")
    revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format(FORMAT).mode("append").save(path)
    back = spark.read.format(FORMAT).load(path)
    number = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    # What a response holds is measured on the payload itself; a revisit has it in its headers only.
    return back.select(
        number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
