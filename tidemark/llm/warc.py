"""WARC archives as a Spark data source, read and written in Python tasks.

    warc.register(spark)
    df = spark.read.format("warc").load(folder).where("record_type = 'response' and target_uri like 'https:%'")
    df.write.format("warc").mode("append").save(other)

Reading: whole files are packed into partitions of about `partition_bytes` (option).  Predicates on record_type and
on columns that stand for header fields are pushed down and decided as soon as a record's header is parsed;
what fails is passed over without its payload being decoded.  In plain files that is a seek.  In .warc.gz files (a gzip
member a record) the writer notes a member's length in its header, as the WARC annex on compression describes ('sl', skip
lengths), so that it is a seek too; members without the note, and files that are one member, are inflated and dropped.
A schema given by .schema(...) without payload, http_status and http_headers leaves all blocks undecoded.

Writing: a task writes files of about `file_bytes` (option) under a name of its own attempt; the commit moves
those of the attempts that count into the folder, so a task that is run again leaves nothing behind.

The query writes one record a page.  Of pages with equal payloads the one with the least page_id is the response, the
others are revisits that refer to it.  Equality is by SHA-256 and length, since SHA-1 collisions can be made; only
payloads that occur more than once are looked up, so where these are few the texts are not shuffled.

Defined results: a null html is the empty payload; rows that repeat a page_id and its payload are all response; null
page_ids follow all others, and are responses where they have a payload to themselves; a null url is left out of the header;
control characters and outer spaces of header values are percent-encoded; other columns are not written; an empty table
gives an archive without pages and no rows.  A record that is cut short, or has no valid length, is an error that names file
and offset.  Folders that Python cannot open by pyarrow's file systems (local, HDFS, S3, GCS) are not supported.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Scratch, brief_batches, salted_join, settings, table, turn_of

SCHEMA = """record_id string, record_type string, date string, target_uri string, refers_to string, payload_digest string, content_type string, content_length long,
 headers map<string, string>, http_status int, http_headers map<string, string>, payload binary, file string, offset long"""
#: Header fields that columns stand for; those whose values stand in angle brackets; profile of a revisit.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}
BRACKETED = {"record_id", "refers_to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns for which a record's block has to be decoded.
DECODED = {"http_status", "http_headers", "payload"}
PARTITION_BYTES, FILE_BYTES, PIECE, LEAST_BYTES = 128 << 20, 1 << 30, 1 << 16, 0
#: Payloads that occur more than once, of which this many may be broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS = 500_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), os.path.abspath(local)) if "://" not in local else fs.FileSystem.from_uri(path)


# ---- reading


class Plain:
    """Bytes of an archive without compression."""

    def __init__(self, raw):
        self.raw, self.at, self.start = raw, 0, 0

    def begin(self) -> None:
        self.start = self.at

    def take(self, n: int) -> bytes:
        data = self.raw.read(n)
        self.at += len(data)
        return data

    def drop(self, n: int) -> int:
        """Pass over n bytes; says how many there were."""
        n = max(min(n, self.raw.size() - self.at), 0)
        self.at += n
        self.raw.seek(self.at)
        return n

    def back(self, data: bytes) -> None:
        self.at -= len(data)
        self.raw.seek(self.at)

    def skip(self) -> bool:
        return False


class Zipped:
    """Bytes of an archive of gzip members; `skip` leaves a member that says how long it is without inflating it."""

    def __init__(self, raw):
        self.raw, self.held, self.inflater, self.next, self.start, self.length = raw, b"", None, 0, 0, None

    def begin(self) -> None:
        if not self.held and (self.inflater is None or self.inflater.eof):
            self.start, self.length = self.next, None
            self.raw.seek(self.next)
            head = self.raw.read(24)
            if len(head) >= 24 and head[:3] == b"\x1f\x8b\x08" and head[3] & 4 and head[12:16] == b"sl\x08\x00":
                self.length = struct.unpack("<I", head[16:20])[0] or None
            self.inflater = None
        else:  # a record within a member
            self.length = None

    def _more(self) -> bytes:
        while True:
            if self.inflater is None or self.inflater.eof:
                self.raw.seek(self.next)
                self.inflater = zlib.decompressobj(31)
            data = self.inflater.unconsumed_tail or self.raw.read(PIECE)
            if not data:
                return b""
            out = self.inflater.decompress(data, 8 * PIECE)
            if self.inflater.eof:
                self.next = self.raw.tell() - len(self.inflater.unused_data)
            if out:
                return out

    def take(self, n: int) -> bytes:
        parts = [self.held]
        held = len(self.held)
        while held < n and (more := self._more()):
            parts.append(more)
            held += len(more)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def drop(self, n: int) -> int:
        gone = min(n, len(self.held))
        self.held = self.held[gone:]
        while gone < n and (more := self._more()):
            self.held = more[n - gone :]
            gone += min(len(more), n - gone)
        return gone

    def back(self, data: bytes) -> None:
        self.held = data + self.held

    def skip(self) -> bool:
        if self.length is None:
            return False
        self.next, self.held, self.inflater = self.start + self.length, b"", None
        return True


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, with continued lines joined and repeated names listed."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _head(stream) -> bytes | None:
    """The bytes of a header up to its empty line; None at the end of the archive."""
    data = b""
    while True:
        more = stream.take(2048)
        data = (data + more).lstrip(b"\r\n") if not data else data + more
        if (end := data.find(b"\r\n\r\n")) >= 0:
            stream.back(data[end + 4 :])
            return data[:end]
        if not more:
            if data:
                raise ValueError("a header without an end")
            return None


@dataclass
class Record:
    values: dict
    headers: dict[str, str]
    body: bytes | None

    def column(self, name: str):
        if name in FIELDS:
            return self.values[name]
        return self.headers if name == "headers" else self.values.get(name)


def values_of(headers: dict[str, str]) -> dict:
    lower = {k.lower(): v for k, v in headers.items()}
    out = {c: lower.get(f.lower()) for c, f in FIELDS.items()}
    for c in BRACKETED:
        out[c] = out[c].removeprefix("<").removesuffix(">") if out[c] is not None else None
    if out["payload_digest"] is not None:
        out["payload_digest"] = re.sub("^sha1:", "", out["payload_digest"])
    out["content_length"] = int(out["content_length"])
    if out["content_length"] < 0:
        raise ValueError("a length below 0")
    return out


def http_parts(body: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, header fields and payload of an HTTP message."""
    end = body.find(b"\r\n\r\n")
    head, payload = (body[:end], body[end + 4 :]) if end >= 0 else (body, b"")
    status = re.match(rb"HTTP/\S+ (\d{3})\b", head)
    return int(status[1]) if status else None, _fields(head), payload


def records(raw, zipped: bool, wanted, decode: bool, name: str) -> Iterator[Record]:
    """The records of a file that `wanted` accepts by the values of their headers; their blocks only where asked for."""
    stream = Zipped(raw) if zipped else Plain(raw)
    while True:
        stream.begin()
        at = stream.start
        try:
            head = _head(stream)
            if head is None:
                return
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC header")
            headers = _fields(head)
            values = values_of(headers)
        except (ValueError, TypeError, zlib.error) as e:
            raise ValueError(f"{name} at {at}: {e}") from e
        size, body, keep = values["content_length"], None, wanted(values)
        values |= {"file": name, "offset": at}
        if keep and decode:
            body = stream.take(size)
            if len(body) < size:
                raise ValueError(f"{name} at {at}: a block of {size} bytes ends after {len(body)}")
            if (values["content_type"] or "").startswith("application/http"):
                values["http_status"], values["http_headers"], values["payload"] = http_parts(body)
            else:
                values["payload"] = body
            if values["record_type"] == "revisit":
                values["payload"] = None
            stream.drop(4)
        elif not stream.skip() and stream.drop(size + 4) < size:
            raise ValueError(f"{name} at {at}: a block of {size} bytes is cut short")
        if keep:
            yield Record(values, headers, body)


def holds(f: Filter, values: dict) -> bool | None:
    """Whether a predicate holds for a header's values, as SQL has it: None where a null leaves it open."""
    if isinstance(f, Not):
        inner = holds(f.child, values)
        return None if inner is None else not inner
    value = values[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if isinstance(f, In):
        return None if value is None else True if value in f.value else None if None in f.value else False
    if value is None or f.value is None:
        return None
    return _TESTS[type(f)](value, f.value)


_TESTS = {
    EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a,
}


def decided(f: Filter) -> bool:
    """Whether a header alone decides a predicate."""
    if isinstance(f, Not):
        return decided(f.child)
    known = (*_TESTS, IsNull, IsNotNull, EqualNullSafe, In)
    # strings are ordered by UTF-8 bytes, which is the order of code points
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in FIELDS


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.schema, self.filters = path, schema, []
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if decided(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Files in the order of their names, as many in a partition as its bytes allow."""
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(part[0] in "_." for part in p.removeprefix(path).split("/") if part)
        files = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and (info.is_file or not hidden(f.path)))
        packs, held = [[]], 0
        for file, size in files:
            if packs[-1] and held + size > self.bytes:
                packs.append([])
                held = 0
            packs[-1].append(file)
            held += size
        return [InputPartition(p) for p in packs if p] or [InputPartition([])]

    def read(self, partition):
        turn_of("warc")
        names = self.schema.fieldNames()
        arrow, decode = to_arrow_schema(self.schema), bool(DECODED & set(names))
        system, _ = opened(self.path)
        wanted = lambda values: all(holds(f, values) is True for f in self.filters)
        rows, size = [], 0
        for file in partition.value:
            with system.open_input_file(file) as raw:
                for record in records(raw, file.endswith(".gz"), wanted, decode, file):
                    rows.append(tuple(record.column(n) for n in names))
                    size += len(record.body or b"") + 200
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(map(_entries, c) if pa.types.is_map(f.type) else c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _entries(value):
    return None if value is None else list(value.items())


# ---- writing


def clean(value: str) -> str:
    """A header value without control characters and outer spaces, which are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member whose header notes how long it is, and how long what it holds."""
    squeezer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = squeezer.compress(record) + squeezer.flush()
    size = 24 + len(data) + 8
    note = struct.pack("<2sHII", b"sl", 8, size if size < 1 << 32 else 0, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\x00" * 4 + b"\x00\xff" + struct.pack("<H", len(note)) + note + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict, date: str) -> bytes:
    """A record: an HTTP response around the payload where there is an http_status, or else the payload alone."""
    payload = row.get("payload") or b""
    fields = dict(row.get("headers") or [])
    known = {f.lower() for f in FIELDS.values()}
    if bad := [n for n in fields if not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", n)]:
        raise ValueError(f"not a header name: {bad[0]!r}")
    if row.get("http_status") is not None:
        lines = [f"HTTP/1.1 {row['http_status']} ", *(f"{k}: {clean(v)}" for k, v in (row.get("http_headers") or []))]
        block, kind = "\r\n".join([*lines, "", ""]).encode() + payload, "application/http; msgtype=response"
    else:
        block, kind = payload, row.get("content_type")
    told = row.get("payload_digest") or (digest(payload) if row["record_type"] in ("response", "resource") else None)
    values = row | {"date": row.get("date") or date, "record_id": row.get("record_id") or f"urn:uuid:{uuid.uuid4()}", "content_type": kind, "content_length": str(len(block)), "payload_digest": told and f"sha1:{told}"}
    head = ["WARC/1.1", *(f"{f}: {f'<{clean(v)}>' if c in BRACKETED else clean(v)}" for c, f in FIELDS.items() if (v := values.get(c)) is not None)]
    if row["record_type"] == "revisit" and "WARC-Profile" not in fields:
        head.append(f"WARC-Profile: {PROFILE}")
    head += [f"{k}: {clean(v)}" for k, v in fields.items() if k.lower() not in known and v is not None]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        self.bytes, self.zipped = int(options.get("file_bytes", FILE_BYTES)), options.get("compression", "gzip") == "gzip"
        self.date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _between(self) -> tuple[fs.FileSystem, str, str]:
        system, path = opened(self.path)
        return system, path, f"{path}/_writing-{self.run}"

    def write(self, iterator):
        turn_of("warc")
        system, _, folder = self._between()
        system.create_dir(folder, recursive=True)
        task, files, out, size = TaskContext.get(), [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > self.bytes:
                        if out:
                            out.close()
                        files.append(f"part-{task.partitionId():05d}-{self.run[:8]}-{task.taskAttemptId()}-{len(files)}.warc{'.gz' * self.zipped}")
                        out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                        size += self._put(out, {"record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC file version 1.1\r\n"})
                    size += self._put(out, row)
        finally:
            if out:
                out.close()
        return Written(files)

    def _put(self, out, row: dict) -> int:
        data = record_bytes(row, self.date)
        data = member(data) if self.zipped else data
        out.write(data)
        return len(data)

    def commit(self, messages):
        system, path, folder = self._between()
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file and re.search(r"\.warc(\.gz)?$", f.path):
                    system.delete_file(f.path)
        for name in (n for m in messages if m for n in m.files):
            system.move(f"{folder}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        system, _, folder = self._between()
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if unknown := set(schema.fieldNames()) - {*FIELDS, *DECODED, "headers", "file", "offset"}:
            raise ValueError(f"no such columns of an archive: {sorted(unknown)}")
        return Reader(self.options["path"], schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if "record_type" not in schema.fieldNames():
            raise ValueError("a record needs a record_type")
        return Writer(self.options["path"], self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark push predicates down to Python data sources."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages


def base32(hexadecimal: Column) -> Column:
    """A SHA-1 in hexadecimal as upper-case base 32: five signs of the one are four of the other."""
    piece = lambda i: F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*(piece(i) for i in range(1, 40, 5))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, run: Scratch, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One record a page (page_id, url, html), as the writer takes them; payloads below `least_bytes` are not looked for elsewhere.

    `run` keeps the table of payloads that occur more than once.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    size = F.length("payload")
    own = F.concat(F.lit("alone:"), F.coalesce(F.col("page_id").cast("string"), F.sha2("payload", 256)))
    rows = rows.withColumn("key", F.when(size >= least_bytes, F.concat(F.sha2("payload", 256), F.lit(":"), size)).otherwise(own))
    repeated = rows.where(size >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    repeated = run.kept(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(repeated), "key", "left")
    else:
        rows = salted_join(rows, repeated, "key", "page_id", how="left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    http = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), size.cast("string"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), named(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.when(again, named(F.col("first"))).alias("refers_to"),
        base32(F.sha1("payload")).alias("payload_digest"), F.lit(200).alias("http_status"), http.alias("http_headers"), F.when(~again, F.col("payload")).alias("payload"),
    )


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of an archive's pages.

    Of responses, length and digest are those of the payload as read, which must agree with the header; of revisits, those
    that the headers tell, and no payload is decoded.
    """
    heads = "record_id string, record_type string, refers_to string, payload_digest string"
    source = lambda schema: spark.read.format("warc").schema(schema).load(folder)
    page = lambda c: F.substring(c, len("urn:page:") + 1, 20).try_cast("long")
    own = base32(F.sha1("payload"))
    response = source(f"{heads}, payload binary").where("record_type = 'response'")
    response = response.select("record_id", "record_type", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.when(own == F.col("payload_digest"), own).otherwise(F.raise_error(F.concat(F.lit("the payload of this record does not have its digest: "), "record_id"))).alias("payload_digest"))
    revisit = source(f"{heads}, http_headers map<string, string>").where("record_type = 'revisit'")
    revisit = revisit.select("record_id", "record_type", "refers_to", F.element_at("http_headers", "Content-Length").cast("long").alias("payload_bytes"), "payload_digest")
    return response.unionByName(revisit).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Scratch(spark, "warc")
    with settings(spark, spark__sql__python__filterPushdown__enabled="true"), brief_batches(spark):
        register(spark)
        captures(table(spark, sf_dir, "pages"), run).write.format("warc").mode("append").save(f"{run.folder}/archive")
        return run.result(read_back(spark, f"{run.folder}/archive"))
