"""ARFF as a Spark data source, in batches and as a stream of files.

    arff_source.register(spark)
    spark.read.format("arff").load(folder)
    spark.readStream.format("arff").load(folder)

The schema comes from the header: numeric, nominal and string attributes, and dates with their pattern; all files must have the same
attributes.  Columns `_file` and `_offset` (the byte at which a row begins) give the order of the rows.  Files are cut into ranges
of `range_bytes` at line ends, and small ones are packed; a stream reads each file once, in the order of modification times, and its
offsets name the last one read (a file that appears with an older time than one already read is not seen).

Rows are strict: fields are parted by commas outside quotes; sparse rows are pairs of index and value.  What is wrong is told in
`_problem`, which is null for a good row, according to `mode`:

    permissive   a wrong number of fields, or an index that is none, makes a row of nulls; a field that is empty, is no number, no
                 date of its pattern or no label of the header is null by itself (the default)
    drop         rows with a problem are left out
    failfast     the first one is an error that names file and offset

`?` is null.  An index that a sparse row leaves out is 0, or the first label; for strings and dates it is null.  `class_index` moves an
attribute to the end: -1 the last one (the default), 0 none, k the k-th.  Comments (%) and empty lines are skipped.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

RANGE_BYTES, BATCH = 32 << 20, 5000
#: Letters of date patterns and what they are here.
PATTERN = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "SSS": "%f"}
_ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\S+)\s+(.*)", re.IGNORECASE)
_FIELD = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,]*?)\s*(?:,|$)")


@dataclass
class Attribute:
    name: str
    kind: str  # numeric, nominal, string or date
    labels: tuple[str, ...] = ()
    pattern: str = ""


def bare(text: str) -> str:
    """A value without its quotes and escapes."""
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def fields(text: str) -> list[str]:
    """The fields of a row, between commas outside quotes."""
    if "'" not in text and '"' not in text:
        return [f.strip() for f in text.split(",")]
    out, at = [], 0
    while at <= len(text):
        m = _FIELD.match(text, at)
        if m is None:  # a quote that does not close: the rest is one field
            out.append(text[at:].strip())
            break
        out.append(m[1])
        at = m.end()
        if not m[0].endswith(","):
            break
        if at == len(text):
            out.append("")
            break
    return out


def attribute(line: str) -> Attribute:
    m = _ATTRIBUTE.match(line)
    if m is None:
        raise ValueError(f"not an attribute: {line!r}")
    name, kind = bare(m[1]), m[2].strip()
    if kind.startswith("{"):
        return Attribute(name, "nominal", tuple(bare(f) for f in fields(kind.strip("{} "))))
    word, _, rest = kind.partition(" ")
    if word.lower() == "date":
        pattern = bare(rest.strip()) or "yyyy-MM-dd'T'HH:mm:ss"
        for k, v in sorted(PATTERN.items(), key=lambda p: -len(p[0])):
            pattern = re.sub(rf"(?<![%A-Za-z]){k}(?![A-Za-z])" if len(k) > 2 else rf"(?<!%){k}", v, pattern)
        return Attribute(name, "date", (), pattern.replace("'", ""))
    known = {"numeric": "numeric", "real": "numeric", "integer": "numeric", "string": "string"}
    if word.lower() not in known:
        raise ValueError(f"no such type: {kind!r}")
    return Attribute(name, known[word.lower()])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), os.path.abspath(local)) if "://" not in local else fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[int, str, int]]:
    """(modification time, path, size) of the ARFF files in a folder, or of one file."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "_." and (info.is_file or f.base_name.endswith((".arff", ".txt"))))


def header(path: str, name: str) -> tuple[list[Attribute], int]:
    """The attributes of a file, and the byte at which its rows begin."""
    system, _ = opened(path)
    found, at = [], 0
    with system.open_input_stream(name) as raw:
        held = b""
        while True:
            more = raw.read(1 << 16)
            held += more
            while (end := held.find(b"\n")) >= 0 or (not more and held):
                line, held = (held[: end + 1], held[end + 1 :]) if end >= 0 else (held, b"")
                at += len(line)
                text = line.decode("utf-8", "replace").strip()
                if text.lower().startswith("@attribute"):
                    found.append(attribute(text))
                elif text.lower().startswith("@data"):
                    return found, at
            if not more:
                raise ValueError(f"{name}: a header without @data")


def lines(raw, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin from `start` to before `end`."""
    raw.seek(start)
    at, held = start, b""
    while at < end:
        more = raw.read(1 << 20)
        held += more
        pieces = held.split(b"\n")
        held = pieces.pop()
        for line in pieces:
            if at >= end:
                return
            yield at, line
            at += len(line) + 1
        if not more:
            if held and at < end:
                yield at, held
            return


def first_line(raw, start: int, least: int) -> int:
    """Where the first line begins at or after `start` (rows begin at `least`)."""
    if start <= least:
        return least
    raw.seek(start - 1)
    at = start - 1
    while more := raw.read(1 << 16):
        if (end := more.find(b"\n")) >= 0:
            return at + end + 1
        at += len(more)
    return at


class _Rows:
    """Turns lines into columns."""

    def __init__(self, attributes: list[Attribute], mode: str):
        self.attributes, self.mode = attributes, mode
        self.known = [set(a.labels) for a in attributes]

    def value(self, k: int, raw: str) -> tuple[object, str | None]:
        """The value of a field, and what is wrong with it."""
        a = self.attributes[k]
        if raw == "?":
            return None, None
        if raw == "":
            return None, f"{a.name} is empty"
        text = bare(raw)
        if a.kind == "numeric":
            try:
                return float(text), None
            except ValueError:
                return None, f"{a.name} is no number"
        if a.kind == "nominal":
            return (text, None) if text in self.known[k] else (None, f"{a.name} has no such label")
        if a.kind == "date":
            try:
                return datetime.datetime.strptime(text, a.pattern), None
            except ValueError:
                return None, f"{a.name} is no such date"
        return text, None

    def sparse(self, text: str) -> tuple[list, list[str]]:
        out: list = [0.0 if a.kind == "numeric" else a.labels[0] if a.labels else None for a in self.attributes]
        wrong = []
        inner = text[1:-1].strip()
        for pair in fields_of_pairs(inner) if inner else []:
            index, _, raw = pair.partition(" ")
            if not index.isdigit() or int(index) >= len(out):
                return [None] * len(out), [f"no attribute {index!r}"]
            out[int(index)], problem = self.value(int(index), raw.strip())
            wrong += [problem] if problem else []
        return out, wrong

    def row(self, text: str) -> tuple[list, list[str]]:
        n = len(self.attributes)
        if text.startswith("{"):
            return self.sparse(text) if text.endswith("}") else ([None] * n, ["a brace that does not close"])
        raw = fields(text)
        if len(raw) != n:
            return [None] * n, [f"{len(raw)} fields instead of {n}"]
        pairs = [self.value(k, r) for k, r in enumerate(raw)]
        return [v for v, _ in pairs], [p for _, p in pairs if p]

    def batches(self, name: str, found: Iterator[tuple[int, bytes]], order: list[int], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def told():
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for offset, line in found:
            text = line.decode("utf-8", "replace").strip()
            if not text or text.startswith(("%", "@")):
                continue
            values, wrong = self.row(text)
            if wrong and self.mode == "failfast":
                raise ValueError(f"{name} at {offset}: {wrong[0]}")
            if wrong and self.mode == "drop":
                continue
            held.append([*(values[k] for k in order), "; ".join(wrong) or None, name, offset])
            if len(held) == BATCH:
                yield told()
                held = []
        if held:
            yield told()


def fields_of_pairs(inner: str) -> list[str]:
    """The pairs of a sparse row; a value's quotes stand after its index."""
    out, at = [], 0
    for m in re.finditer(r"\s*(\d+\s+(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,]*)|[^,]*)\s*(?:,|$)", inner):
        if m.start() < at or m.start() == len(inner) and out:
            continue
        out.append(m[1].strip())
        at = m.end()
    return out


class _Plan:
    """What batch and streaming readers share: schema, ranges, rows of a range."""

    def __init__(self, options: dict, attributes: list[Attribute], order: list[int]):
        self.path, self.attributes, self.order = options["path"], attributes, order
        self.mode, self.size = options.get("mode", "permissive"), int(options.get("range_bytes", RANGE_BYTES))
        if self.mode not in ("permissive", "drop", "failfast"):
            raise ValueError(f"no mode {self.mode!r}")

    def ranges(self, chosen: list[tuple[int, str, int]]) -> list[InputPartition]:
        packs, held = [[]], 0
        for _, name, size in chosen:
            found, begin = header(self.path, name)
            if found != self.attributes:
                raise ValueError(f"{name} has other attributes than the first file")
            for start in range(0, max(size, 1), self.size):
                end = min(start + self.size, size)
                if packs[-1] and held + end - start > self.size:
                    packs.append([])
                    held = 0
                packs[-1].append((name, start, end, begin))
                held += end - start
        return [InputPartition(p) for p in packs if p] or [InputPartition([])]

    def rows(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"numeric": pa.float64(), "date": pa.timestamp("us")}
        arrow = pa.schema([*((self.attributes[k].name, kinds.get(self.attributes[k].kind, pa.string())) for k in self.order), ("_problem", pa.string()), ("_file", pa.string()), ("_offset", pa.int64())])
        made = _Rows(self.attributes, self.mode)
        system, _ = opened(self.path)
        for name, start, end, begin in partition.value:
            if end <= begin:
                continue
            with system.open_input_file(name) as raw:
                yield from made.batches(name, lines(raw, first_line(raw, start, begin), end), self.order, arrow)


class Reader(DataSourceReader):
    def __init__(self, plan: _Plan):
        self.plan = plan

    def partitions(self):
        return self.plan.ranges(sorted(files(self.plan.path), key=lambda f: f[1]))

    def read(self, partition):
        yield from self.plan.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are the time and name of the last file that was read."""

    def __init__(self, plan: _Plan):
        self.plan = plan

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        found = files(self.plan.path)
        return {"time": found[-1][0], "file": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = ((o["time"], o["file"]) for o in (start, end))
        return self.plan.ranges([f for f in files(self.plan.path) if low < f[:2] <= high])

    def read(self, partition):
        yield from self.plan.rows(partition)


class Arff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arff"

    def _attributes(self) -> tuple[list[Attribute], list[int]]:
        found = sorted(files(self.options["path"]), key=lambda f: f[1])
        if not found:
            raise ValueError(f"no ARFF files in {self.options['path']}")
        attributes, _ = header(self.options["path"], found[0][1])
        at, order = int(self.options.get("class_index", -1)), list(range(len(attributes)))
        if at > len(order):
            raise ValueError(f"no attribute {at}")
        if at > 0:
            order.append(order.pop(at - 1))
        return attributes, order

    def schema(self) -> StructType:
        attributes, order = self._attributes()
        kinds = {"numeric": DoubleType(), "date": TimestampNTZType()}
        told = [StructField(a.name, kinds.get(a.kind, StringType()), True, {"kind": a.kind, **({"labels": list(a.labels)} if a.kind == "nominal" else {})}) for a in (attributes[k] for k in order)]
        return StructType([*told, StructField("_problem", StringType()), StructField("_file", StringType()), StructField("_offset", LongType())])

    def reader(self, schema: StructType) -> Reader:
        return Reader(_Plan(self.options, *self._attributes()))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(_Plan(self.options, *self._attributes()))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Arff)
