"""Per-key detectors and accuracies as streams with typed state, by Spark's arbitrary stateful processing.

Keys are dealt to SLOTS groups, as each call of Python for a group costs as much as hundreds of rows.  A group's state is a map by key, to where the
key's order stands, its timer, what a detector keeps and the buckets of its window; it has columns, so it can be read by the state
data source.  Where keys that stay idle are dropped, a timer is a group's, so each key is a group by itself.  The state store must be RocksDB: run queries within `rocksdb(spark)`, or set it for the cluster.

A micro-batch should be bounded where the stream is read (`maxFilesPerTrigger`, `maxBytesPerTrigger`, `maxOffsetsPerTrigger`): of a group
its rows of one micro-batch are held, as three values each, to be put in order.  A row that comes after a later one has
been folded in is not folded out of order: it is returned with `late` set and null results.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.drift import Detector, _Kept

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Groups of keys, and rows of a group that are returned at a time.
SLOTS, CHUNK = 1024, 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start in here keep their state in RocksDB; the session's option is as before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def flat(state: list) -> tuple[list[float], list[tuple[int, float, float]]]:
    """A detector's state as numbers and buckets (level, sum, spread); buckets are those of the lists of lists in it."""
    numbers, buckets = [], []
    for part in state:
        if isinstance(part, list):
            buckets += [(level, float(s), float(v)) for level, held in enumerate(part) for s, v in held]
        else:
            numbers.append(float(part))
    return numbers, buckets


def deep(numbers: list[float], buckets: list[tuple[int, float, float]], like: list) -> list:
    """`flat` undone for a detector whose first state is `like`."""
    out, rest = [], list(numbers)
    for part in like:
        if not isinstance(part, list):
            v = rest.pop(0)
            out.append(int(v) if isinstance(part, int) else v)
            continue
        levels: list[list] = [[] for _ in range(max((b[0] for b in buckets), default=-1) + 1)]
        for level, s, v in buckets:
            levels[level].append([s, v])
        out.append(levels)
    return out


class _Ordered(StatefulProcessor):
    """Rows of a group of keys, each key's in order, with what is late told apart, and a timer for an idle key."""

    def __init__(self, key: str, kind: str, order: str, columns: list[str], idle: int | None, event_time: bool):
        self.key, self.kind, self.order, self.columns, self.idle, self.event_time = key, kind, order, columns, idle, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", f"key {self.kind}", f"at long, timer long, {self.schema}")

    def told(self, key):
        """A key as it was before pandas turned whole numbers beside null into floats."""
        if key != key:
            return None
        return int(key) if isinstance(key, float) and self.kind in ("tinyint", "smallint", "int", "bigint") else key

    def handleInputRows(self, group, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [[f[c].to_numpy() for c in (self.key, self.order, *self.columns)] for f in rows]
        keys, order, *values = (h[0] if len(h) == 1 else np.concatenate(h) for h in zip(*held))
        codes, names = pd.factorize(keys, use_na_sentinel=False)
        by = np.lexsort((order, codes))
        ends = np.cumsum(np.bincount(codes, minlength=len(names)))
        out = []
        for key, low, high in zip(map(self.told, names.tolist()), [0, *ends[:-1].tolist()], ends.tolist()):
            # one call reads a key's state, and one writes it
            last, timer, *kept = self.state.getValue((key,)) or (None, None)
            fold = self.folding(*kept)
            for k in range(low, high, CHUNK):
                own = by[k : min(k + CHUNK, high)]
                for at, *row in zip(order[own].tolist(), *(v[own].tolist() for v in values)):
                    if last is not None and at <= last:
                        out.append((key, at, *[None] * len(self.results), True))
                        continue
                    last = at
                    out.append((key, at, *fold(*row), False))
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=[self.key, self.order, *self.results, "late"])
                    out = []
            if self.idle is not None:
                # event time stands still within a micro-batch: the latest row's own time says how long it may rest
                now = max(timerValues.getCurrentWatermarkInMs(), int(last)) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
                if timer is not None:
                    self.handle.deleteTimer(timer)
                timer = now + self.idle
                self.handle.registerTimer(timer)
            self.state.updateValue((key,), (last, timer, *self.kept()))
        yield pd.DataFrame(out, columns=[self.key, self.order, *self.results, "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[self.key, self.order, *self.results, "late"])

    def close(self) -> None:
        pass


class Detecting(_Ordered):
    results, schema = ["change", "warning", "estimate"], "numbers array<double>, change boolean, buckets array<struct<level int, sum double, spread double>>"

    def __init__(self, key: str, kind: str, order: str, detector: Detector, idle: int | None = None, event_time: bool = False):
        super().__init__(key, kind, order, ["x"], idle, event_time)
        self.detector = detector

    def folding(self, numbers=None, change=False, buckets=()):
        self.held = list(self.detector.init) if numbers is None else deep(list(numbers), [tuple(b) for b in buckets], self.detector.init)
        self.change = change

        def fold(x):
            if self.change and not isinstance(self.detector, _Kept):
                self.held = list(self.detector.init)
            self.held, change, warning, estimate = self.detector.step(self.held, x)
            self.change = bool(change)
            return self.change, bool(warning), float(estimate)

        return fold

    def kept(self) -> tuple:
        numbers, buckets = flat(self.held)
        return numbers, self.change, buckets


class Accuracy(_Ordered):
    """The last `width` hits in a ring, with their sum, so that a row costs the same whatever the width."""

    results, schema = ["accuracy"], "hits array<int>, next int, total int"

    def __init__(self, key: str, kind: str, order: str, width: int, idle: int | None = None, event_time: bool = False):
        super().__init__(key, kind, order, ["hit"], idle, event_time)
        self.width = width

    def folding(self, hits=(), at=0, total=0):
        self.hits, self.at, self.total = list(hits), at, total

        def fold(hit):
            hit = int(hit)
            if len(self.hits) < self.width:
                self.hits.append(hit)
            else:
                self.total -= self.hits[self.at]
                self.hits[self.at] = hit
                self.at = (self.at + 1) % self.width
            self.total += hit
            return (self.total / len(self.hits),)

        return fold

    def kept(self) -> tuple:
        return self.hits, self.at, self.total


def _run(rows: DataFrame, key: str, processor: _Ordered, schema: str, idle: int | None, event_time: str | None) -> DataFrame:
    mode = "None" if idle is None else "EventTime" if event_time else "ProcessingTime"
    group = F.pmod(F.xxhash64(key), F.lit(SLOTS)) if idle is None else F.col(key)
    return rows.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(processor, schema, "append", mode)


def detect(stream: DataFrame, key: str, order: str, x: str, detector: Detector, idle: int | None = None, event_time: str | None = None) -> DataFrame:
    """key, order, change, warning, estimate, late: the streaming form of `operators.drift.detect`.

    A key that has been idle for `idle` milliseconds (of processing time, or of `event_time`, which has a watermark; the order
    must then be that time in milliseconds) is forgotten.
    """
    kind = stream.schema[key].dataType.simpleString()
    more = [event_time] if event_time and event_time != order else []
    rows = stream.select(key, F.col(order).cast("long").alias(order), F.col(x).cast("double").alias("x"), *more).where("x is not null")
    return _run(rows, key, Detecting(key, kind, order, detector, idle, bool(event_time)), f"{key} {kind}, {order} long, change boolean, warning boolean, estimate double, late boolean", idle, event_time)


def windowed_accuracy(stream: DataFrame, key: str, order: str, y: str, pred: str, width: int = 1000, idle: int | None = None, event_time: str | None = None) -> DataFrame:
    """key, order, accuracy over the last `width` rows of the key, late."""
    kind = stream.schema[key].dataType.simpleString()
    more = [event_time] if event_time and event_time != order else []
    rows = stream.select(key, F.col(order).cast("long").alias(order), F.col(y).eqNullSafe(F.col(pred)).cast("int").alias("hit"), *more)
    return _run(rows, key, Accuracy(key, kind, order, width, idle, bool(event_time)), f"{key} {kind}, {order} long, accuracy double, late boolean", idle, event_time)
