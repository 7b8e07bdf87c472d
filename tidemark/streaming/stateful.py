"""Streaming twins: the same steps as in batch, with their state kept by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.drift import Detector, _Kept


def detect(stream: DataFrame, key: str, order: str, x: str, detector: Detector) -> DataFrame:
    """The streaming form of `operators.drift.detect`; rows are put in order within a micro-batch.

    A row that comes after a later one has been folded in is not folded out of order: it is returned
    with `late` set and null results.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {order} long, change boolean, warning boolean, estimate double, late boolean"

    def fold(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        held, change, last = json.loads(state.get[0]) if state.exists else [list(detector.init), False, None]
        out = []
        for at, value in zip(rows[order].tolist(), rows["x"].tolist()):
            if last is not None and at <= last:
                out.append((group[0], at, None, None, None, True))
                continue
            if change and not isinstance(detector, _Kept):
                held = list(detector.init)
            held, change, warning, estimate = detector.step(held, value)
            last = at
            out.append((group[0], at, bool(change), bool(warning), float(estimate), False))
        state.update((json.dumps([held, bool(change), last]),))
        yield pd.DataFrame(out, columns=[key, order, "change", "warning", "estimate", "late"])

    rows = stream.select(key, F.col(order).cast("long").alias(order), F.col(x).cast("double").alias("x")).where("x is not null")
    return rows.groupBy(key).applyInPandasWithState(fold, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def windowed_accuracy(stream: DataFrame, key: str, order: str, y: str, pred: str, width: int = 1000) -> DataFrame:
    """Accuracy over the last `width` rows of each key, from a ring buffer in the key's state.

    As in `detect`, a row that comes after a later one is returned with `late` set and a null result.
    """
    kind = stream.schema[key].dataType.simpleString()

    def fold(group, frames, state):
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        ring, last = json.loads(state.get[0]) if state.exists else ([], None)
        out = []
        for at, hit in zip(rows[order].tolist(), (rows[y] == rows[pred]).tolist()):
            if last is not None and at <= last:
                out.append((group[0], at, None, True))
                continue
            ring = [*ring[-(width - 1) :], int(hit)] if width > 1 else [int(hit)]
            last = at
            out.append((group[0], at, sum(ring) / len(ring), False))
        state.update((json.dumps([ring, last]),))
        yield pd.DataFrame(out, columns=[key, order, "accuracy", "late"])

    rows = stream.select(key, F.col(order).cast("long").alias(order), y, pred)
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {order} long, accuracy double, late boolean", "ring string", "append", GroupStateTimeout.NoTimeout)


def micro_batches(stream: DataFrame, learn: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a model's `learn(batch, number)` for every micro-batch, at least once.

    After a restart the last batch may come again under its number.  A model that must learn it once only has to
    be stored together with that number, and to leave out numbers it has.
    """
    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dump_curve(curve: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Append a learning curve as CSV with a header; absent values and NaN are written as `?`.

    Only the curve's own rows meet in one task, not those it is made of.
    """
    shown = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("string")), F.lit("?")).alias((names or {}).get(c, c)) for c in curve.columns]
    curve.select(*shown).repartition(1).write.mode("append").option("header", True).csv(path)
