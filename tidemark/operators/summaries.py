"""Quantile summaries that merge, one a class of each numeric attribute, and the cut points that they suggest.

A summary is a sorted list of values with bounds on how many rows lie at or below each, and how many are known to equal it.
Partitions summarise their rows on their own; summaries are merged in rounds of `fan_in`, so no task holds those of all
partitions.  Merging keeps the bounds; pruning to `size` values adds rows / (2 size) to the error of a rank.  As many
values are kept between rounds as there are rounds, so that the whole error stays below rows / size.  An attribute of fewer
values than are kept is counted exactly.

Missing values (null, NaN) and rows without a class are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import kept

from .hoeffding import info_gain

#: Values that a partition holds of one attribute and class before it summarises them.
HELD = 1 << 18
FAN_IN = 32


class Summary:
    def __init__(self, values: np.ndarray, low: np.ndarray, high: np.ndarray, equal: np.ndarray):
        self.values, self.low, self.high, self.equal = values, low, high, equal

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        v, n = np.unique(values, return_counts=True)
        up_to = n.cumsum()
        return cls(v, up_to, up_to.copy(), n)

    @property
    def rows(self) -> int:
        return int(self.high[-1]) if len(self.values) else 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many rows lie at or below each value, at least and at most."""
        at = np.searchsorted(self.values, x, "right")
        low = np.where(at > 0, self.low[np.maximum(at - 1, 0)], 0)
        same = (at > 0) & (self.values[np.maximum(at - 1, 0)] == x)
        after = np.minimum(at, len(self.values) - 1)
        high = np.where(at < len(self.values), self.high[after] - self.equal[after], self.rows)
        return low, np.where(same, self.high[np.maximum(at - 1, 0)], high)

    def merged(self, other: Summary) -> Summary:
        if not len(self.values) or not len(other.values):
            return self if len(self.values) else other
        v = np.union1d(self.values, other.values)
        (a, b), (c, d) = self.bounds(v), other.bounds(v)
        equal = np.zeros(len(v), np.int64)
        for s in (self, other):
            equal[np.searchsorted(v, s.values)] += s.equal
        return Summary(v, a + c, b + d, equal)

    def pruned(self, size: int) -> Summary:
        """At most `size` + 1 values: the first, the last, and those nearest to equally spaced ranks."""
        if len(self.values) <= size + 1:
            return self
        wanted = np.linspace(self.low[0], self.rows, size + 1)
        middle = (self.low + self.high) / 2
        at = np.clip(np.searchsorted(middle, wanted), 1, len(middle) - 1)
        at = np.unique(np.concatenate([[0, len(middle) - 1], np.where(wanted - middle[at - 1] <= middle[at] - wanted, at - 1, at)]))
        at = at if len(at) <= size + 1 else np.delete(at, 1)
        return Summary(self.values[at], self.low[at], self.high[at], self.equal[at])

    def error(self) -> float:
        """By how many rows the count up to any value can be wrong, at most."""
        between = (self.high[1:] - self.equal[1:] - self.low[:-1]) / 2
        return float(max(between.max(initial=0), ((self.high - self.low) / 2).max(initial=0)))

    def below(self, x: np.ndarray) -> np.ndarray:
        """The count at or below each value: the middle of its bounds."""
        low, high = self.bounds(x)
        return (low + high) / 2

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        """The least known values with at least these shares of the rows at or below them."""
        at = np.searchsorted((self.low + self.high) / 2, shares * self.rows - 1e-9)
        return self.values[np.minimum(at, len(self.values) - 1)]


SCHEMA = "attribute string, class string, part int, vs array<double>, low array<long>, high array<long>, equal array<long>"


def _told(found: list[tuple[str, str, int, Summary]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), *[pa.list_(pa.int64())] * 3]
    columns = list(zip(*((a, c, p, *(x.tolist() for x in (s.values, s.low, s.high, s.equal))) for a, c, p, s in found))) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def _read(rows: list[dict]) -> list[Summary]:
    return [Summary(np.array(r["vs"], float), *(np.array(r[c], np.int64) for c in ("low", "high", "equal"))) for r in rows]


def summarised(df: DataFrame, attributes: list[str], y: str, size: int = 200, fan_in: int = FAN_IN) -> DataFrame:
    """attribute, class, and the parts of one summary each (see SCHEMA)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes)))
    tall = df.where(F.col(y).isNotNull()).select(F.col(y).cast("string").alias("class"), F.spark_partition_id().alias("part"), pairs.alias("p")).select("p.attribute", "class", "part", "p.v").where("v is not null and not isnan(v)")
    parts = max(1, df.rdd.getNumPartitions())
    rounds = max(1, math.ceil(math.log(parts, fan_in))) if parts > 1 else 0
    size = size * (rounds + 1)

    def own(batches):
        held: dict[tuple[str, str], list] = {}
        done: dict[tuple[str, str], Summary] = {}
        part = 0

        def summed(key):
            got = Summary.of(np.concatenate(held.pop(key)))
            done[key] = (done[key].merged(got) if key in done else got).pruned(4 * size)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            keys = [batch.column(k).dictionary_encode() for k in (0, 1)]
            a, c = (k.indices.to_numpy() for k in keys)
            v = batch.column(3).to_numpy()
            for i in np.unique(a):
                for j in np.unique(c[a == i]):
                    key = (keys[0].dictionary[i].as_py(), keys[1].dictionary[j].as_py())
                    held.setdefault(key, []).append(v[(a == i) & (c == j)])
                    if sum(map(len, held[key])) >= HELD:
                        summed(key)
        for key in list(held):
            summed(key)
        yield _told([(a, c, part, s.pruned(size)) for (a, c), s in done.items()])

    def joined(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part").to_pylist()
        out, *rest = _read(rows)
        for s in rest:
            out = out.merged(s)
        return pa.Table.from_batches([_told([(rows[0]["attribute"], rows[0]["class"], rows[0]["part"] // fan_in, out.pruned(size))])])

    found = tall.mapInArrow(own, SCHEMA)
    for _ in range(rounds):
        found = found.withColumn("_into", F.floor(F.col("part") / fan_in)).groupBy("attribute", "class", "_into").applyInArrow(lambda t: joined(t.drop_columns(["_into"])), SCHEMA)
    return kept(found, "summaries")


def class_cuts(summaries: DataFrame, points: int = 10) -> DataFrame:
    """attribute, cut, class, below, above: at the quantiles of every class of an attribute, the rows of each class on either side.

    Summaries are as many as attributes and classes, and are put together on the driver.
    """
    by: dict[str, dict[str, Summary]] = {}
    for r in summaries.collect():
        by.setdefault(r.attribute, {})[r["class"]] = _read([r.asDict()])[0]
    shares, rows = np.arange(1, points + 1) / (points + 1), []
    for a, classes in by.items():
        cuts = np.unique(np.concatenate([s.quantiles(shares) for s in classes.values()]))
        for c, s in classes.items():
            rows += [(a, float(cut), c, float(n), float(s.rows - n)) for cut, n in zip(cuts, s.below(cuts))]
    return summaries.sparkSession.createDataFrame(rows, "attribute string, cut double, class string, below double, above double")


def best_cuts(cuts: DataFrame) -> dict[str, tuple[float, float]]:
    """attribute -> (cut, information gain) of the best cut."""
    found: dict[str, dict[float, list]] = {}
    for r in cuts.collect():
        found.setdefault(r.attribute, {}).setdefault(r.cut, []).append((r["class"], r.below, r.above))
    out = {}
    for a, by in found.items():
        merits = {cut: info_gain(np.array([b + n for _, b, n in sorted(at)]), [np.array([v[k] for v in sorted(at)]) for k in (1, 2)]) for cut, at in by.items()}
        cut = min(merits, key=lambda c: (-merits[c], c))
        out[a] = (cut, merits[cut])
    return out
