"""Change detectors: one pure step per detector, folded over each key in order.

A step takes (state, x) and gives (state, change, warning, estimate); states are plain lists, so the
same step runs in a batch fold and in streaming state.  After a change the next step starts afresh.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 30
BIG = 1.7976931348623157e308

Step = Callable[[list, float], tuple[list, bool, bool, float]]


class Detector:
    def __init__(self, init: list, step: Step):
        self.init, self.step = init, step

    def run(self, xs) -> Iterator[tuple[bool, bool, float]]:
        state, change = list(self.init), False
        for x in xs:
            state, change, warning, estimate = self.step(list(self.init) if change else state, x)
            yield change, warning, estimate


def ddm(warn: float = 2.0, out: float = 3.0) -> Detector:
    """Error rate against its best: state n, p, least p, least s, least p + s."""

    def step(state, x):
        n, p, pmin, smin, best = state
        p += (x - p) / n
        s = math.sqrt(p * (1 - p) / n)
        n += 1
        if n < LEAST:
            return [n, p, pmin, smin, best], False, False, p
        if p + s <= best:
            pmin, smin, best = p, s, p + s
        change = n > LEAST and p + s > pmin + out * smin
        return [n, p, pmin, smin, best], change, not change and p + s > pmin + warn * smin, p

    return Detector([1.0, 1.0, BIG, BIG, BIG], step)


def eddm(out: float = 0.9, warn: float = 0.95, least: float = 30) -> Detector:
    """Distance between errors: state n, errors, place of the last, mean, squares, largest mean + 2 sd."""

    def step(state, x):
        n, errors, last, mean, squares, top = state
        n += 1
        change = warning = False
        if x > 0:
            errors += 1
            gap, last = n - 1 - last, n - 1
            before = mean
            mean += (gap - mean) / errors
            squares += (gap - mean) * (gap - before)
            high = mean + 2 * math.sqrt(squares / errors)
            if high > top:
                top = high if n > LEAST else top
            else:
                ready = n > LEAST and errors > least
                change = ready and high / top < out
                warning = ready and not change and high / top < warn
        return [n, errors, last, mean, squares, top], change, warning, mean

    return Detector([1.0, 0.0, 0.0, 0.0, 0.0, 0.0], step)


def _mean_sum(move: Callable[[float, float, float], float], bar: float) -> Detector:
    """Detectors that watch one sum beside the running mean: state n, mean, sum."""

    def step(state, x):
        n, mean, total = state
        mean += (x - mean) / n
        total = move(total, x, mean)
        n += 1
        return [n, mean, total], n >= LEAST and total > bar, False, mean

    return Detector([1.0, 0.0, 0.0], step)


def page_hinkley(delta: float = 0.005, bar: float = 50.0, alpha: float = 0.9999) -> Detector:
    return _mean_sum(lambda s, x, m: alpha * s + (x - m - delta), bar)


def cusum(delta: float = 0.005, bar: float = 50.0) -> Detector:
    return _mean_sum(lambda s, x, m: max(0.0, s + x - m - delta), bar)


def geometric(alpha: float = 0.99, bar: float = 1.0) -> Detector:
    return _mean_sum(lambda s, x, m: alpha * s + (1 - alpha) * (x - m), bar)


#: The control limit of the chart as a polynomial of the error rate (powers 0, 1, 3, 5, 7).
EWMA_LIMIT = (3.97, -6.56, 48.73, -330.13, 848.18)


def ewma(rate: float = 0.2) -> Detector:
    """Control chart: state n, sum, chart value, (1 - rate)^(2n)."""

    def step(state, x):
        n, total, z, left = state
        total += x
        p = total / n
        left *= (1 - rate) * (1 - rate)
        s = math.sqrt(p * (1 - p) * rate * (1 - left) / (2 - rate))
        n += 1
        z += rate * (x - z)
        p2 = p * p
        limit = EWMA_LIMIT[0] + p * (EWMA_LIMIT[1] + p2 * (EWMA_LIMIT[2] + p2 * (EWMA_LIMIT[3] + p2 * EWMA_LIMIT[4])))
        change = n >= LEAST and z > p + limit * s
        return [n, total, z, left], change, n >= LEAST and not change and z > p + 0.5 * limit * s, p

    return Detector([1.0, 0.0, 0.0, 1.0], step)


#: How far a share of errors must lie above the faded mean of those before it, and how that mean fades.
RISE, FADE = 0.1, 0.8


def rising(rise: float = RISE, fade: float = FADE) -> Detector:
    """For shares of errors by batch, of which there are few: one that lies far above the faded mean of the others.  State n, mean."""

    def step(state, x):
        n, mean = state
        change = n > 0 and x > mean + rise
        return [fade * n + 1, (fade * n * mean + x) / (fade * n + 1)], change, False, x

    return Detector([0.0, 0.0], step)


def ph_test(delta: float = 0.005, bar: float = 35.0, fade: float = 1.0) -> Detector:
    """Cumulated deviation above its minimum; `fade` below 1 ages the counts.  State n, sum, steps, total, least."""

    def step(state, x):
        n, total, steps, moved, least = state
        n, total, steps = 1 + fade * n, abs(x) + fade * total, steps + 1
        moved += abs(x) - total / n - delta
        least = min(least, moved)
        return [n, total, steps, moved, least], steps > LEAST and moved - least > bar, False, total / n

    return Detector([0.0, 0.0, 0.0, 0.0, BIG], step)


def adwin(delta: float = 0.002, buckets: int = 5, clock: int = 32, least_width: int = 10, least_part: int = 5) -> Detector:
    """Adaptive window over an exponential histogram.

    State: steps since a check, then per level a list of [sum, variance * n] buckets of 2^level rows,
    the newest first.  Every `clock` steps the oldest buckets go while any cut of the window parts two
    means by more than the bound.
    """

    def merged(n, a, b):
        return [a[0] + b[0], a[1] + b[1] + (a[0] - b[0]) ** 2 / (2 * n)]

    def totals(levels):
        n = s = v = 0.0
        for k, level in enumerate(levels):
            for b in level:
                m = 2.0**k
                if n:
                    v += b[1] + n * m * (s / n - b[0] / m) ** 2 / (n + m)
                else:
                    v = b[1]
                n, s = n + m, s + b[0]
        return n, s, v

    def step(state, x):
        steps, levels = state[0] + 1, [list(level) for level in state[1]] or [[]]
        levels[0].insert(0, [x, 0.0])
        k = 0
        while k < len(levels) and len(levels[k]) > buckets:
            if k + 1 == len(levels):
                levels.append([])
            b, a = levels[k].pop(), levels[k].pop()
            levels[k + 1].insert(0, merged(2.0**k, a, b))
            k += 1
        change = False
        n, s, v = totals(levels)
        if steps % clock == 0 and n > least_width:
            again = True
            while again and n > least_width:
                again = False
                n0, s0, n1, s1 = 0.0, 0.0, n, s
                for k in range(len(levels) - 1, -1, -1):
                    for b in reversed(levels[k]):
                        n0, s0, n1, s1 = n0 + 2.0**k, s0 + b[0], n1 - 2.0**k, s1 - b[0]
                        if n1 < least_part + 1:
                            break
                        if n0 >= least_part + 1:
                            log = math.log(2 * math.log(n) / delta)
                            m = 1 / (n0 - least_part + 1) + 1 / (n1 - least_part + 1)
                            bound = math.sqrt(2 * m * v / n * log) + 2 / 3 * log * m
                            if abs(s0 / n0 - s1 / n1) > bound:
                                again = change = True
                                break
                    if again:
                        break
                if again:
                    while levels and not levels[-1]:
                        levels.pop()
                    levels[-1].pop()
                    while len(levels) > 1 and not levels[-1]:
                        levels.pop()
                    n, s, v = totals(levels)
        return [steps, levels], change, False, s / n if n else 0.0

    return _Kept([0, []], step)


class _Kept(Detector):
    """A detector that forgets by itself: a change does not reset it."""

    def run(self, xs):
        state = list(self.init)
        for x in xs:
            state, change, warning, estimate = self.step(state, x)
            yield change, warning, estimate


def detect(df: DataFrame, key: str, order: str, x: str, detector: Detector) -> DataFrame:
    """Per row: key, order, change, warning, estimate.

    Keys are dealt by hash and sorted within partitions; rows stream through the fold one batch at a
    time, so a key with very many rows needs no more memory than its state.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, order, F.col(x).cast("double").alias("x")).where("x is not null")
    dealt = rows.repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        last, state, change, first = None, None, False, True
        for batch in batches:
            out: list[list] = [[], [], []]
            for k, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if first or k != last or (change and not isinstance(detector, _Kept)):
                    state = list(detector.init)
                last, first = k, False
                state, change, warning, estimate = detector.step(state, value)
                for column, v in zip(out, (bool(change), bool(warning), estimate)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.bool_()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.float64())], [key, order, "change", "warning", "estimate"])

    return dealt.mapInArrow(run, f"{key} {kind}, {order} long, change boolean, warning boolean, estimate double")


def summary(found: DataFrame, key: str, order: str) -> DataFrame:
    return found.groupBy(key).agg(F.count(F.when(F.col("change"), 1)).alias("changes"), F.count(F.when(F.col("warning"), 1)).alias("warnings"), F.max_by("estimate", order).alias("estimate"))
