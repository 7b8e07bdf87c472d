"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by log-count ratios.

Tokens are the shapes of white-space delimited chunks (letter case, digits, the signs around them,
whether the chunk repeats the one before), so that the model carries over to unseen words.  The
indicators are: an n-gram of shapes (n = 1, 2, 3) occurs; it makes up at least 1/2^k of all n-grams
of the text (k = 1..6); and marks of length.  Each is scaled by its class log-count ratio, and a
hinge-loss model is fitted to the scaled indicators by dual coordinate descent.  The score is the
margin through a logistic curve fitted on the same labelled rows.

The model is fitted on at most `max_train` labelled rows, chosen by a hash of doc_id; every text is
scored whole.  Of several texts of a doc_id one is trained on.  Defined results: a null text is the empty text, which has a score of its own; rows
without a doc_id, labels other than 0 and 1 and null labels are not trained on; repeated rows are
scored each; without rows of both classes every score is the share of label 1 (1.0 if no labels).
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkCache, keeps_caches, short_batches, table, turn_of

BUCKETS = 1 << 15
MAX_TRAIN = 8000
THRESHOLD = 0.7
#: Longer chunks are cut into tokens of that many characters, each with its shape.
PIECE = 64
#: Codes below REPEAT are shapes; a chunk equal to the one before gets REPEAT added.
REPEAT = 1 << 11

class _Kinds(dict):
    """A, a or 0 for letters and digits, ASCII signs as they are, ? for the rest; by code point."""

    def __missing__(self, point):
        c = chr(point)
        self[point] = k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if point < 127 else "?"
        return k


_kinds, _run, _signs = _Kinds(), re.compile(r"([a0])\1+"), re.compile(r"(.)\1\1+")


def shape(chunk: str) -> str:
    """Case of the letters, digits, signs as they are; runs are cut to one letter or digit, or two capitals or signs."""
    out = _signs.sub(r"\1\1", _run.sub(r"\1", chunk.translate(_kinds)))
    return out if len(chunk) < 12 else f"{out}~{min(len(chunk) // 12, 5)}"


_codes = ChunkCache(lambda chunk: zlib.crc32(shape(chunk).encode()) & (REPEAT - 1))
keeps_caches("quality", _codes.clear)


def features(text: str) -> np.ndarray:
    """Sorted ids of the indicators that hold for a text."""
    chunks = text.split()
    if max(map(len, chunks), default=0) > PIECE:
        chunks = [c[i : i + PIECE] for c in chunks for i in range(0, len(c), PIECE)]
    n = len(chunks)
    out = [np.array([BUCKETS - 1 - min(int(np.log2(n + 1)), 16)])]
    if n:
        codes = np.fromiter(map(_codes.__getitem__, chunks), np.int64, n)
        codes[1:] += REPEAT * np.fromiter(map(eq, chunks, chunks[1:]), np.int64, n - 1)
        grams = codes
        for k in range(1, min(n, 3) + 1):
            if k > 1:
                grams = (grams[:-1] * 1_000_003 + codes[k - 1 :]) & 0x7FFFFFFF
            ids, times = np.unique(grams, return_counts=True)
            out.append(_bucket(ids, k, 0))
            often = times * 64 >= len(grams)
            ids, share = ids[often], len(grams) / times[often]
            out += [_bucket(ids[share <= 2**level], k, level) for level in range(1, 7)]
    return np.unique(np.concatenate(out))


def _bucket(grams: np.ndarray, k: int, level: int) -> np.ndarray:
    return ((grams * 2_654_435_761 + (k * 7 + level) * 40_503) >> 7) % (BUCKETS - 32)


def sample(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """At most `max_train` labelled training documents, one row a doc_id: doc_id, text, y.

    Of several texts of a doc_id the one of the least hash counts, and repeated rows count once, so that the rows are
    bounded as the ids are; these are few enough to be sent to every task.
    """
    y = F.col(label).cast("int")
    key = F.col("doc_id").cast("string")
    rows = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(key) % 4 != 2)).select("doc_id", y.alias("y"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_train)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 30, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights (the log-count ratios multiplied in) and bias of the hinge-loss model."""
    pos, neg = np.full(size, alpha), np.full(size, alpha)
    for ids, label in zip(rows, y):
        (pos if label > 0 else neg)[ids] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    values = [ratio[ids] for ids in rows]
    # each class weighs the same as a whole
    caps = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    norms = np.array([v @ v + 1.0 for v in values])
    weights, bias, dual = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ids, v = rows[i], values[i]
            slope = y[i] * (weights[ids] @ v + bias) - 1.0
            new = min(max(dual[i] - slope / norms[i], 0.0), caps[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                weights[ids] += step * v
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-4:
            break
    return weights * ratio, bias


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's logistic curve, with his smoothed targets, by Newton steps."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - target) + 1e-6 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Model:
    def __init__(self, weights=None, bias=0.0, slope=0.0, shift=0.0, constant=None):
        self.weights, self.bias, self.slope, self.shift, self.constant = weights, bias, slope, shift, constant

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * (self.weights[features(text)].sum() + self.bias) + self.shift
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    short_batches(docs.sparkSession)

    def run(batches):
        turn_of("quality")
        for batch in batches:
            ids, y = ([features(x or "").astype(np.int32) for x in batch.column(1).to_pylist()], batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), y], ["doc_id", "ids", "y"])

    got = sample(docs, labels, label, max_train).mapInArrow(run, "doc_id long, ids array<int>, y int").toArrow()
    order = np.lexsort([got["doc_id"].to_numpy()])
    ids, y = [np.array(x, np.int64) for x in got["ids"].to_pylist()], np.where(got["y"].to_numpy() > 0, 1, -1)
    rows, y = [ids[i] for i in order], y[order]
    if not len(y) or abs(y.sum()) == len(y):
        return Model(constant=float((y > 0).mean()) if len(y) else 1.0)
    weights, bias = fit_hinge(rows, y, BUCKETS)
    slope, shift = fit_logistic(np.array([weights[r].sum() + bias for r in rows]), y)
    return Model(weights, bias, slope, shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        turn_of("quality")
        model = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(x or "") for x in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, columns as they are, that the model predicts to be good."""
    short_batches(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        turn_of("quality")
        model = held.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(x or "") >= THRESHOLD for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
