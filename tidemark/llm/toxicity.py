"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: its length; hits, densities and strengths of a lexicon of words and one of word
beginnings; hits close to a second-person pronoun; shares of capitals and punctuation; the rate of
obfuscated chunks (signs or digits among letters, which are read as the letters they stand for).
The lexicons are learned: words whose smoothed log odds under label 1 are high.  A training row sees
lexicons learned without its own fold, and the isotonic curve is fitted to scores of trees that have
not seen the row, so neither is misled by its own labels.

Training takes at most `max_train` labelled rows, chosen by a hash of doc_id; every text is scored
whole.  Defined results: a null text is the empty text; rows without a doc_id and labels other than
0 and 1 are not trained on; without rows of both classes every score is the share of label 1 (0.0 if
there are no labels); repeated rows are scored each; training rows with equal margins share one knot of the curve.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkCache, checkpointed, short_batches, table
from .quality import MAX_TRAIN, sample

THRESHOLD = 0.3
FOLDS = 4
#: The least log odds of a lexicon's entry, the letters of a beginning, and the distance at which (or without
#: which) a hit counts as far from a second-person word.
LEAST_ODDS, BEGINNING, FAR = 2.0, 5, 50

#: Second-person words of the languages covered, and letters that signs stand for.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ti tus usted ustedes vosotros".split())
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

_inner = re.compile(r"[^\W_].*[^\W_]|[^\W_]", re.DOTALL)
_part, _letters = re.compile(r"[^\W_@$!|]+(?:[@$!|]+[^\W_@$!|]+)*"), re.compile(r"[^\W\d_]+")
_sign = re.compile(r"[\W\d_]")


def word_of(chunk: str) -> tuple[str, bool]:
    """(the chunk's letters in lower case, whether they were obfuscated)."""
    found = _inner.search(chunk)
    if not found:
        return "", False
    word = found[0]
    if not _sign.search(word):
        return word.lower(), False
    if word.isdigit():
        return "", False
    return _sign.sub("", word.translate(STANDS_FOR)).lower(), not word.replace("-", "").replace("'", "").isalpha()


def words_of(chunk: str) -> tuple[list[str], bool]:
    """(all words of a chunk, whether its letters were obfuscated): the reading of the whole chunk and,
    where signs stand among the letters, the readings of its parts and its runs of letters."""
    word, hidden = word_of(chunk)
    if not word or chunk.isalpha() or (inner := _inner.search(chunk)) and inner[0].isalpha():
        return [word] if word else [], hidden
    out = []
    for part in _part.findall(chunk):
        read = word_of(part)[0]
        runs = _letters.findall(part.lower())
        out += [read] * (read != "") + [r for r in runs if r != read]
    return out if word in out else [*out, word], hidden


class Lexicon:
    """Strengths of words and of word beginnings; texts become rows of dense features."""

    SECOND, CAPITALS, OBFUSCATED = 1, 2, 4

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.words, self.beginnings = words, beginnings
        self._ready = None

    def __getstate__(self):
        return self.words, self.beginnings

    def __setstate__(self, state):
        self.__init__(*state)

    def _prepare(self):
        names = {w: k + 1 for k, w in enumerate(self.words)}
        starts = {w: k + 1 for k, w in enumerate(self.beginnings)}

        def codes(chunk: str) -> tuple[int, ...]:
            words, hidden = words_of(chunk)
            letters = [c for c in chunk if c.isalpha()]
            flags = self.CAPITALS * (len(letters) > 1 and chunk.isupper()) | self.OBFUSCATED * hidden
            return tuple(names.get(w, 0) << 32 | starts.get(w[:BEGINNING], 0) << 8 | self.SECOND * (w in SECOND) | flags for w in words) or (flags,)

        strength = np.array([0.0, *self.words.values()])
        start_strength = np.array([0.0, *self.beginnings.values()])
        return ChunkCache(codes), strength, start_strength

    def features(self, text: str) -> list[float]:
        if self._ready is None:
            self._ready = self._prepare()
        cache, strength, start_strength = self._ready
        chunks = text.split()
        if not chunks:
            return [0.0] * 18
        codes = np.fromiter(chain.from_iterable(map(cache.__getitem__, chunks)), np.int64)
        n = len(codes)
        flags = codes & 255
        seconds = np.flatnonzero(flags & self.SECOND)
        any_hit = np.flatnonzero(codes >> 8)
        word = strength[codes[any_hit] >> 32]
        start = start_strength[codes[any_hit] >> 8 & 0xFFFFFF]
        own = word[word > 0]
        strong, starts = int((own >= 4).sum()), int((start > 0).sum())
        hits = any_hit[word > 0]
        near = FAR
        if len(hits) and len(seconds):
            k = np.clip(np.searchsorted(seconds, hits), 1, max(1, len(seconds) - 1))
            near = int(min(np.abs(seconds[np.minimum(k, len(seconds) - 1)] - hits).min(), np.abs(seconds[k - 1] - hits).min()))
        signs = text.count("!")
        return [
            np.log1p(n), float(own.max()) if len(own) else 0.0, float(own.sum()), float(np.sort(own)[-3:].sum()), len(own), len(own) / n, strong, strong / n,
            float(start.max()) if len(start) else 0.0, starts, starts / n, len(np.unique(codes[hits] >> 32)),
            len(seconds) / n, min(near, FAR), float((flags & self.CAPITALS > 0).mean()), signs / n, (text.count(",") + text.count(".") + text.count("?") + text.count("*")) / n, float((flags & self.OBFUSCATED > 0).mean()),
        ]


class Trees:
    """Boosted trees of a fixed depth for logistic loss, grown over binned features."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start, self.grown = float(np.log(share / (1 - share))), []
        edges = [np.unique(np.quantile(np.unique(f), np.linspace(0, 1, self.bins)[1:-1])) for f in x.T]
        binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T)], 1)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                wide = 1 << level
                best, feature, cut = np.full(wide, 1e-9), np.zeros(wide, np.int64), np.full(wide, np.inf)
                cut_bin = np.full(wide, self.bins + 1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    size = len(e) + 1
                    at = node * size + binned[:, f]
                    g, h = (np.bincount(at, v, wide * size).reshape(wide, size).cumsum(1) for v in (gradient, weight))
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least / 4) | (ht - hl < self.least / 4)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(wide), k]
                    better = top > best
                    best[better], feature[better], cut[better], cut_bin[better] = top[better], f, e[k[better]], k[better]
                tree.append((feature, cut))
                node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut_bin[node])
            wide = 1 << self.depth
            leaf = self.rate * np.bincount(node, gradient, wide) / (np.bincount(node, weight, wide) + 1)
            self.grown.append((tree, leaf))
            margin += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree, leaf in self.grown:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + (x[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve through the pooled adjacent violators; equal margins are one knot."""
    levels, at = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # [sum of y, rows, sum of margins]
    for m, v, n in zip(levels, np.bincount(at, y), np.bincount(at)):
        blocks.append([float(v), float(n), float(m * n)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, lexicon=None, trees=None, knots=None, constant=None):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        margin = self.trees.margin(np.array([self.lexicon.features(x) for x in texts], float))
        # a trace of the margin keeps the order within a flat part of the curve
        return np.clip(0.998 * np.interp(margin, *self.knots) + 0.002 / (1 + np.exp(-margin)), 0.0, 1.0)


def _lexicons(counts, positive: np.ndarray, negative: np.ndarray) -> list[dict[str, float]]:
    """For each fold the lexicon of the other folds' rows, then that of all."""
    words = counts["word"].to_pylist()
    pos, neg = (np.array([counts[f"{c}{k}"].to_numpy() for k in range(FOLDS)]) for c in "pn")
    out = []
    for left_out in (*range(FOLDS), None):
        held = np.array([k != left_out for k in range(FOLDS)])
        p, n, np_, nn = pos[held].sum(0), neg[held].sum(0), positive[held].sum(), negative[held].sum()
        odds = np.log((p + 0.5) / (np_ + 1)) - np.log((n + 0.5) / (nn + 1))
        out.append({words[i]: float(odds[i]) for i in np.flatnonzero((p >= 2) & (odds >= LEAST_ODDS))})
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    spark = docs.sparkSession
    short_batches(spark)
    rows = checkpointed(sample(docs, labels, label, max_train).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int")).select("doc_id", "text", "y", "fold"))
    sizes = {(r.y, r.fold): r.n for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    positive, negative = (np.array([sizes.get((v, k), 0) for k in range(FOLDS)]) for v in (1, 0))
    if not positive.sum() or not negative.sum():
        return Model(constant=float(bool(positive.sum())))

    def words_in(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text, y, fold in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                words = {w for c in set((text or "").split()) for w in words_of(c)[0]}
                for kind, found in enumerate((words, {w[:BEGINNING] for w in words if len(w) >= BEGINNING})):
                    for column, v in zip(out, (list(found), [kind] * len(found), [y] * len(found), [fold] * len(found))):
                        column.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(v, pa.int32()) for v in out[1:])], ["word", "kind", "y", "fold"])

    sums = [F.count(F.when((F.col("y") == v) & (F.col("fold") == k), 1)).alias(f"{c}{k}") for c, v in (("p", 1), ("n", 0)) for k in range(FOLDS)]
    total = lambda c: sum((F.col(f"{c}{k}") for k in range(1, FOLDS)), F.col(f"{c}0"))
    counted = rows.mapInArrow(words_in, "word string, kind int, y int, fold int").groupBy("kind", "word").agg(*sums).where(total("p") >= 2)
    strength = F.log((total("p") + 0.5) / float(positive.sum())) - F.log((total("n") + 0.5) / float(negative.sum()))
    pick = lambda kind: counted.where((F.col("kind") == kind) & (strength >= 1)).orderBy("word").toArrow()
    made = [Lexicon(w, b) for w, b in zip(*(_lexicons(pick(kind), positive, negative) for kind in (0, 1)))]
    held = spark.sparkContext.broadcast(made)

    def featured(batches):
        for batch in batches:
            found = [held.value[fold].features(x or "") for x, fold in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([list(map(float, x)) for x in found], pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

    got = rows.mapInArrow(featured, "doc_id long, y int, fold int, x array<double>").orderBy("doc_id").toArrow()
    x, y, fold = np.array(got["x"].to_pylist(), float), got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and not rest.all():
            margin[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest])
    return Model(made[-1], Trees().fit(x, y), isotonic(margin, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores([x or "" for x in batch.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
