"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Vectors are compared within a label only.  Equal vectors are folded into one first.  The signs of fixed
random projections make a sketch of a few hundred bits; each of several tables hashes a vector to its
own few bits of the sketch.  Bits and tables follow from the rows per label by least cost, so that a
pair at the threshold shares no table with probability MISS at most.

Only names and sketches go to the tables.  Within a bucket, a pair is a candidate if its sketches differ
in few enough bits (a pair at the threshold is beyond that with probability 1e-7) and it agrees in no
earlier table.  Vectors that have a candidate in a bucket are then fetched and compared there, exactly,
in double precision.  A bucket of more than BLOCK vectors is cut into blocks at random, and each pair of
blocks is a group of its own, so no task holds a whole hot bucket; a group returns one row per linked
vector (its links and the least vector of its part), never its pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with
a null label, link with nothing (n_links 0, own component); lengths that differ do not link; repeated rows
count as vectors of their own; a null vec_id is kept and never linked; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, salted_join, short_batches, table
from .graph import components

THRESHOLD = 0.93
MISS = 1e-4
#: Vectors in a block of a large bucket; rows compared at a time.
BLOCK, TILE = 2048, 128
#: Seconds to deal a row to a table, and to compare two sketches: what the least cost is reckoned from.
ROW_COST, PAIR_COST = 6e-6, 4e-9
BITS, LEAST_WIDTH = range(4, 16), 256
#: Rows of the table of large buckets, or names of wanted vectors, that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def plan(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits a table, tables) for so many vectors under one label."""

    def tables(bits):
        return math.ceil(math.log(miss) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits))

    bits = min(BITS, key=lambda b: tables(b) * (ROW_COST + PAIR_COST * rows / 2**b))
    return bits, tables(bits)


def most_different(width: int, threshold: float) -> int:
    """Bits in which the sketches of a candidate pair may differ: 5.5 deviations above the threshold's mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(width * p + 5.5 * math.sqrt(width * p * (1 - p)))


@functools.lru_cache(8)
def _planes(dim: int, width: int) -> np.ndarray:
    return np.random.default_rng(20_231).standard_normal((dim, width))


def sketches(x: np.ndarray, width: int) -> np.ndarray:
    """Signs of the projections, packed into bytes: a row for each vector."""
    return np.packbits(x @ _planes(x.shape[1], width) > 0, axis=1, bitorder="little")


def signatures(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each table's bits of the sketches, as numbers."""
    signs = np.unpackbits(words, axis=1, count=bits * tables, bitorder="little").reshape(len(words), tables, bits)
    return (signs.astype(np.int32) << np.arange(bits, dtype=np.int32)).sum(2, dtype=np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(vector) -> np.ndarray | None:
    """The vector in double precision (no negative zeros), or None if it can link with nothing."""
    if not vector or None in vector:
        return None
    x = np.array(vector, float) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def _prepared(df: DataFrame, bits: int, tables: int, width: int) -> DataFrame:
    """vec_id, and of usable vectors kind (length and label), fold (a digest of kind and vector), sketch, signatures."""

    def run(batches):
        for batch in batches:
            ids, labels, vectors = (batch.column(k).to_pylist() for k in range(3))
            kinds: list = [None] * len(ids)
            folds, words, sigs = list(kinds), list(kinds), list(kinds)
            by_dim: dict[int, list] = {}
            for k, (i, label, vector) in enumerate(zip(ids, labels, vectors)):
                x = None if i is None or label is None else _usable(vector)
                if x is not None:
                    kinds[k] = f"{len(x)}:{label}"
                    folds[k] = hashlib.blake2b(kinds[k].encode() + b"\0" + x.tobytes(), digest_size=16).digest()
                    by_dim.setdefault(len(x), []).append((k, x))
            for held in by_dim.values():
                made = sketches(unit(np.array([x for _, x in held])), width)
                for (k, _), w, s in zip(held, made, signatures(made, bits, tables)):
                    words[k], sigs[k] = w.tobytes(), s
            types = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip((kinds, folds, words, sigs), types))], ["vec_id", "kind", "fold", "words", "sigs"])

    return df.mapInArrow(run, "vec_id long, kind string, fold binary, words binary, sigs array<int>")


def _groups(batches, key: list[int]):
    """(key, columns) of each run of rows that agree in the key columns; columns are lists of Arrow arrays."""
    last, held = None, []
    for batch in batches:
        columns = [batch.column(k) for k in range(batch.num_columns)]
        keys = list(zip(*(columns[k].to_pylist() for k in key)))
        lo = 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi] != keys[lo]:
                if keys[lo] != last:
                    if held:
                        yield last, [pa.concat_arrays([h[k] for h in held]) for k in range(len(columns))]
                    last, held = keys[lo], []
                held.append([c.slice(lo, hi - lo) for c in columns])
                lo = hi
    if held:
        yield last, [pa.concat_arrays([h[k] for h in held]) for k in range(len(held[0]))]


def _bytes(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.uint8) for v in column.to_pylist()])


def _fresh(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, at: int) -> np.ndarray:
    """Whether pairs agree in table `at` and in none before."""
    return (sigs[i, at] == sigs[j, at]) & ~(sigs[i, :at] == sigs[j, :at]).any(1)


def _across(ok: np.ndarray, lo: int, side: np.ndarray) -> None:
    """Leaves out a vector with itself, and pairs within a block where two blocks are compared."""
    own = np.arange(lo, lo + len(ok))
    if side[0]:
        ok &= side[own][:, None] != side[None, :]
    ok[np.arange(len(ok)), own] = False


def candidates(words: np.ndarray, side: np.ndarray, at: int, bits: int, tables: int, most: int) -> np.ndarray:
    """Which rows of a group have a candidate in it that they share no earlier table with."""
    n = len(words)
    out, sigs, long = np.zeros(n, bool), signatures(words, bits, tables), words.view(np.uint64)
    for lo in range(0, n, TILE):
        differ = np.zeros((min(TILE, n - lo), n), np.uint16)
        for k in range(long.shape[1]):
            differ += np.bitwise_count(long[lo : lo + TILE, k, None] ^ long[None, :, k])
        ok = differ <= most
        _across(ok, lo, side)
        i, j = np.nonzero(ok)
        i += lo
        fresh = _fresh(sigs, i, j, at)
        out[i[fresh]] = out[j[fresh]] = True
    return out


def compared(rep, weight, side, x, words, at: int, bits: int, tables: int, threshold: float):
    """Links of a group: per linked row (rep, links that are not in an earlier table, least rep of its part).

    `side` is 1 and 2 for the rows of two different blocks, which are compared across only; 0 within one.
    """
    order = np.argsort(rep, kind="stable")
    rep, weight, side, x, words = rep[order], weight[order], side[order], unit(x[order]), words[order]
    n, sigs = len(rep), signatures(words, bits, tables)
    links, packed = np.zeros(n, np.int64), []
    for lo in range(0, n, TILE):
        ok = x[lo : lo + TILE] @ x.T >= threshold
        _across(ok, lo, side)
        packed.append(np.packbits(ok, axis=1))
        i, j = np.nonzero(ok)
        fresh = _fresh(sigs, i + lo, j, at)
        np.add.at(links, i[fresh] + lo, weight[j[fresh]])
    label, far = np.arange(n), n
    while True:  # the least row that links lead to
        new = label.copy()
        for lo, bits_ in zip(range(0, n, TILE), packed):
            ok = np.unpackbits(bits_, axis=1, count=n).view(bool)
            new[lo : lo + TILE] = np.minimum(new[lo : lo + TILE], np.where(ok, label[None, :], far).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    rows = np.concatenate([np.unpackbits(b, axis=1, count=n).any(1) for b in packed])
    return rep[rows], links[rows], rep[label[rows]]


def links(df: DataFrame, folds: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(rep, n, least), possibly several rows a rep.  `folds`: rep (unique), id (a vec_id that has the vector), kind, fold, weight, words, sigs."""
    dealt = folds.select("rep", "kind", "words", F.posexplode("sigs").alias("at", "sig"))
    bucket = F.xxhash64("kind", "at", "sig")  # a collision makes more to compare, and no more links
    dealt = dealt.select("rep", "words", "at", bucket.alias("bucket"))
    large = folds.select("kind", F.posexplode("sigs").alias("at", "sig")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = checkpointed(large.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if large.count() <= BROADCAST_ROWS:
        dealt = dealt.join(F.broadcast(large), "bucket", "left")
    else:
        dealt = salted_join(dealt, large, "bucket", "rep", how="left")
    # large buckets are cut, and each pair of blocks is a group
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep", "at"), blocks).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(lo == hi, 0).when(F.col("block") == lo, 1).otherwise(2)
    key = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", lo, hi))
    dealt = dealt.select(key.alias("key"), "at", side.alias("side"), "rep", "words")
    schema = dealt.schema

    def found(batches):
        for (_, at), columns in _groups(batches, [0, 1]):
            if len(columns[0]) > 1:
                mask = candidates(_bytes(columns[4]), columns[2].to_numpy(), at, bits, tables, most)
                if mask.any():
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask)) for c in columns], schema.names)

    width = _width(bits, tables)
    most = most_different(width, threshold)
    wanted = checkpointed(dealt.repartition("key").sortWithinPartitions("key", "at").mapInArrow(found, schema))
    vectors = _vectors(df, folds.join(wanted.select("rep").distinct(), "rep").select("rep", "id", "kind", "fold", "weight"))
    rows = wanted.join(vectors, "rep").select("key", "at", "kind", "side", "rep", "weight", "words", "x")

    def linked(batches):
        for (_, at, _), (_, _, _, side, rep, weight, words, x) in _groups(batches, [0, 1, 2]):
            if len(rep) > 1:
                out = compared(rep.to_numpy(), weight.to_numpy(), side.to_numpy(), _bytes(x).view(float), _bytes(words), at, bits, tables, threshold)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["rep", "n", "least"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "kind").mapInArrow(linked, "rep long, n long, least long")


def _vectors(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted folds with x, their vectors' bytes in double precision, read from rows that have them."""
    wanted = checkpointed(wanted)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    read = df.join(wanted, df["vec_id"] == F.col("id")).where(F.concat_ws(":", F.size("embedding"), "label") == F.col("kind")).select("rep", "kind", "fold", "weight", "embedding")

    def run(batches):
        for batch in batches:
            keep, x = [], []
            for k, (kind, fold, vector) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 4)))):
                v = _usable(vector)
                if v is not None and hashlib.blake2b(kind.encode() + b"\0" + v.tobytes(), digest_size=16).digest() == fold:  # else another vector under the same vec_id
                    keep.append(k)
                    x.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1, 3)), pa.array(x, pa.binary())], ["rep", "kind", "weight", "x"])

    return read.mapInArrow(run, "rep long, kind string, weight long, x binary").dropDuplicates(["rep"])


def _width(bits: int, tables: int) -> int:
    """Bits of a sketch: those of all tables, in whole words."""
    return max(LEAST_WIDTH, 64 * math.ceil(bits * tables / 64))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    short_batches(df.sparkSession)
    single = isinstance(df.schema["embedding"].dataType, T.ArrayType) and isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), embedding.alias("embedding"))
    most = df.where("label is not null and embedding is not null").groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    bits, tables = plan(most or 1, threshold)
    rows = checkpointed(_prepared(df, bits, tables, _width(bits, tables)))
    one = lambda c: F.first(c).alias(c)
    folds = rows.where("fold is not null").groupBy("fold").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), one("kind"), one("words"), one("sigs"))
    folds = checkpointed(folds.withColumn("rep", F.monotonically_increasing_id()))  # a name without collisions, fixed by the checkpoint
    found = checkpointed(links(df, folds, bits, tables, threshold))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("rep"), "component")
    named = folds.select("rep", "fold", "id", "weight").join(counts, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = checkpointed(named)
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = salted_join(named, least, "component", "rep").select("fold", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    linked = salted_join(rows.where("fold is not null").select("vec_id", "fold"), named, "fold", "vec_id").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("fold is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
