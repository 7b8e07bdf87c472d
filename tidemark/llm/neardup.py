"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the multiset of its runs of five words (the letters and digits between white space, lower
case; a shorter text is one run).  A shingle weighs its count times its inverse document frequency,
idf = 1 + log(N / df) to the base S^3, where N counts all rows and what is in fewer than one text in S
counts as in one in S.  S is 1000, or what keeps the table of more frequent shingles below LIMIT
entries whatever the corpus: a text of c characters has c / 2 shingles at most, so at most S * c / 2 can be
that frequent.  The base damps the factor (from 1 to 4/3): one group of near copies may hold a third of
all rows, and its shared text must not weigh so much less than its members' edits that the group falls apart.

Frequencies are exact, over all rows.  A first pass counts shingles by slot, in a table of fixed size that
tasks add up chunk by chunk: a frequent shingle makes its slot heavy.  A second pass counts the shingles
of heavy slots by themselves.

Texts with equal words are folded into one first.  Each text gets HASHES consistent weighted samples
(Ioffe's scheme: the sample of a shingle of weight w is the same for every text where its weight stays
within the same step), which are joined to bands.  Texts that share a band are candidates.  Links are
verified by weighted Jaccard similarity on the whole texts, in two steps that never make all pairs of a
bucket: every member against the most central member of its bucket; then, in buckets whose members are
not yet all connected, the members outside the largest part against those of other parts.  The second
step compares block against block within a task, and returns only a spanning star of each block's links,
never its pairs.  So every candidate pair is either verified or already connected.  Classes are connected
components.

Defined results: null and empty texts, and texts without a letter or digit, are unique each; repeated
rows belong to one class; the class is the least doc_id in it; ties (equal doc_ids with equal words) are
one text; an empty table gives no rows; rows with a null doc_id are classes of their own and are kept.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import brief_shuffles, checkpointed, salted_join, short_batches, table, turn_of, unused
from .graph import components

WORDS, THRESHOLD = 5, 0.8
#: HASHES = BANDS * ROWS: a pair at the threshold shares no band with probability 0.0002.
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
#: Longs that hold four bits of each sample.
PACKED = HASHES // 16
#: The rarest share of texts (one in so many) that the frequency factor tells apart; entries of its table;
#: the power of that share which is the base of its logarithm.
RAREST, LIMIT, DAMPING = 1000, 1 << 21, 3
#: Slots by which shingles are counted first, the chunks that they are added up in, and shingles counted at a time.
SLOTS, CHUNKS, COUNTED = 2 * LIMIT, 64, 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for white space, 2 for letters and digits, 0 for the rest; and a random word."""
    kinds = np.fromiter((1 if c.isspace() else 2 * c.isalnum() for c in map(chr, range(0x110000))), np.uint8, 0x110000)
    return kinds, _mix(np.arange(0x110000, dtype=np.uint64) + _M)


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _M)])


def word_ids(text: str) -> np.ndarray:
    """A hash of each word: the letters and digits of a white-space delimited chunk, in lower case."""
    kinds, values = _alphabet()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[points]
    used = np.flatnonzero(kind)
    letters = np.flatnonzero(kind[used] == 2)
    if not len(letters):
        return np.zeros(0, np.uint64)
    # a word begins where white space stands before a letter
    starts = np.flatnonzero(np.r_[True, np.diff(letters) != 1])
    lengths = np.diff(np.r_[starts, len(letters)])
    at = np.arange(len(letters)) - np.repeat(starts, lengths)
    power = _powers(1 << max(10, int(lengths.max() - 1).bit_length()))
    return _mix(np.add.reduceat(values[points[used[letters]]] * power[at], starts)) | np.uint64(1)


def shingles(ids: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of the runs of k words, their counts)."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    k = min(k, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ ids[i : len(ids) - k + 1 + i]) * _M
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h), return_counts=True)


def rarest(rows: int, mean_length: float) -> float:
    """S for a corpus of so many rows with so many characters on average."""
    return float(min(RAREST, rows, 2 * LIMIT / max(mean_length, 1.0)))


def idf(df, n: int, s: float):
    """1 + log(n / df) to the base s^DAMPING, as a share of its value where one text in s has the shingle."""
    if s <= 1:
        return np.ones(np.shape(df))
    return (1 + np.clip(np.log(n / np.maximum(df, 1)) / math.log(s), 0, 1) / DAMPING) / (1 + 1 / DAMPING)


class Weights:
    """Inverse document frequencies; those that are not 1 are listed, by sorted key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts.astype(float)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            w *= np.where(self.keys[at] == keys, self.values[at], 1.0)
        return w


def _tables():
    """2^16 draws of (r, ln c, beta), r and c from Gamma(2, 1), in the order of what weight 1 makes of them."""
    rng = np.random.default_rng(11)
    r, c, beta = rng.gamma(2.0, 1.0, 1 << 16), np.log(rng.gamma(2.0, 1.0, 1 << 16)), rng.random(1 << 16)
    one = c - r * (1 - beta)
    order = np.argsort(one)
    return r[order], c[order], beta[order], one[order]


_draws: list = []
_seeds = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _M)


def _hashes(keys: np.ndarray) -> np.ndarray:
    """A hash of each key for each sample; for one sample it is a permutation of the keys."""
    h = (keys[:, None] ^ _seeds) * _M
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def samples(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """HASHES consistent weighted samples of a weighted set, as 64-bit codes of (key, step).

    The upper bits of a hash choose the draw.  Draws are in the order of weight 1, whose step is 0, so
    among shingles of weight 1 the least hash wins; only the others need the draws themselves.
    """
    if not _draws:
        _draws.extend(_tables())
    r, c, beta, one = _draws
    plain = weights == 1
    best = np.full(HASHES, np.inf)
    code = np.zeros(HASHES, np.uint64)
    own = keys[plain]
    if len(own):
        for lo in range(0, len(own), 256):
            least = _hashes(own[lo : lo + 256]).min(0)
            code = least if not lo else np.minimum(code, least)
        best = one[(code >> np.uint64(48)).astype(np.int64)]
    rest, log_w = keys[~plain], np.log(weights[~plain])
    at = np.arange(HASHES)
    for lo in range(0, len(rest), 256):
        h = _hashes(rest[lo : lo + 256])
        k = (h >> np.uint64(48)).astype(np.int64)
        t = np.floor(log_w[lo : lo + 256, None] / r[k] + beta[k])
        value = c[k] - r[k] * (t - beta[k]) - r[k]
        first = value.argmin(0)
        v = value[first, at]
        step = t[first, at].astype(np.int64)
        made = np.where(step == 0, h[first, at], h[first, at] ^ _mix((step + 1_000_003).astype(np.uint64)))
        code = np.where(v < best, made, code)
        best = np.minimum(best, v)
    return code


def sketch(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, four bits of each sample, packed into longs)."""
    code = samples(keys, weights)
    rows = code.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix((h ^ rows[:, k]) * _M)
    bits = (_mix(code) & np.uint64(15)).reshape(PACKED, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return h.view(np.int64), np.bitwise_or.reduce(bits, 1).view(np.int64)


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def digest(ids: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(ids.tobytes())


def _slots(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def heavy_slots(docs: DataFrame, least: float, slots: int = SLOTS) -> np.ndarray:
    """Whether the shingles of a slot are in more than `least` texts together: a superset of the frequent ones' slots."""
    wide = slots // CHUNKS

    def counted(batches):
        turn_of("near-dedup")
        total = np.zeros(slots, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, _slots(shingles(word_ids(text or ""))[0], slots), np.uint32(1))
        parts = [pa.compress(p.tobytes(), "zstd", asbytes=True) for p in total.reshape(CHUNKS, wide)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def summed(batches):
        turn_of("near-dedup")
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(*(batch.column(k).to_pylist() for k in range(2))):
                total.setdefault(chunk, np.zeros(wide, np.int64))
                total[chunk] += np.frombuffer(pa.decompress(part, 4 * wide, "zstd"), np.uint32)
        found = [chunk * wide + np.flatnonzero(sums > least) for chunk, sums in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64())], ["slot"])

    chunks = docs.select("text").mapInArrow(counted, "chunk int, counts binary")
    out = np.zeros(slots, bool)
    # all slots hold so many shingles together that no more than LIMIT can be heavy
    out[chunks.repartition(CHUNKS, "chunk").mapInArrow(summed, "slot long").toArrow()["slot"].to_numpy()] = True
    return out


def common_shingles(docs: DataFrame) -> Weights:
    """Exact weights of the shingles in more than one text in S, of which there are fewer than LIMIT."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("n"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("c")).first()
    n, s = size.n, rarest(size.n, size.c or 0.0)
    if s <= 1:
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    slots = SLOTS
    heavy = spark.sparkContext.broadcast(np.packbits(heavy_slots(docs, n / s, slots)))

    def counted(batches):
        turn_of("near-dedup")
        wanted = np.unpackbits(heavy.value).view(bool)
        held, size = [], 0

        def told():
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = shingles(word_ids(text or ""))[0]
                held.append(keys[wanted[_slots(keys, slots)]])
                size += len(held[-1])
            if size >= COUNTED:
                yield told()
                held, size = [], 0
        yield told()

    got = docs.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > n / s).toArrow()
    keys = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Weights(keys[order], idf(got["n"].to_numpy()[order], n, s))


def sketched(docs: DataFrame, weights) -> DataFrame:
    """Per document doc_id, fold (null without words or doc_id), size, bands, bits; `weights` is broadcast."""

    def run(batches):
        turn_of("near-dedup")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = word_ids(text or "") if doc is not None else ()
                if len(ids):
                    keys, counts = shingles(ids)
                    w = weights.value.of(keys, counts)
                    row = (digest(ids), float(w.sum()), *sketch(keys, w))
                else:
                    row = (None, None, None, None)
                for column, v in zip(out, row):
                    column.append(v)
            kinds = (pa.binary(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds))], ["doc_id", "fold", "size", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fold binary, size double, bands array<long>, bits array<long>")


def _alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether two texts are near enough in size, and their sample bits agree often enough, to be verified.

    At a similarity of 0.8 nine bits in ten agree on average, with a deviation of 0.03: the least number
    lies five deviations below.
    """
    differ = sum((F.bit_count(x[f"s{k}"].bitwiseXOR(y[f"s{k}"])) for k in range(1, PACKED)), F.bit_count(x["s0"].bitwiseXOR(y["s0"])))
    return (F.least(x["size"], y["size"]) >= F.greatest(x["size"], y["size"]) * (threshold - 1e-6)) & (differ <= MOST_DIFFERENT)


#: Members compared with one copy of a pivot; ids that may be broadcast to find their texts.
MEMBERS, BROADCAST_ROWS = 256, 1_000_000
MOST_DIFFERENT = 62  # of 256 bits


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, keys, counts) of the wanted nodes, read from the text of the document that stands for each; counts are empty if all are 1."""
    ids = nodes.join(wanted.distinct(), "node").select("node", "fold", F.col("doc_id").alias("rep"))
    ids = checkpointed(ids)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def run(batches):
        turn_of("near-dedup")
        for batch in batches:
            out: list[list] = [[], [], []]
            for node, fold, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = word_ids(text or "")
                if digest(ids) == fold:  # else another text under the same doc_id
                    keys, counts = shingles(ids)
                    for column, v in zip(out, (node, keys.tobytes(), b"" if (counts == 1).all() else counts.astype(np.uint32).tobytes())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.binary()))], ["node", "keys", "counts"])

    read = docs.join(ids, docs["doc_id"] == F.col("rep")).select("node", "fold", "text").mapInArrow(run, "node long, keys binary, counts binary")
    return checkpointed(read.dropDuplicates(["node"]))


def _weighted(keys: bytes, counts: bytes, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The (keys, weights) that `_texts` made."""
    keys = np.frombuffer(keys, np.uint64)
    return keys, weights.of(keys, np.frombuffer(counts, np.uint32) if counts else np.ones(len(keys)))


def _verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least that similarity.  A pivot a goes once to each MEMBERS of its b."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "salt", "b")
    member_rows = members.join(texts, F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("part"), "b", "keys", "counts")
    pivots = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pivot_rows = pivots.join(texts, F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("part"), F.col("a").alias("b"), "keys", "counts")
    dealt = member_rows.unionByName(pivot_rows).repartition("a", "salt").sortWithinPartitions("a", "salt", "part")

    def run(batches):
        turn_of("near-dedup")
        pivot, held = None, None
        for batch in batches:
            out: list[list] = [[], []]
            for a, part, b, keys, counts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                own = _weighted(keys, counts, weights.value)
                if part == 0:
                    pivot, held = a, own
                elif a == pivot and similarity(held, own) >= threshold:
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


#: Members of a bucket in one block of the second step, and shingles that they may hold together.
BLOCK, HELD = 1024, 1 << 20


def _tiled(parts: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b) that connect what the pairs of different parts in a bucket connect.

    The members outside a bucket's main part, in `outer` blocks, meet all its members, in `inner` blocks:
    each pair of blocks is a group of its own.  A pair that shares an earlier band is left to that bucket.
    """
    rows = parts.join(texts, "node")
    own = ["node", "part", "size", "bits", "bands", "keys", "counts"]
    group = ["bucket", "o", "i"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    at = lambda n: F.pmod(F.xxhash64("node", "bucket"), n).cast("int")
    outer = rows.where("part != main").select("bucket", at(F.col("outer")).alias("o"), spread(F.col("inner")).alias("i"), F.lit(0).alias("side"), *own)
    inner = rows.select("bucket", spread(F.col("outer")).alias("o"), at(F.col("inner")).alias("i"), F.when(F.col("part") != F.col("main"), 1).otherwise(2).alias("side"), *own)
    dealt = outer.unionByName(inner).repartition(*group).sortWithinPartitions(*group, "side")

    def run(batches):
        turn_of("near-dedup")
        last, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(k) for k in range(len(batch.columns))]
            for k, key in enumerate(zip(*(c.to_pylist() for c in columns[:3]))):
                if key != last:
                    out += _linked(last and last[0], held, weights.value, threshold)
                    last, held = key, []
                held.append(tuple(c[k].as_py() for c in columns[3:]))
            yield _pairs(out)
        yield _pairs(_linked(last and last[0], held, weights.value, threshold))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _linked(bucket, held: list, weights: Weights, threshold: float) -> list[tuple[int, int]]:
    """Star edges of the components that the links between the two sides of a group make."""
    outer, inner = [h for h in held if h[0] == 0], [h for h in held if h[0] > 0]
    if not outer or not inner:
        return []
    side = lambda rows, k, kind: np.array([r[k] for r in rows], kind)
    (on, op, osz, ob, oband), (inn, ip, isz, ib, iband) = ([side(x, k, t) for k, t in ((1, np.int64), (2, np.int64), (3, float), (4, np.int64), (5, np.int64))] for x in (outer, inner))
    ok = op[:, None] != ip[None, :]
    ok &= np.minimum(osz[:, None], isz) >= np.maximum(osz[:, None], isz) * (threshold - 1e-6)
    twice = side(inner, 0, np.int64) == 1  # these are on the outer side as well
    ok &= ~twice[None, :] | (on[:, None] < inn[None, :])
    if not ok.any():
        return []
    differ = np.zeros(ok.shape, np.int64)
    for k in range(PACKED):
        differ += np.bitwise_count(ob[:, None, k] ^ ib[None, :, k])
    ok &= differ <= MOST_DIFFERENT
    for k in range(int(np.flatnonzero(oband[0] == bucket)[0])):
        ok &= oband[:, None, k] != iband[None, :, k]
    if not ok.any():
        return []
    rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    sets = lambda r: _weighted(r[6], r[7], weights)
    a, b = [sets(outer[k]) for k in rows], [sets(inner[k]) for k in cols]
    found = ok[np.ix_(rows, cols)] & (_overlaps(a, b) >= threshold * (1 - 1e-12))
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, j in zip(*np.nonzero(found)):
        x, y = root(int(on[rows[i]])), root(int(inn[cols[j]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(v, root(v)) for v in list(parent) if root(v) != v]


#: Shingles at a time in the comparison of two blocks.
SLICE = 1024


def _overlaps(a: list, b: list) -> np.ndarray:
    """Weighted Jaccard similarities of all of `a` with all of `b`, a slice of the shingles at a time.

    A shingle of weight w counts as its steps: those up to the least weight of two texts are shared.
    """
    keys = np.concatenate([k for k, _ in (*a, *b)])
    w = np.concatenate([v for _, v in (*a, *b)])
    row = np.repeat(np.arange(len(a) + len(b)), [len(k) for k, _ in (*a, *b)])
    totals = np.bincount(row, w, len(a) + len(b))
    _, code, times = np.unique(keys, return_inverse=True, return_counts=True)
    useful = times[code] > 1  # the others are shared by no two texts
    code, w, row = code[useful], w[useful], row[useful]
    both = np.zeros((len(a), len(b)))
    order = np.argsort(code, kind="stable")
    code, w, row = code[order], w[order], row[order]
    if len(code):
        _, code = np.unique(code, return_inverse=True)
        for lo in range(0, int(code.max()) + 1, SLICE):
            i, j = np.searchsorted(code, [lo, lo + SLICE])
            x = np.zeros((len(a) + len(b), SLICE))
            x[row[i:j], code[i:j] - lo] = w[i:j]
            done = 0.0
            for level in np.unique(w[i:j]):  # min(u, v) is the sum of the steps that both reach
                reach = (x >= level).astype(np.float32)
                both += (level - done) * (reach[: len(a)] @ reach[len(a) :].T)
                done = level
    return both / (totals[: len(a), None] + totals[None, len(a) :] - both)


def _components(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id and fold of every row; node, fold, rep and component of every distinct text)."""
    weights = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    rows = checkpointed(sketched(docs, weights))
    one = lambda c: F.first(c).alias(c)
    nodes = rows.where("fold is not null").groupBy("fold").agg(F.min("doc_id").alias("doc_id"), one("size"), one("bands"), one("bits"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))  # a name without collisions, fixed by the checkpoint

    # a bucket: the texts that share a band hash (the band is part of the hash)
    member = F.struct("node", "size", *(F.col("bits")[k].alias(f"s{k}") for k in range(PACKED))).alias("m")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(salted_join(buckets, sizes, "bucket", "node"))
    # the text with the most company over all its buckets is the likeliest origin of a group of copies
    central = shared.groupBy("node").agg(F.sum("n").alias("company"))
    shared = checkpointed(shared.join(central.join(nodes, "node").select("node", "company", member), "node").select("bucket", "node", "m", "company"))
    pivots = shared.groupBy("bucket").agg(F.max_by("m", F.struct("company", "node")).alias("p"))
    m, p = F.col("m"), F.col("p")
    near = salted_join(shared, pivots, "bucket", "node").where((m["node"] != p["node"]) & _alike(m, p, threshold))
    first = checkpointed(near.select(p["node"].alias("a"), m["node"].alias("b")).distinct())
    texts = _texts(docs, nodes.select("node", "fold", "doc_id"), first.select(F.col("a").alias("node")).union(first.select("b")))
    links = checkpointed(_verified(first, texts, weights, threshold))
    found = checkpointed(components(links))

    # members of a bucket that are not yet connected
    parts = shared.select("bucket", "node", m["size"].alias("held")).join(found, "node", "left").select("bucket", "node", "held", F.coalesce("component", "node").alias("part"))
    counted = parts.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    mixed = counted.groupBy("bucket").agg(F.max_by(F.struct("part", "n", "held"), F.struct("n", "part")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("held").alias("held")).where("parts > 1")
    blocks = lambda n, held: F.ceil(F.greatest(n / BLOCK, held / HELD)).cast("int")
    mixed = mixed.select("bucket", "main.part", blocks(F.col("n") - F.col("main.n"), F.col("held") - F.col("main.held")).alias("outer"), blocks(F.col("n"), F.col("held")).alias("inner")).withColumnRenamed("part", "main")
    parts = checkpointed(salted_join(parts.drop("held"), mixed, "bucket", "node"))
    if not parts.isEmpty():
        texts = _texts(docs, nodes.select("node", "fold", "doc_id"), parts.select("node"))
        rest = checkpointed(_tiled(parts, nodes.join(texts, "node").select("node", "size", "bits", "bands", "keys", "counts"), weights, threshold))
        found = checkpointed(components(links.union(rest)))

    named = nodes.select("node", "fold", F.col("doc_id").alias("rep")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows, checkpointed(named)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, fold, class_id and component (fold and component null without words) of every document."""
    spark = docs.sparkSession
    short_batches(spark)
    if threshold < THRESHOLD:
        raise ValueError(f"bands and sample bits are set for similarities of {THRESHOLD} or more, not {threshold}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with brief_shuffles(spark):
        rows, named = _components(docs, threshold)
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = salted_join(named, least, "component", "node").select("fold", "class_id", "component")
    worded = salted_join(rows.where("fold is not null").select("doc_id", "fold"), named, "fold", "doc_id")
    wordless = rows.where("fold is null").select("doc_id", "fold", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("component"))
    return worded.select("doc_id", "fold", "class_id", "component").unionByName(wordless)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, kept."""
    return classes(docs, threshold).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, of the least doc_id in it; rows with a null doc_id are classes of their own."""
    with brief_shuffles(docs.sparkSession):
        found = checkpointed(classes(docs, threshold))
        # a doc_id of several rows is judged text by text, any other by its one class
        odd = checkpointed(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
        gone = checkpointed(found.where("doc_id != class_id").select("doc_id").union(odd).distinct())
        if gone.count() <= BROADCAST_ROWS:  # then the texts need not be shuffled
            gone = F.broadcast(gone)
    single = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if odd.isEmpty():
        return single
    own, fold, rep = (unused(docs, n) for n in ("_fold", "_least", "_rep"))
    least = found.join(odd, "doc_id", "left_semi").where("doc_id = class_id and fold is not null").groupBy("component").agg(F.min("fold").alias(fold), F.min("doc_id").alias(rep)).select(fold, rep)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        turn_of("near-dedup")
        for batch in batches:
            ids = [word_ids(text or "") for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(i) if len(i) else None for i in ids], pa.binary())], [*batch.schema.names, own])

    several = docs.join(odd, "doc_id", "left_semi").select(docs.columns).mapInArrow(run, T.StructType([*schema.fields, T.StructField(own, T.BinaryType())]))
    # one row of each (doc_id, words); texts without words are the same only if equal
    worded = several.where(F.col(own).isNotNull()).join(least, (F.col(own) == F.col(fold)) & (F.col("doc_id") == F.col(rep)), "left_semi").dropDuplicates(["doc_id", own])
    wordless = several.where(F.col(own).isNull()).dropDuplicates(["doc_id", "text"])
    return single.unionByName(worded.select(docs.columns)).unionByName(wordless.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
