"""Best-fit packing of token pieces into sequences, after dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is its histogram: at most
`capacity` counts, whatever the number of documents.  The driver solves that histogram; documents
take their places in the solution by rank within their length, which Spark computes in parallel.

Reduction (Martello and Toth): for the longest piece j, a set of at most three pieces that dominates
every other set with j is fixed for good:
  * j alone, if nothing fits beside it;
  * j and the longest partner j*, if both fill the sequence or no third piece ever fits;
  * with at most two partners: j and j* if j* is no shorter than the best fitting pair, or j and
    that pair (a, b) if a is as long as j* and no pair without b can do better.
Equal lengths are interchangeable, so a set is fixed as often as its pieces last.  What remains is
packed by best fit, longest first.

Defined results: a null text is the empty text (one end token); repeated rows are packed each; an
empty table packs into no rows; ties between equal lengths go by doc_id, piece, then checksum.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ChunkCache, checkpointed, keeps_caches, short_batches, table, turn_of

CAPACITY, END_ID = 4096, 1
#: Rows that one (length, salt) group holds at most on average; at least MIN_SALTS groups a length.
ROWS_A_SALT, MIN_SALTS = 1_000_000, 64

#: How the vocabulary cuts Latin text before its merges; {L} and {N} stand for letters and numbers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"

_encoders: dict[str, ChunkCache] = {}
keeps_caches("packing", _encoders.clear)


def _latin() -> tuple[re.Pattern, re.Pattern]:
    """(chunks of composed Latin letters, numbers and signs; PATTERN over them)."""
    points = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c < 0xA0 and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250]
    kinds = {k: "".join(re.escape(c) for c in points if unicodedata.category(c)[0] == k) for k in "LN"}
    return re.compile("[" + "".join(map(re.escape, points)) + "]+"), re.compile(PATTERN.format(**kinds))


def _encoder(path: str) -> ChunkCache:
    """Ids of a chunk as little-endian bytes: words of Latin chunks go straight to the merges."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        model, (plain, pattern) = tokenizer.model, _latin()
        signs = {}  # a byte's stand-in in the vocabulary, by code point
        for c in range(0x21, 0x250):
            signs[c] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]

        words = ChunkCache(lambda word: np.array([t.id for t in model.tokenize(word.translate(signs))], "<u4").tobytes())

        def chunk_ids(chunk: str) -> bytes:
            if plain.fullmatch(chunk):
                return b"".join([words[w] for w in pattern.findall(chunk.lower())])
            return np.asarray(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

        _encoders[path] = ChunkCache(chunk_ids)
    return _encoders[path]


def token_bytes(text: str, path: str) -> bytes:
    """Ids of a text under a vocabulary that drops white space.

    White space ends every token and is dropped, so a text's ids are those of its chunks in turn.
    The four separators that Python, but not Unicode, counts as white space leave the text whole.
    """
    cache = _encoder(path)
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return cache.make(text)
    return b"".join(map(cache.__getitem__, text.split()))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut the ids of each document, closed by END_ID, into pieces of `capacity`."""
    short_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches):
        turn_of("packing")
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            ids = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = token_bytes(text or "", path) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for name, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()]
            names = list(out)
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix dominating sets until there is none; takes their pieces out of `counts` (by length) and returns (times, lengths)."""
    fixed: list[tuple[int, tuple[int, ...]]] = []
    before = -1
    while len(fixed) > before:
        before = len(fixed)
        for j in range(capacity, 0, -1):
            while counts[j]:
                found = _dominating(counts, j, capacity)
                if not found:
                    break
                need: dict[int, int] = {}
                for s in found:
                    need[s] = need.get(s, 0) + 1
                times = int(min(counts[s] // n for s, n in need.items()))
                for s, n in need.items():
                    counts[s] -= n * times
                fixed.append((times, found))
    return fixed


def _dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...]:
    room = capacity - j
    counts[j] -= 1  # the other pieces
    try:
        sizes = np.flatnonzero(counts[: room + 1])
        if not len(sizes):
            return (j,)
        partner = int(sizes[-1])
        least, fits = 0, 0  # how many of the shortest pieces fit beside j: 0 to 3
        for s in sizes[:3]:
            for _ in range(min(3 - fits, int(counts[s]))):
                least += int(s)
                if least > room:
                    break
                fits += 1
        if partner == room or fits == 1:
            return (j, partner)
        if fits != 2:
            return ()
        # the best pair: for each a the longest b <= a that fits beside it
        at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), side="right") - 1
        same = (at >= 0) & (sizes[at] == sizes) & (counts[sizes] < 2)
        at = np.where(same, at - 1, at)
        sums = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
        k = len(sums) - 1 - int(np.argmax(sums[::-1]))
        if not sums[k] or partner >= sums[k]:
            return (j, partner)
        a, b = int(sizes[k]), int(sizes[at[k]])
        if a != partner:
            return ()
        if a == b or counts[b + 1 : a].sum() <= 1:
            return (j, a, b)
        longer = [int(s) for s in sizes[sizes > b][:2] for _ in range(min(2, int(counts[s])))][:2]
        return (j, a, b) if sum(longer) > room else ()
    finally:
        counts[j] += 1


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Best fit, longest first, a run of equal pieces at a time: (times, ((length, count), ...))."""
    groups: dict[int, list[list]] = {}  # room left -> [times, content]
    rooms: list[int] = []
    done = []

    def keep(times: int, content: tuple, room: int) -> None:
        if not room:
            done.append((times, content))
            return
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([times, content])

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            k = bisect_left(rooms, s)
            room = rooms[k] if k < len(rooms) else capacity
            each = room // s
            if k < len(rooms):
                times, content = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                times, content = -(-left // each), ()
            full = min(times, left // each)
            if full:
                keep(full, (*content, (s, each)), room - each * s)
                left -= full * each
            if full < times and left:
                keep(1, (*content, (s, left)), room - left * s)
                full, left = full + 1, 0
            if full < times:
                keep(times - full, content, room)
    return done + [(t, c) for g in groups.values() for t, c in g]


def solve(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """A packing of a histogram of lengths: (times, ((length, count), ...)) for each kind of sequence."""
    rest = counts.copy()
    fixed = reduce_by_dominance(rest, capacity)
    kinds = [(times, tuple((s, lengths.count(s)) for s in dict.fromkeys(lengths))) for times, lengths in fixed]
    return kinds + best_fit(rest, capacity)


def _slots(kinds: list[tuple[int, tuple]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, offset), by first rank."""
    rows: dict[int, list] = {}
    used = [0] * (capacity + 1)
    sequence = 0
    for times, content in kinds:
        offset = 0
        for s, n in content:
            rows.setdefault(s, []).append((used[s], sequence, n, offset))
            used[s] += times * n
            offset += s * n
        sequence += times
    return {s: np.array(x, np.int64) for s, x in rows.items()}


def ranked(cut: DataFrame, rows: int) -> DataFrame:
    """Adds `rank`, from 0 within each length, without gathering a length in one task."""
    salts = max(MIN_SALTS, -(-rows // ROWS_A_SALT))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("own", own).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("salt", "own", "base")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `capacity`."""
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    slots = spark.sparkContext.broadcast(_slots(solve(counts, capacity), capacity))
    names = [c for c in cut.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def put(batches):
        turn_of("packing")
        by_length = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(order) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = order[lo:hi]
                s = int(length[own[0]])
                rows = by_length[s]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + k // row[:, 2]
                offset[own] = row[:, 3] + k % row[:, 2] * s
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked(cut, int(counts.sum())).select(*names, "rank").mapInArrow(put, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """documents -> one row per piece with its place; `with_ids` keeps the token ids themselves."""
    return place(checkpointed(pieces(docs, path, capacity, with_ids)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
