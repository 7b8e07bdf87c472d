"""Audit of how the sources of a language diverge in their terms, over a tokenizer that works on bytes.

A task lays the UTF-8 buffers of its texts end to end.  A lookup table of 256 entries folds A-Z and tells which
bytes belong to terms (letters and all bytes above 0x7F); where the mask changes, or a text begins, terms begin
and end.  Slices are grouped by xxhash, and every slice is compared with the first of its group byte for byte;
what differs is grouped by its bytes instead.  Counts by document form a CSR matrix, whose rows are summed up
by group with reduceat.  Spark sums the cells of all tasks, keeps the terms in enough documents of their
language, and deals them in blocks.  A block is a CSR matrix of sources and terms: divergences from the other
sources are computed cell by cell against rows of a dense slice and summed with reduceat, so absent terms
cost nothing beyond one value a pair; Spark adds up the blocks.

All arithmetic is in whole numbers.  p = 1 + floor(10^9 (count + 2) / (N + 2 V)) is found by long division in steps of
1,000, so that N may pass 10^15; f = floor((p - q)^2 / (p + q)) fits 64 bits, as does its sum over V < 10^9 terms.

A term's cells are one a source at most, a block holds about CELLS of them, and TILE sources (a lang with more has its
sources dealt to tiles, and blocks are made of pairs of tiles).  So neither a hot source, a hot language nor a
very frequent term makes one task large.  The result has a row for each pair of sources of a language, as it is asked for.

Defined results: null text, lang and source are ''; a group without terms gets counts of 0; a language without
kept terms gives pairs of value 0 and no terms; repeated rows count as often as they occur; an empty table
gives no rows; doc_id and all other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, brief_batches, salted_join, table, turn_of

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of text taken together by one pass of the tokenizer; cells and sources of a block; elements of a dense slice.
#: A block has at least four cells for each pair of sources that it gives a sum for.
CHUNK, CELLS, TILE, DENSE = 8 << 20, 32_768, 256, 1 << 21
#: Languages whose sums may be broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS = 100_000

#: What a byte is folded to if it belongs to a term, else 0.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

Digest = Callable[[bytes], int]


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Folded bytes of texts that lie end to end (between `offsets`), and where terms begin and end in them."""
    folded = FOLDED[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = folded != 0
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | fresh))
    ends = np.flatnonzero(before & (~inside | fresh))
    return folded.tobytes(), starts, ends


def grouped(folded: bytes, starts: np.ndarray, ends: np.ndarray, digest: Digest = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice the number of its term, and for each term a slice that spells it."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter((digest(folded[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    size, own = ends - starts, first[term]
    same = size == size[own]
    # bytes of all slices of the right length beside those of their group's first slice
    at = np.flatnonzero(same)
    width = size[at]
    inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    data = np.frombuffer(folded, np.uint8)
    differs = data[np.repeat(starts[at], width) + inner] != data[np.repeat(starts[own[at]], width) + inner]
    same[at] = np.add.reduceat(differs, np.cumsum(width) - width, dtype=np.int64) == 0 if len(at) else True
    firsts, spelt = first.tolist(), {}
    for i in np.flatnonzero(~same).tolist():
        word = folded[starts[i] : ends[i]]
        if word not in spelt:
            spelt[word] = len(firsts)
            firsts.append(i)
        term[i] = spelt[word]
    return term.astype(np.int64), np.array(firsts, np.int64)


def csr(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, column numbers and counts of the pairs (row, column)."""
    cells, counts = np.unique(rows * np.int64(max(n_columns, 1)) + columns, return_counts=True)
    at = cells // max(n_columns, 1)
    return np.searchsorted(at, np.arange(n_rows + 1)), cells % max(n_columns, 1), counts


def cells_of(texts: pa.Array, groups: np.ndarray, digest: Digest = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents for each group (a number for each text) and term that occurs in it."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    folded, starts, ends = slices(data, offsets)
    term, first = grouped(folded, starts, ends, digest)
    spelt = pa.array([folded[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())
    pointers, columns, counts = csr(np.searchsorted(offsets, starts, "right") - 1, term, len(texts), len(spelt))
    if not len(columns):
        return columns, spelt, counts, counts
    cells = np.repeat(groups, np.diff(pointers)) * len(spelt) + columns
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    rows, columns = np.divmod(cells[begins], len(spelt))
    return rows, spelt.take(pa.array(columns)), np.add.reduceat(counts, begins), np.diff(np.append(begins, len(cells)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


COUNTED = "lang string, source string, term string, count long, docs long"


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (that hold it), summed up by pieces of partitions; every group has a row of term '' too."""

    def run(batches):
        turn_of("divergence")
        for chunk in _chunks(batches):
            number: dict[tuple[str, str], int] = {}
            each = np.fromiter((number.setdefault(k, len(number)) for k in zip(chunk["lang"].to_pylist(), chunk["source"].to_pylist())), np.int64, chunk.num_rows)
            group, terms, counts, held = cells_of(_whole(chunk["text"]), each)
            langs, sources = (pa.array([k[i] for k in number]) for i in (0, 1))
            at = np.concatenate([np.arange(len(number)), group])
            spelt = pa.concat_arrays([pa.array([""] * len(number), pa.string()), terms])
            zeros = np.zeros(len(number), np.int64)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(at)), sources.take(pa.array(at)), spelt, pa.array(np.concatenate([zeros, counts])), pa.array(np.concatenate([zeros, held]))], ["lang", "source", "term", "count", "docs"])

    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(text).mapInArrow(run, COUNTED)
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total, terms) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), exact for totals up to 10^15."""
    bottom = np.asarray(total, np.int64) + 2 * np.asarray(terms, np.int64)
    whole, rest = np.divmod(np.asarray(count, np.int64) + 2, bottom)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, bottom)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PARTIAL = "lang string, source string, part string, item string, value long"


def _compared(group: pa.Table) -> pa.Table:
    """A block: heads (term null) name its sources with tile, N, V and the language's sums; cells have their counts.

    Gives each pair of sources (within the tile, or between the two), both ways, the sum over the block's terms of what
    lies beyond the value for terms that neither has, which the first block adds V times; and the TOP terms of each source.
    """
    turn_of("divergence")
    head = group.filter(pc.is_null(group["term"]))
    lang, terms_kept, lang_total, block = (head[c][0].as_py() for c in ("lang", "terms", "lang_total", "block"))
    one, two = head["one"][0].as_py(), head["two"][0].as_py()
    names = _whole(head["source"])
    total, tile = head["total"].to_numpy(), head["tile"].to_numpy()
    n, out = len(names), []
    cells = group.filter(pc.is_valid(group["term"]))
    sums = np.zeros((n, n), np.int64)
    if terms_kept:
        bare = shares(np.zeros(n, np.int64), total, terms_kept)
        base = apart(bare[:, None], bare[None, :])
        if block == 0:
            sums += base * terms_kept
        spelt = _whole(cells["term"]).dictionary_encode() if cells.num_rows else pa.array([], pa.string()).dictionary_encode()
        words, term = spelt.dictionary, spelt.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = pc.index_in(cells["source"], names).to_numpy(zero_copy_only=False).astype(np.int64)
        count = cells["count"].to_numpy()
        wide = max(1, DENSE // n)
        order = np.lexsort([term, row, term // wide])
        row, term, count = row[order], term[order], count[order]
        edges = np.searchsorted(term // wide, np.arange(len(words) // wide + 2))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a == b:
                continue
            r, t, c = row[a:b], term[a:b] - k * wide, count[a:b]
            p = shares(c, total[r], terms_kept)
            dense = np.zeros((min(wide, len(words) - k * wide), n), np.int64)
            dense[t, r] = p
            pointers = np.searchsorted(r, np.arange(n + 1))
            for x in range(0, len(r), wide):
                s, y = slice(x, x + wide), min(x + wide, len(r))
                other = dense[t[s]]
                absent = other == 0
                value = apart(p[s, None], np.where(absent, bare[None, :], other)) - base[r[s]]
                value[~absent & (np.arange(n)[None, :] <= r[s, None])] = 0  # a term that both have counts once
                begins = np.unique(np.clip(pointers, x, y))
                begins = begins[begins < y]
                at = r[begins]
                part = np.add.reduceat(value, begins - x, axis=0)
                sums[at] += part
                sums[:, at] += part.T
        if one == two and len(row):
            q = shares(_by_term(cells["lang_count"].to_numpy()[order], term, len(words)), lang_total, terms_kept)[term]
            p = shares(count, total[row], terms_kept)
            above = np.flatnonzero(p > q)
            value = apart(p[above], q[above])
            rank = _ranked(words, term[above])
            best = np.lexsort([rank, -value, row[above]])
            above, value = above[best], value[best]
            places = np.arange(len(above)) - np.searchsorted(row[above], row[above])
            top = places < TOP
            out.append((names.take(pa.array(row[above][top])), "term", words.take(pa.array(term[above][top])), value[top]))
    left, right = np.nonzero(~np.eye(n, dtype=bool) & ((one == two) | (tile[:, None] != tile[None, :])))
    out.append((names.take(pa.array(left)), "pair", names.take(pa.array(right)), sums[left, right]))
    return pa.concat_tables(pa.table([pa.array([lang] * len(v), pa.string()), s.cast(pa.string()), pa.array([part] * len(v), pa.string()), i.cast(pa.string()), pa.array(v, pa.int64())], names=["lang", "source", "part", "item", "value"]) for s, part, i, v in out)


def _by_term(values: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[term] = values
    return out


def _ranked(words: pa.Array, term: np.ndarray) -> np.ndarray:
    """Places of terms in the order of their UTF-8 bytes."""
    place = np.empty(len(words), np.int64)
    place[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
    return place[term]


def _by_lang(rows: DataFrame, langs: DataFrame, few: bool, spread: str) -> DataFrame:
    return rows.join(F.broadcast(langs), "lang") if few else salted_join(rows, langs, "lang", spread)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    if top > TOP:
        raise ValueError(f"at most {TOP} terms a group are kept")
    spark = docs.sparkSession
    run = Scratch(spark, "divergence")
    with brief_batches(spark, rows=2000):
        every = run.kept(counted(docs), "cells")
    # a term has one row a source at most
    of_term = W.partitionBy("lang", "term")
    known = every.where("term != ''").withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_count", F.sum("count").over(of_term))
    known = known.withColumn("first", (F.col("source") == F.min("source").over(of_term)).cast("long")).where(F.col("lang_docs") >= least_docs)
    cells = run.kept(known.select("lang", "source", "term", "count", "lang_count", "first"), "kept")
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.sum("first").alias("terms"), F.count("*").alias("cells"))
    groups = every.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0)
    groups = run.kept(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("total").alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / F.greatest(F.lit(CELLS), 4 * F.pow(F.least(F.count("*"), F.lit(TILE)), 2)))).alias("blocks"), F.ceil(F.count("*") / TILE).alias("tiles"))
    langs = run.kept(langs, "langs")
    few = langs.count() <= BROADCAST_ROWS
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    # each tile meets every tile, and itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1), lambda o: F.struct(F.least("tile", o).alias("one"), F.greatest("tile", o).alias("two")))
    heads = _by_lang(groups.select("lang", "source", "total"), langs, few, "source").select("*", tile)
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).withColumn("pair", F.explode(pairs))
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("lang", "block", "pair.one", "pair.two", "source", none("string").alias("term"), none("long").alias("count"), none("long").alias("lang_count"), "total", "tile", "terms", "lang_total")
    dealt = _by_lang(cells, langs.select("lang", "blocks", "tiles"), few, "term").select("*", tile, F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")).withColumn("pair", F.explode(pairs))
    dealt = dealt.select("lang", "block", "pair.one", "pair.two", "source", "term", "count", "lang_count", none("long").alias("total"), "tile", none("long").alias("terms"), none("long").alias("lang_total"))
    partial = heads.unionByName(dealt).groupBy("lang", "block", "one", "two").applyInArrow(_compared, PARTIAL)
    # a pair's value is the sum over blocks, a term's stands in one block
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    out = summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return run.result(out.select("lang", "source", "part", "item", "value", "rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
