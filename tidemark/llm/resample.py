"""Target-distribution importance resampling over hashed n-grams, counted by DuckDB within each partition.

A task hands its Arrow batches to a DuckDB connection of its own: SQL lower-cases A-Z, finds words, unnests
them with their places and makes n-grams by window functions; a registered function gives the CRC-32 of an
n-gram, as zlib has it, and its remainder is the bucket.  Two kinds of rows are spilled to Parquet by Spark's
committer, so that a task that is run again is not counted twice: the buckets of each document with their
counts (no more than BUCKETS of them, however long the text), and the sums of a task's documents.  Spark
merges the sums of all tasks, makes a gain of each bucket, and scores the spilled documents with them.

The draw is without replacement: weight plus a Gumbel variate that follows from a seed and the doc_id, so
that the same documents are drawn on every run and on any cluster.  Scores are whole numbers of a bounded
range, so ranks follow from a histogram of the scores, however many documents there are, and the places
within one score.

Defined results: a null text has no words; a text without words has weight 0; a null doc_id draws by the text of
its seed alone and comes last among equal scores; rows that share a doc_id are scored each, ranks of rows that are
equal in score and doc_id are consecutive; an empty table gives no rows, and an empty target or source counts 0
throughout; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, brief_batches, table, turn_of

WORDS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one DuckDB statement takes at a time, and what a connection may hold in memory.
STATEMENT_BYTES, MEMORY = 4 << 20, "400MB"
SPILLED = "total boolean, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def feature_sql(words: int, buckets: int) -> str:
    """Rows of `batch` (line, text) -> line, bucket, n: features are all runs of 1 to `words` consecutive words."""
    run = lambda k: " || ' ' || ".join(["word", *(f"lead(word, {i}) over places" for i in range(1, k))])
    grams = " union all ".join(f"select line, {run(k)} as gram from token window places as (partition by line order by place)" for k in range(1, words + 1))
    return rf"""with said as (select line, regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from batch),
 token as (select line, unnest(words) as word, generate_subscripts(words, 1) as place from said),
 found as (select line, gram, count(*) as n from ({grams}) where gram is not null group by line, gram),
 named as (select gram, zlib_crc32(gram) % {buckets} as bucket from (select distinct gram from found))
 select line::bigint as line, bucket::integer as bucket, sum(n)::bigint as n from found join named using (gram) group by line, bucket order by line, bucket"""


def connection():
    """A DuckDB connection in memory with zlib's CRC-32 registered as a function of strings."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
    crc = lambda texts: pa.array([zlib.crc32(t.encode()) for t in texts.to_pylist()], pa.int64())
    con.create_function("zlib_crc32", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, cut between rows so that a piece holds STATEMENT_BYTES of text or one row."""
    ends = np.cumsum([0, *(len(t) for t in batch.column(1).cast(pa.binary()).to_pylist())])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STATEMENT_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _arrays(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def counted(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Rows of SPILLED: one of each document, and one of each task (total) that sums up its documents."""
    sql = feature_sql(words, buckets)

    def run(batches):
        turn_of("resample")
        con, sums = connection(), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in _pieces(whole):
                n = batch.num_rows
                con.register("batch", pa.table({"line": pa.array(np.arange(n)), "text": batch.column(1)}))
                got = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                at, bucket, count = (got[c].to_numpy() for c in ("line", "bucket", "n"))
                np.add.at(sums, bucket, count)
                starts = np.searchsorted(at, np.arange(n + 1))
                before = np.concatenate([[0], np.cumsum(count)])
                features = before[starts[1:]] - before[starts[:-1]]
                # of m words there are m, m - 1, ... runs of 1, 2, ... words
                said = features if words == 1 else _words_of(features, words)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), batch.column(0), pa.array(said), pa.array(features), _arrays(starts, bucket, pa.int32()), _arrays(starts, count, pa.int64())], _NAMES)
        held = np.flatnonzero(sums)
        ends = np.array([0, len(held)])
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([0]), pa.array([int(sums.sum())]), _arrays(ends, held, pa.int32()), _arrays(ends, sums[held], pa.int64())], _NAMES)
        con.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SPILLED)


_NAMES = [c.split()[0] for c in SPILLED.split(", ")]


def _words_of(features: np.ndarray, words: int) -> np.ndarray:
    """The numbers of words that give so many features: below `words` words, m words have m (m + 1) / 2 runs."""
    short = np.cumsum(np.arange(words + 1))
    most = short[-1]  # of `words` words; each word more adds `words` runs
    return np.where(features <= most, np.searchsorted(short, features), words + (features - most) // words)


def merged(spilled: DataFrame) -> DataFrame:
    """bucket, n: at most so many rows as there are buckets."""
    return spilled.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(spark: SparkSession, source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: a thousand log ratios of the target's smoothed share and the source's, floored."""
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    # the sums come from the tables of at most so many rows again, so no window over all buckets is needed
    sums = both.groupBy().agg(F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (sums.S + buckets) / ((s + 1) * (sums.T + buckets)))).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel variate of a document, floored; between -3,094 and 22,873."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` (doc_id, n_words, score, ...) with rank: null but for the drawn ones.

    A histogram of the scores gives the ranks at which each begins: scores lie in a range of some 150,000 whole numbers,
    whatever the corpus.  They are summed in classes of 256 first, so that no task reads them all.  Only rows that can be
    drawn are then ordered, each score by itself; a score holds a ten-thousandth of the rows at most, as Gumbel variates do.
    """
    able = scored.where(F.col("n_words") >= least_words)
    hist = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("class", F.floor(F.col("score") / 256))
    classes = hist.groupBy("class").agg(F.sum("n").alias("held"))
    # at most 600 classes
    classes = classes.withColumn("above", F.sum("held").over(W.orderBy(F.col("class").desc()).rowsBetween(W.unboundedPreceding, -1)))
    within = F.sum("n").over(W.partitionBy("class").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1))
    starts = hist.join(classes, "class").select("score", (F.coalesce("above", F.lit(0)) + F.coalesce(within, F.lit(0))).alias("before"))
    draws = (able.count() * percent) // 100
    place = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    drawn = able.join(starts.where(F.col("before") < draws), "score").withColumn("rank", F.col("before") + place)
    rest = scored.where((F.col("n_words") < least_words) | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("long"))
    low = able.join(starts.where(F.col("before") >= draws), "score").withColumn("rank", F.lit(None).cast("long"))
    columns = [*scored.columns, F.when(F.col("rank") <= draws, F.col("rank")).cast("long").alias("rank")]
    return drawn.select(columns).unionByName(low.select(columns)).unionByName(rest.select(columns))


def resampled(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; `target` needs the column text only."""
    spark = docs.sparkSession
    run = Scratch(spark, "resample")
    with brief_batches(spark):
        source = run.kept(counted(docs, words, buckets), "source", "total")
        wanted = run.kept(counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), words, buckets).where("total"), "target")
    # as many whole numbers as there are buckets; Spark folds the text into one array
    gain = [r.gain for r in gains(spark, merged(source), merged(wanted), buckets).orderBy("bucket").collect()]
    table_of = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(table_of, b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    each = source.where("not total").select("doc_id", "n_words", "n_features", total.alias("gained"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = each.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = run.kept(scored, "scored")
    return run.result(ranked(scored, percent, least_words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
