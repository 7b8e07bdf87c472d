"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts can be very long, so batches are kept short.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir (or the context) names it.

    Only where all runs on one machine (tests) may it be unset: a temporary folder is used then.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files of DataFrames that are made in here go as soon as an action on them ends.

    Otherwise they stay until the driver happens to collect its garbage, and the disk must hold those of all
    steps together.  For frames that are used once, as by `checkpointed`; a second action on one makes them anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def settings(spark: SparkSession, **options: str):
    """Session options (dots written as __) that hold in here and are as before afterwards."""
    named = {k.replace("__", "."): v for k, v in options.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def brief_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = 8 << 20):
    """Arrow batches of at most so many rows and about so many bytes, for jobs that run in here."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows), spark__sql__execution__arrow__maxBytesPerBatch=str(size))


class Scratch:
    """Folders of one run in the shared folder: tables between its steps, removed once its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """`df` written as Parquet and read again, so that a lost executor costs the writing tasks at most."""
        df.write.partitionBy(*by).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def result(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}-result")
        self.close()
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}-result")

    def close(self) -> None:
        removed(self.spark, self.folder)


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """Join of `rows` with a table of unique keys, without a task for all rows of one key.

    Rows of a key are dealt to `salts` places by the column `spread`; the table's row is copied to
    those places only that the key has, so it never grows beyond the number of rows.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    places = rows.groupBy(key).agg(F.collect_set("_salt").alias("_salt"))
    copies = table.join(places, key).withColumn("_salt", F.explode("_salt"))
    return rows.join(copies, [key, "_salt"], how).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: What empties the caches of an operator in this process, by operator; the operator that ran last.
_empties: dict[str, Callable[[], None]] = {}
_turn = [""]


def keeps_caches(operator: str, empty: Callable[[], None]) -> None:
    """Tell how the caches that an operator fills in a Python worker are emptied."""
    _empties[operator] = empty


def turn_of(operator: str) -> None:
    """Called first in what runs in a Python worker: empties the caches of the operators before, and gives their memory back.

    Spark lends a worker to one stage after the other, so caches of all operators would add up in it.
    """
    if _turn[0] == operator:
        return
    for name, empty in _empties.items():
        if name != operator:
            empty()
    _turn[0] = operator
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


class ChunkCache(dict):
    """Values by white-space delimited chunk, made on first use; emptied when it grows too large."""

    LIMIT = 400_000

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        if len(self) >= self.LIMIT:
            self.clear()
        value = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = value
        return value
