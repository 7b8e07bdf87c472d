"""Topologies: named sources and processors, joined by streams that are dealt in one of three ways.

A stream is a DataFrame.  SHUFFLE deals rows in turn, KEY sends all rows of a key to one place, and ALL sends
every row to every place, whose number is in the column `copy`.  Nothing runs until a result is asked for;
a node that several others read is computed once a run of theirs, as Spark plans it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import hash_uniform
from tidemark.operators.ordered import numbered
from tidemark.protocols import Processor, Source, check

SHUFFLE, KEY, ALL = "shuffle", "key", "all"


def dealt(df: DataFrame, how: str = SHUFFLE, parallelism: int = 1, key: str | None = None) -> DataFrame:
    """`df` as `parallelism` places receive it."""
    if parallelism < 1:
        raise ValueError("parallelism is 1 or more")
    if how == SHUFFLE:
        return df.repartition(parallelism)
    if how == KEY:
        if key is None:
            raise ValueError("a stream dealt by key needs the key's column")
        return df.repartition(parallelism, key)
    if how == ALL:
        return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(parallelism - 1)))).repartition(parallelism, "copy")
    raise ValueError(f"streams are dealt by {SHUFFLE}, {KEY} or {ALL}, not {how!r}")


def in_turn(df: DataFrame, order: str, places: int) -> DataFrame:
    """Adds `place`: rows in order go to places 0, 1, ... in turn, in the same way every time."""
    return numbered(df, order).withColumn("place", F.pmod("rn", F.lit(places)).cast("int")).drop("rn")


def paced(df: DataFrame, order: str, size: int, delay: float = 0.0) -> DataFrame:
    """Adds `batch` and `sent`: `size` rows in order leave together, `delay` seconds after the batch before."""
    if size < 1:
        raise ValueError("a batch has 1 row or more")
    return numbered(df, order).withColumn("batch", F.floor(F.col("rn") / size)).withColumn("sent", F.col("batch") * float(delay)).drop("rn")


def flagged(df: DataFrame, order: str, test_every: int = 1, warm_up: int = 0) -> DataFrame:
    """Adds `testing` and `training`: the first `warm_up` rows only train; of the rest every `test_every`-th is tested as well."""
    rows = numbered(df, order)
    return rows.withColumns({"testing": (F.col("rn") >= warm_up) & ((F.col("rn") - warm_up) % test_every == 0), "training": F.lit(True)}).drop("rn")


@dataclass
class Greetings:
    """A source of `n` numbered greetings with numbers below 1000, the same in every run."""

    n: int
    seed: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        value = F.floor(hash_uniform(F.lit(str(self.seed)), F.col("idx").cast("string"), F.lit("hello")) * 1000).cast("long")
        return spark.range(self.n).withColumnRenamed("id", "idx").withColumn("value", value).withColumn("text", F.concat(F.lit("hello "), F.col("value").cast("string")))


@dataclass
class Table:
    """A source of the rows of a path that Spark reads."""

    path: str
    kind: str = "parquet"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.kind).load(self.path)


@dataclass
class Step:
    """A processor made of a function."""

    of: Callable[..., DataFrame]

    def process(self, *inputs: DataFrame) -> DataFrame:
        return self.of(*inputs)


def projected(**columns: Column) -> Step:
    """A processor that adds columns."""
    return Step(lambda df: df.withColumns(columns))


class Topology:
    """A graph without cycles: sources first, then processors on what is there already.  Loops (a model that
    goes back to its learners) are loops over micro-batches, see `streaming.stateful`."""

    def __init__(self, name: str):
        self.name, self._sources, self._steps = name, {}, {}

    def source(self, name: str, source: Source) -> str:
        self._new(name)
        self._sources[name] = check(source, Source)
        return name

    def through(self, name: str, processor: Processor, *inputs: str, how: str = SHUFFLE, parallelism: int = 1, key: str | None = None) -> str:
        """A processor on the streams of `inputs`, each dealt to `parallelism` places."""
        self._new(name)
        unknown = [i for i in inputs if i not in self._sources and i not in self._steps]
        if unknown or not inputs:
            raise ValueError(f"{name} needs inputs that are there already, not {unknown or 'none'}")
        self._steps[name] = check(processor, Processor), inputs, how, parallelism, key
        return name

    def _new(self, name: str) -> None:
        if name in self._sources or name in self._steps:
            raise ValueError(f"{name} is there already")

    def stream(self, spark: SparkSession, name: str) -> DataFrame:
        """What the node of that name sends."""
        if not self._sources:
            raise ValueError(f"topology {self.name} has no source")
        made = {k: s.rows(spark) for k, s in self._sources.items()}
        for k, (processor, inputs, how, parallelism, key) in self._steps.items():
            made[k] = processor.process(*(dealt(made[i], how, parallelism, key) for i in inputs))
        return made[name]


def hello_world(n: int, parallelism: int = 2, seed: int = 1) -> Topology:
    """The smallest task: greetings, dealt in turn to processors that pass them on in capitals."""
    out = Topology("hello world")
    out.source("greetings", Greetings(n, seed))
    out.through("shouted", projected(text=F.upper("text")), "greetings", parallelism=parallelism)
    return out
