"""Models that learn a stream, kept together with the number of the micro-batch they have learned.

A store is a folder.  A micro-batch is learned as a whole or in runs of so many rows of its order.  A run writes its
predictions and then the model as it is now under names of its own attempt; last, a marker, made by a rename, says that the
attempt counts.  If a stream dies before the marker, the batch comes again under its number and the run is learned again
from the model of the run before; what the dead attempt wrote is never read.  If it dies after it, the run is left out when
the batch comes again.  So every row is learned once.  One query of a stream writes to a store at a time, as Structured
Streaming has it for a checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import forest
from tidemark.operators.ordered import numbered
from tidemark.storage import names, put_text, removed, text_of

from .stateful import micro_batches


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def attempts(self) -> list[str]:
        """Attempts that count, in the order of their batches and runs."""
        return [n.removeprefix("done-") for n in names(self.spark, self.folder) if n.startswith("done-")]

    def latest(self) -> tuple[int, int, str | None]:
        """Batch and run that were learned last, and the model's text after them; -1, -1, None at first."""
        found = self.attempts()
        if not found:
            return -1, -1, None
        batch, run, _ = found[-1].split("-")
        return int(batch), int(run), text_of(self.spark, f"{self.folder}/model-{found[-1]}")

    def begin(self, batch: int, run: int) -> tuple[str, str]:
        """A new attempt, and the folder for its predictions."""
        attempt = f"{batch:09d}-{run:09d}-{uuid.uuid4().hex}"
        return attempt, f"{self.folder}/rows/attempt={attempt}"

    def commit(self, attempt: str, model: str) -> None:
        put_text(self.spark, f"{self.folder}/model-{attempt}", model)
        put_text(self.spark, f"{self.folder}/done-{attempt}", "")
        for name in names(self.spark, self.folder):
            if name.startswith("model-") and name != f"model-{attempt}":
                removed(self.spark, f"{self.folder}/{name}")

    def rows(self, passed: str = forest.PASSED) -> DataFrame:
        """batch, run, idx, y, pred of all attempts that count; `passed` is the schema of what the model's pass gives."""
        folders = [f"{self.folder}/rows/attempt={a}" for a in self.attempts()]
        if not folders:
            return self.spark.createDataFrame([], f"batch int, run int, {passed}").select("batch", "run", "idx", "y", "pred")
        found = self.spark.read.schema(f"{passed}, attempt string").option("basePath", f"{self.folder}/rows").parquet(*folders).where("part = 'row'")
        place = F.split("attempt", "-")
        return found.select(place[0].cast("int").alias("batch"), place[1].cast("int").alias("run"), "idx", "y", "pred")


def learned(batch: DataFrame, number: int, model, store: Store, order: str, y: str, rows: int | None = None) -> None:
    """Learn what is not yet learned of a micro-batch (a `Forest`, or a model of its shape), in runs of `rows` of its order (all at once without it)."""
    spark = batch.sparkSession
    done, last, text = store.latest()
    if number < done or number == done and rows is None:
        return
    if text:
        model.restored(text)
    between, runs = None, [0]
    if rows is not None:
        # rows that come again are numbered as before
        between = f"{store.folder}/_input-{uuid.uuid4().hex}"
        columns = list(dict.fromkeys([order, y, *model.columns]))
        cut = numbered(batch.select(columns), order).withColumn("_run", F.floor(F.col("rn") / rows).cast("int")).drop("rn")
        cut.write.partitionBy("_run").parquet(between)
        given = spark.read.schema(cut.schema).parquet(between)
        runs = range(-(-given.count() // rows))
    for run in runs:
        if number == done and run <= last:
            continue
        attempt, folder = store.begin(number, run)
        part = batch if rows is None else given.where(F.col("_run") == run).drop("_run")
        model.test_then_learn(part, order, y, folder)
        store.commit(attempt, model.to_json())
    if between:
        removed(spark, between)


def learn(stream: DataFrame, model, store: Store, order: str, y: str, checkpoint: str, rows: int | None = None):
    """A streaming query that tests and then learns every micro-batch once; what is there runs through, and it ends."""
    return micro_batches(stream, lambda batch, number: learned(batch, number, model, store, order, y, rows), checkpoint)
