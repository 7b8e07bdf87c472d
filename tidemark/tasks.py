"""The tasks: test-then-train evaluation of a learner, and evaluation of a clusterer or a clustering over horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluation, forest, hoeffding, horizons, micro
from tidemark.operators.ordered import numbered
from tidemark.storage import checkpointed, fresh_folder


def prequential(df: DataFrame, order: str, y: str, classes: list[str], learner="majority", numeric: list[str] = (), nominal: list[str] = (), limit: int | None = None, every: int = 100_000, width: int | None = None, batches: int = 10, test_every: int = 1, warm_up: int = 0) -> DataFrame:
    """A learning curve: n, accuracy, kappa, kappa_temporal after each `every` tested rows and at the end.

    `learner` is "majority", "hoeffding", a `HoeffdingTree`, or a `Forest`, which tests each of `batches` before it learns it; `limit` bounds the rows, as an option of the task.
    The first `warm_up` rows only train; of the rest every `test_every`-th is tested as well.
    """
    if learner not in ("majority", "hoeffding") and not isinstance(learner, (hoeffding.HoeffdingTree, forest.Forest)):
        raise ValueError(f"no learner {learner!r}")
    rows = numbered(df, order)
    if limit is not None and limit >= 0:
        rows = rows.where(F.col("rn") < limit)
    index = F.array_position(F.array(*map(F.lit, classes)), F.col(y)) - 1
    if learner == "majority":
        predicted = evaluation.majority(rows.withColumn("_y", index.cast("int")), "rn", "_y", len(classes)).select("rn", "_y", "pred")
    elif isinstance(learner, forest.Forest):
        if learner.classes != classes:
            raise ValueError("the forest has other classes")
        out = forest.prequential(rows, learner, "rn", y, batches, fresh_folder(df.sparkSession, "prequential"))
        predicted = out.select(F.col("idx").alias("rn"), F.col("y").alias("_y"), "pred")
    else:
        tree = learner if isinstance(learner, hoeffding.HoeffdingTree) else hoeffding.HoeffdingTree(classes, list(numeric), list(nominal))
        out = hoeffding.prequential(checkpointed(rows), tree, "rn", y, batches)
        named = lambda c: (F.array_position(F.array(*map(F.lit, classes)), F.col(c)) - 1).cast("int")
        predicted = out.select("rn", named(y).alias("_y"), named("pred").alias("pred"))
    if test_every != 1 or warm_up:
        predicted = predicted.where((F.col("rn") >= warm_up) & ((F.col("rn") - warm_up) % test_every == 0)).withColumn("rn", F.floor((F.col("rn") - warm_up) / test_every))
    curve = evaluation.classification(predicted, "rn", "_y", "pred", len(classes), width=width).select((F.col("rn") + 1).alias("n"), "accuracy", "kappa", "kappa_temporal")
    last = curve.agg(F.max("n").alias("n")).withColumnRenamed("n", "last")
    return curve.crossJoin(F.broadcast(last)).where((F.col("n") % every == 0) | (F.col("n") == F.col("last"))).drop("last")  # one row on the right


def clustering_evaluation(points: DataFrame, order: str, kernels: int = 100, horizon: int = 1000, k: int = 5, parts: int = 2) -> DataFrame:
    """Per horizon of the order: macro clusters of the horizon's kernels against its points' labels.

    Rows: horizon, ssq, van_dongen, rand.  Horizons are bounded windows, evaluated side by side.
    """
    return micro.horizons(numbered(points, order), horizon, kernels, k, parts)


def clustering_horizons(points: DataFrame, order: str, clusters: list, measures: list[str] = horizons.MEASURES, every: int = 1000, panes: int = 1) -> DataFrame:
    """sample, measure, value: a clustering against its points' labels over the last `panes` * `every` points, after each `every` of them."""
    return horizons.evaluated(points, order, clusters, every, panes, list(measures))
