"""Test-then-train evaluation: majority class, classification and regression metrics, learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_blocks, previous, running, sliding


MEASURES = ["accuracy", "kappa", "kappa_temporal"]


def first_max(values: list[Column]) -> Column:
    """Index of the largest value, the lowest index among equals."""
    best = F.greatest(*values)
    out = F.lit(len(values) - 1)
    for k in range(len(values) - 2, -1, -1):
        out = F.when(values[k] == best, k).otherwise(out)
    return out.cast("int")


def majority(df: DataFrame, order: str, y: str, classes: int) -> DataFrame:
    """Adds `pred`: the most frequent class among all earlier rows (class 0 at first)."""
    out = running(df, order, {f"seen{c}": (F.col(y) == c).cast("long") for c in range(classes)}, before=True)
    return out.withColumn("pred", first_max([F.col(f"seen{c}") for c in range(classes)])).drop(*(f"seen{c}" for c in range(classes)))


def _sums(y: str, pred: str, classes: int, weight: Column) -> dict[str, Column]:
    out = {"w": weight, "hit": weight * (F.col(pred) == F.col(y)).cast("double"), "same": weight * (F.col("previous") == F.col(y)).cast("double")}
    for c in range(classes):
        out |= {f"t{c}": weight * (F.col(y) == c).cast("double"), f"p{c}": weight * (F.col(pred) == c).cast("double")}
    return out


def _metrics(df: DataFrame, classes: int) -> DataFrame:
    w = F.col("w")
    p0, pt = F.col("hit") / w, F.col("same") / w
    pc = sum((F.col(f"t{c}") * F.col(f"p{c}") / (w * w) for c in range(1, classes)), F.col("t0") * F.col("p0") / (w * w))
    kappa = lambda e: F.when(e < 1, (p0 - e) / (1 - e))
    return df.withColumns({"accuracy": 100 * p0, "kappa": 100 * kappa(pc), "kappa_temporal": 100 * kappa(pt)})


def classification(df: DataFrame, order: str, y: str, pred: str, classes: int, weight: Column | None = None, width: int | None = None) -> DataFrame:
    """Accuracy, kappa and kappa against the no-change classifier (percent) after each row, over all rows
    so far or the last `width`; rows of weight 0 or less do not count; the class before the first is 0."""
    weight = F.lit(1.0) if weight is None else weight
    rows = previous(in_blocks(df.where(weight > 0), order), order, y, 0)
    sums = _sums(y, pred, classes, weight)
    rows = running(rows, order, sums) if width is None else sliding(rows, order, width, sums)
    return _metrics(rows, classes).select(*df.columns, *(["rn"] if width else []), *MEASURES)


def classification_total(df: DataFrame, order: str, y: str, pred: str, classes: int) -> DataFrame:
    """The metrics of the whole stream in one row; partial sums only are shuffled."""
    rows = previous(df, order, y, 0)
    sums = _sums(y, pred, classes, F.lit(1.0))
    return _metrics(rows.agg(*(F.sum(c).alias(k) for k, c in sums.items())), classes).select(F.col("w").cast("long").alias("instances"), "accuracy", "kappa", "kappa_temporal")


def regression(df: DataFrame, order: str, y: str, pred: str) -> DataFrame:
    """MAE, RMSE and both relative to the running mean of the target before each row (0 at first)."""
    rows = running(in_blocks(df, order), order, {"seen": F.lit(1).cast("long"), "total": F.col(y)}, before=True)
    base = F.when(F.col("seen") > 0, F.col("total") / F.col("seen")).otherwise(0.0)
    error, usual = F.col(pred) - F.col(y), base - F.col(y)
    rows = rows.withColumns({"e1": F.abs(error), "e2": error * error, "b1": F.abs(usual), "b2": usual * usual}).drop("seen", "total")
    rows = running(rows, order, {"n": F.lit(1).cast("long"), **{f"s_{k}": F.col(k) for k in ("e1", "e2", "b1", "b2")}})
    out = {"mae": F.col("s_e1") / F.col("n"), "rmse": F.sqrt(F.col("s_e2") / F.col("n")), "relative_mae": F.col("s_e1") / F.nullif(F.col("s_b1"), F.lit(0.0)), "relative_rmse": F.sqrt(F.col("s_e2") / F.nullif(F.col("s_b2"), F.lit(0.0)))}
    return rows.withColumns(out).select(*df.columns, "n", *out)


def sampled(curve: DataFrame, n: Column, every: int) -> DataFrame:
    """Rows of a curve after each `every` rows."""
    return curve.where(n % every == 0)


def curve_rows(curve: DataFrame, order: str, measures: list[str]) -> DataFrame:
    """A learning curve as (order, name, value) rows; absent values are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in measures)))
    return curve.select(order, pairs.alias("m")).select(order, "m.name", "m.value").where("value is not null")


def curve_columns(rows: DataFrame, order: str, measures: list[str]) -> DataFrame:
    """The inverse of `curve_rows`: one column per measure, absent ones null."""
    return rows.groupBy(order).pivot("name", measures).agg(F.first("value"))


def measure_summary(df: DataFrame, name: str, value: str) -> DataFrame:
    """Minimum, maximum, mean, standard error, median and quartiles of each measure's series."""
    return df.groupBy(name).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_error"),
        F.expr(f"percentile({value}, 0.25)").alias("lower"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.75)").alias("upper"),
    )


def running_mean(df: DataFrame, order: str, y: str, width: int = 10) -> DataFrame:
    """Adds `pred`: the mean of the last `width` values before each row (0 at first)."""
    rows = sliding(df, order, width + 1, {"_n": F.lit(1).cast("long"), "_s": F.col(y)})
    n = F.col("_n") - 1
    return rows.withColumn("pred", F.when(n > 0, (F.col("_s") - F.col(y)) / n).otherwise(0.0)).drop("_n", "_s", "rn")
