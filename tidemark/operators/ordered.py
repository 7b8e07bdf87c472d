"""Running, sliding and as-of aggregates over one global order, without one global task.

A plain window without a partition key sorts the whole table in one task.  Here rows are cut into
blocks between approximate quantiles of the order, so blocks hold about as many rows each however its
values lie; sums run within a block, and the totals of earlier blocks (one row a block) are added.
Sliding windows get the last rows of the block before as context.

The order column is numeric or a time; rows whose order is null come first, as one block, and none is dropped.
A column `_block` that is there already (see `blocked`) is used and kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most rows aimed at in a block, the least, and the most blocks: one row a block meets in one task, and is broadcast, as a join by sorting
#: holds a partition once more, and all rows where few columns compress to little.
BLOCK, LEAST, BLOCKS = 50_000, 2_000, 10_000
#: Widths up to which a sliding sum adds its frame up anew; wider ones are differences of running sums.
NARROW = 64


def blocked(df: DataFrame, order: str, block: int | None = None) -> DataFrame:
    """Adds `_block`, a whole number that rises with the order; null orders are block -1."""
    from pyspark.ml.feature import Bucketizer

    value = F.col(order).cast("double")
    n = df.agg(F.count(value)).first()[0]
    if block is None:
        block = min(BLOCK, max(LEAST, n // (2 * df.sparkSession.sparkContext.defaultParallelism)))
    k = min(BLOCKS, math.ceil(n / block))
    cuts = []
    if k > 1:
        cuts = df.agg(F.percentile_approx(value, [i / k for i in range(1, k)], max(10_000, 4 * k))).first()[0]
    cuts = sorted({c for c in cuts if math.isfinite(c)})
    if not cuts:
        return df.withColumn("_block", F.when(F.col(order).isNull(), -1).otherwise(0))
    cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol="_cut", handleInvalid="keep").transform(df.withColumn("_at", value))
    return cut.withColumn("_block", F.when(F.col(order).isNull(), -1).otherwise(F.col("_cut").cast("int"))).drop("_at", "_cut")


def in_blocks(df: DataFrame, order: str) -> DataFrame:
    """`df` with `_block`, as it is there or made now."""
    return df if "_block" in df.columns else blocked(df, order)


def _cut(df: DataFrame, order: str, block: int | None) -> tuple[DataFrame, list[str]]:
    """The blocked rows, and what to drop from them in the end."""
    return (df, []) if "_block" in df.columns else (blocked(df, order, block), ["_block"])


def numbered(df: DataFrame, order: str, block: int | None = None) -> DataFrame:
    """Adds `rn`, the 0-based rank by the (unique) order column."""
    cut, gone = _cut(df, order, block)
    sizes = cut.groupBy("_block").agg(F.count("*").alias("n"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    sizes = sizes.select("_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(W.partitionBy("_block").orderBy(order))
    return cut.withColumn("_own", own).join(F.broadcast(sizes), "_block").withColumn("rn", F.col("_base") + F.col("_own") - 1).drop("_own", "_base", *gone)


def running(df: DataFrame, order: str, sums: dict[str, Column], before: bool = False, block: int | None = None) -> DataFrame:
    """Adds running sums over the order; `before` leaves the row itself out (0 at the first row)."""
    cut, gone = _cut(df, order, block)
    cut = cut.withColumns({f"_{k}": c for k, c in sums.items()})
    totals = cut.groupBy("_block").agg(*(F.sum(f"_{k}").alias(k) for k in sums))
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_block", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_base_{k}") for k in sums))
    own = W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    out = cut.withColumns({f"_{k}": F.coalesce(F.sum(f"_{k}").over(own), F.lit(0)) for k in sums}).join(F.broadcast(totals), "_block")
    return out.withColumns({k: F.col(f"_{k}") + F.col(f"_base_{k}") for k in sums}).drop(*gone, *(f"_{k}" for k in sums), *(f"_base_{k}" for k in sums))


def previous(df: DataFrame, order: str, column: str, default, block: int | None = None) -> DataFrame:
    """Adds `previous`: the column's value in the row before, over all blocks."""
    cut, gone = _cut(df, order, block)
    # plain values, so that Spark hashes blocks; with structs it would sort all rows, in as few tasks as their size after compression asks for
    last = F.when(F.first("_block") == -1, F.last(column)).otherwise(F.max_by(column, order))
    last = cut.groupBy("_block").agg(last.alias("_last"))
    last = last.select("_block", F.lag("_last").over(W.orderBy("_block")).alias("_carry"))
    by = W.partitionBy("_block").orderBy(order)
    out = cut.withColumns({"_own": F.lag(column).over(by), "_first": F.row_number().over(by) == 1}).join(F.broadcast(last), "_block")
    return out.withColumn("previous", F.coalesce(F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_own")), F.lit(default))).drop("_own", "_first", "_carry", *gone)


def sliding(df: DataFrame, order: str, width: int, sums: dict[str, Column], block: int | None = None) -> DataFrame:
    """Adds sums over the last `width` rows, the row itself included, and the global `rn`."""
    cut = numbered(df, order, block)
    size = max(block or LEAST, 4 * width)
    cut = cut.withColumns({f"_{k}": c for k, c in sums.items()}).withColumn("_home", F.floor(F.col("rn") / size))
    # rows near the end of a block also stand, as context, before the next one
    near = F.when(F.col("rn") % size >= size - (width - 1), F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    cut = cut.withColumn("_here", F.explode(near))
    by = W.partitionBy("_here").orderBy("rn")
    if width <= NARROW:
        cut = cut.withColumns({k: F.sum(f"_{k}").over(by.rowsBetween(-(width - 1), W.currentRow)) for k in sums})
    else:
        cut = cut.withColumns({f"_{k}": F.sum(F.coalesce(f"_{k}", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)) for k in sums})
        cut = cut.withColumns({k: F.col(f"_{k}") - F.coalesce(F.lag(f"_{k}", width).over(by), F.lit(0)) for k in sums})
    return cut.where("_here = _home").drop("_home", "_here", *(f"_{k}" for k in sums))


def latest(rows: DataFrame, told: DataFrame, ts: str, columns: list[str], block: int | None = None) -> DataFrame:
    """As-of join: `columns` of the newest row of `told` at or before each row (null where there is none).

    Both sides meet in one order, where what is told stands before rows of the same time; of several told at one
    time the last by the columns' values counts.  Rows without a time are told nothing.
    """
    names = [f"_told_{c}" for c in columns]
    value = F.struct(F.lit(True).alias("told"), *(F.col(c).alias(n) for c, n in zip(columns, names)))
    none = F.lit(None)
    both = told.where(F.col(ts).isNotNull()).select(F.col(ts).alias(ts), value.alias("_value"), F.lit(0).alias("_side"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    both = both.unionByName(rows.select(F.col(ts).alias(ts), none.cast(both.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_side"), F.struct("*").alias("_row")))
    both = blocked(both, ts, block)
    newest = both.groupBy("_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(ts, "_value"))).alias("_last"))
    newest = newest.select("_block", F.last("_last", True).over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    by = W.partitionBy("_block").orderBy(ts, "_side", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_own", F.last("_value", True).over(by)).where("_side = 1").join(newest, "_block")
    got = F.when(F.col(f"_row.{ts}").isNotNull(), F.coalesce("_own", "_carry"))
    return out.select("_row.*", *(got[n].alias(c) for c, n in zip(columns, names)))
