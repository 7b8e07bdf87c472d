"""What pluggable parts must offer.  Anything of that shape will do; nothing needs to be inherited."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@runtime_checkable
class Source(Protocol):
    """Where rows come from: a table, files, a generator."""

    def rows(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class Processor(Protocol):
    """A step of a topology: from the streams that reach it to the one it sends."""

    def process(self, *inputs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Learner(Protocol):
    """A row-by-row model: a vote per class (or one number), and one row learned."""

    def votes(self, x: dict[str, Any]) -> list[float]: ...

    def learn(self, x: dict[str, Any], y: float, weight: float = 1.0) -> None: ...


@runtime_checkable
class Evaluator(Protocol):
    """Measures of predictions, a row after each row or window."""

    def measure(self, df: DataFrame, order: str, y: str, pred: str) -> DataFrame: ...


@runtime_checkable
class Clusterer(Protocol):
    """Clusters (kernel or cluster, centre or sums, weight) of points in an order."""

    def __call__(self, points: DataFrame, order: str) -> DataFrame: ...


@runtime_checkable
class Observer(Protocol):
    """A small summary of one attribute, and the cuts it suggests."""

    def add(self, x: float, y: Any) -> None: ...

    def cuts(self) -> list: ...


def check(part: Any, kind: type) -> Any:
    """`part`, if it is of that kind."""
    if not isinstance(part, kind):
        missing = [m for m in kind.__protocol_attrs__ if not hasattr(part, m)]
        raise TypeError(f"{type(part).__name__} is no {kind.__name__}: it lacks {', '.join(sorted(missing))}")
    return part


def check_schema(df: DataFrame, numeric: Sequence[str] = (), nominal: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """`df`, if it has the columns a learner was set up for, of kinds it can use."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in (*numeric, *nominal, *([target] if target else [])) if c not in fields]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    wrong = [c for c in numeric if not isinstance(fields[c], (T.NumericType, T.BooleanType))]
    if wrong:
        raise ValueError(f"columns are not numeric: {', '.join(wrong)}")
    return df
