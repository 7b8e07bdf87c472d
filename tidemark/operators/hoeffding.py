"""Hoeffding tree as a loop over micro-batches.

The tree is a small object on the driver, compiled to one Column that gives each row its leaf.  After a
batch one grouped aggregate updates the additive statistics of (leaf, attribute, class): moments for
numeric attributes, counts for nominal values.  Only these (leaves x attributes x classes x values)
reach the driver, where a leaf past its grace period may split.  Within a batch the tree is fixed and
class counts change row by row, so test-then-train predictions are exact.  A nominal attribute of very many
values (more than `max_values` a leaf) is refused, as its counts would not be bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import in_blocks
from .statistics import long_form


def info_gain(pre: np.ndarray, post: list[np.ndarray]) -> float:
    """Bits gained; minus infinity unless two branches have over 1 % of the weight."""

    def bits(w):
        w = w[w > 0]
        return float(np.log2(w.sum()) - (w * np.log2(w)).sum() / w.sum()) if len(w) else 0.0

    total = sum(p.sum() for p in post)
    if total <= 0 or sum(p.sum() > 0.01 * total for p in post) < 2:
        return -math.inf
    return bits(pre) - sum(p.sum() / total * bits(p) for p in post)


def gini_gain(pre: np.ndarray, post: list[np.ndarray]) -> float:
    total = sum(p.sum() for p in post)
    return 1 - sum(p.sum() / total * (1 - ((p / p.sum()) ** 2).sum()) for p in post if p.sum() > 0) if total else -math.inf


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@dataclass
class Node:
    """A leaf, or a split with one child per branch (numeric: at most, above; nominal: per value, then others)."""

    id: int
    counts: np.ndarray
    depth: int = 0
    seen: float = 0.0
    checked: float = 0.0
    numeric: dict[str, np.ndarray] = field(default_factory=dict)  # attribute -> classes x (n, s, q, low, high)
    nominal: dict[str, dict[str, np.ndarray]] = field(default_factory=dict)
    attribute: str = ""
    cut: float | None = None
    values: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


class HoeffdingTree:
    def __init__(self, classes: list[str], numeric: list[str], nominal: list[str] = (), grace: int = 200, delta: float = 1e-7, tie: float = 0.05, criterion=info_gain, candidates: int = 10, binary: bool = False, max_leaves: int = 1000, max_values: int = 1000):
        self.classes, self.numeric, self.nominal = classes, list(numeric), list(nominal)
        self.grace, self.delta, self.tie, self.criterion = grace, delta, tie, criterion
        self.candidates, self.binary, self.max_leaves, self.max_values = candidates, binary, max_leaves, max_values
        self.root, self.made, self.splits = Node(0, np.zeros(len(classes))), 1, 0

    def leaves(self) -> list[Node]:
        out, stack = [], [self.root]
        while stack:
            n = stack.pop()
            (stack.extend(n.children) if n.children else out.append(n))
        return sorted(out, key=lambda n: n.id)

    def sizes(self) -> dict[str, int]:
        leaves = self.leaves()
        return {"leaves": len(leaves), "splits": self.made - len(leaves), "depth": max(n.depth for n in leaves)}

    def leaf(self) -> Column:
        """The number of the leaf that a row reaches; a missing value takes the heaviest branch."""

        def walk(n: Node) -> Column:
            if not n.children:
                return F.lit(n.id)
            heavy = walk(max(n.children, key=lambda c: c.counts.sum()))
            c = F.col(n.attribute)
            if n.cut is not None:
                return F.when(c.isNull(), heavy).when(c <= n.cut, walk(n.children[0])).otherwise(walk(n.children[1]))
            out = F.when(c.isNull(), heavy)
            for v, child in zip(n.values, n.children):
                out = out.when(c.cast("string") == v, walk(child))
            return out.otherwise(walk(n.children[-1]) if len(n.children) > len(n.values) else heavy)

        return walk(self.root)

    def _argmax(self, counts: list[Column]) -> Column:
        best, out = F.greatest(*counts), F.lit(self.classes[-1])
        for c, v in reversed(list(zip(self.classes[:-1], counts[:-1]))):
            out = F.when(v == best, F.lit(c)).otherwise(out)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `leaf` and `pred` from the tree as it is."""
        names = {n.id: self.classes[int(n.counts.argmax())] for n in self.leaves()}
        known = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
        return df.withColumn("leaf", self.leaf()).withColumn("pred", known[F.col("leaf")])

    def predict_then_learn(self, df: DataFrame, order: str, y: str) -> DataFrame:
        """Adds `leaf` and `pred` as seen before each row of one batch: counts of the leaf so far."""
        rows = in_blocks(df, order).withColumn("leaf", self.leaf())
        names = [f"_seen{k}" for k in range(len(self.classes))]
        own = W.partitionBy("leaf", "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        earlier = W.partitionBy("leaf").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
        each = [F.sum((F.col(y) == c).cast("double")) for c in self.classes]
        told = rows.groupBy("leaf", "_block").agg(*(e.alias(n) for e, n in zip(each, names)))
        told = told.select("leaf", "_block", *(F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(n) for n in names))
        rows = rows.withColumns({f"_own{n}": F.coalesce(e.over(own), F.lit(0.0)) for e, n in zip(each, names)}).join(told, ["leaf", "_block"])
        base = {n.id: n.counts for n in self.leaves()}
        counts = []
        for k, n in enumerate(names):
            start = F.create_map(*(F.lit(v) for i, w in base.items() for v in (i, float(w[k]))))
            counts.append(start[F.col("leaf")] + F.col(n) + F.col(f"_own{n}"))
        return rows.withColumn("pred", self._argmax(counts)).select(*df.columns, "leaf", "pred")

    def learn(self, df: DataFrame, y: str) -> HoeffdingTree:
        """Update the statistics with one batch, then try to split."""
        rows = df.where(F.col(y).isNotNull()).withColumn("leaf", self.leaf())
        index = {c: k for k, c in enumerate(self.classes)}
        at = {n.id: n for n in self.leaves()}
        for r in rows.groupBy("leaf", y).agg(F.count("*").alias("n")).collect():
            if r[y] in index:
                at[r.leaf].counts[index[r[y]]] += r.n
                at[r.leaf].seen += r.n
        if self.numeric:
            tall = long_form(rows, self.numeric, ["leaf", y])
            for r in tall.groupBy("leaf", "attribute", y).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
                if r[y] in index:
                    s = at[r.leaf].numeric.setdefault(r.attribute, np.tile([0.0, 0.0, 0.0, np.inf, -np.inf], (len(self.classes), 1)))[index[r[y]]]
                    s[:3] += (r.n, r.s, r.q)
                    s[3], s[4] = min(s[3], r.low), max(s[4], r.high)
        for a in self.nominal:
            bound = len(at) * self.max_values * len(self.classes)
            cells = rows.where(F.col(a).isNotNull() & F.col(y).cast("string").isin(self.classes)).groupBy("leaf", F.col(a).cast("string").alias("value"), y).agg(F.count("*").alias("n")).limit(bound + 1).collect()
            if len(cells) > bound:
                raise ValueError(f"{a} has more than {self.max_values} values in a leaf")
            for r in cells:
                if r[y] in index:
                    at[r.leaf].nominal.setdefault(a, {}).setdefault(r.value, np.zeros(len(self.classes)))[index[r[y]]] += r.n
        for n in at.values():
            self.check(n)
        return self

    def due(self, n: Node) -> bool:
        """Whether a leaf's grace period is over, and a split may be made there."""
        return n.seen - n.checked >= self.grace and self.made - self.splits < self.max_leaves and (n.counts > 0).sum() > 1

    def check(self, n: Node) -> None:
        """Try to split a leaf whose grace period is over."""
        if self.due(n):
            n.checked = n.seen
            self._split(n)

    def _suggestions(self, n: Node) -> list[tuple[float, str, float | None, list[str], list[np.ndarray]]]:
        out = []
        for a, s in n.numeric.items():
            low, high = s[:, 3].min(), s[:, 4].max()
            best = None
            for k in range(1, self.candidates + 1):
                cut = low + (high - low) * k / (self.candidates + 1)
                below = np.zeros(len(s))
                for c, (w, t, q, lo, hi) in enumerate(s):
                    if w <= 0 or cut < lo:
                        continue
                    mean, sd = t / w, math.sqrt(max(q - t * t / w, 0) / (w - 1)) if w > 1 else 0.0
                    below[c] = w if cut >= hi else w * _phi((cut - mean) / sd) if sd > 0 else w * (cut >= mean)
                post = [below, s[:, 0] - below]
                merit = self.criterion(s[:, 0], post)
                if best is None or merit > best[0]:
                    best = (merit, a, float(cut), [], post)
            if best:
                out.append(best)
        for a, by in n.nominal.items():
            values = sorted(by)
            pre = sum(by.values())
            if not self.binary:
                out.append((self.criterion(pre, [by[v] for v in values]), a, None, values, [by[v] for v in values]))
            one = max(((self.criterion(pre, [by[v], pre - by[v]]), a, None, [v], [by[v], pre - by[v]]) for v in values), key=lambda x: x[0])
            if self.binary or one[0] > out[-1][0]:
                out.append(one)
        return sorted((x for x in out if math.isfinite(x[0])), key=lambda x: -x[0])

    def _split(self, n: Node) -> None:
        found = self._suggestions(n)
        if not found or found[0][0] <= 0:
            return
        span = math.log2(max(2, len(self.classes))) if self.criterion is info_gain else 1.0
        epsilon = math.sqrt(span * span * math.log(1 / self.delta) / (2 * n.seen))
        second = max(found[1][0] if len(found) > 1 else 0.0, 0.0)
        if not (found[0][0] - second > epsilon or epsilon < self.tie):
            return
        _, n.attribute, n.cut, n.values, post = found[0]
        for w in post:
            n.children.append(Node(self.made, np.array(w, float), n.depth + 1, float(w.sum()), float(w.sum())))
            self.made += 1
        self.splits += 1
        n.numeric, n.nominal = {}, {}


def prequential(df: DataFrame, tree: HoeffdingTree, order: str, y: str, batches: int) -> DataFrame:
    """Test-then-train over `batches` runs of the order: order, y, pred for every row.

    Every batch reads the rows again, so a table that is costly to make should be written first (see `tasks`).
    """
    df = in_blocks(df, order)
    low, high = df.agg(F.min(order), F.max(order)).first()
    parts = []
    if low is None:
        return tree.predict(df).select(order, y, "pred")
    width = -(-(high - low + 1) // batches)
    for k in range(batches):
        part = df.where((F.col(order) >= low + k * width) & (F.col(order) < low + (k + 1) * width))
        parts.append(tree.predict_then_learn(part, order, y).select(order, y, "pred"))
        tree.learn(part, y)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
