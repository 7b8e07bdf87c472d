"""All queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from . import clusters, drift, flows, forests, horizons, learners, rulesets, spheres, streams, trees

PARTS = (streams, drift, learners, clusters, trees, flows, forests, horizons, rulesets, spheres)


def queries() -> dict:
    return {k: q for part in PARTS for k, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for part in PARTS for k, q in part.SQL.items()}
