"""Registered queries: name, function of (spark, sf_dir), and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Modules whose import registers queries.
MODULES = ("strandline.plans.burden", "strandline.plans.response", "strandline.plans.linking", "strandline.plans.decisions", "strandline.plans.merging", "strandline.plans.carry", "strandline.plans.graph", "strandline.operators.summaries", "strandline.operators.longitudinal", "strandline.operators.readers", "strandline.operators.review", "strandline.operators.identity", "strandline.operators.evidence", "strandline.operators.chains", "strandline.operators.agreement", "strandline.operators.containment", "strandline.operators.policy", "strandline.operators.ingest", "strandline.operators.search", "strandline.operators.vectors", "strandline.streaming.appends", "strandline.streaming.limits", "strandline.functions.text", "strandline.functions.spans", "strandline.functions.errors", "strandline.functions.measures")


def query(name: str, sql: str | None = None):
    """Register the decorated function as ``name``."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return keep


def oracles_so_far() -> dict[str, str]:
    """SQL of the modules imported before, for queries that build on others."""
    return dict(_ORACLES)


def _load() -> None:
    for m in MODULES:
        import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["burden_timeline"](spark, sf_dir)
