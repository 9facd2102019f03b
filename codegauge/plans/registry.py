"""Registry of named queries: a Spark builder and, where SQL can express it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL (if any)."""
    def deco(fn):
        import functools

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from codegauge.session import tune
            tune(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all():
    """Import every query module so that the registry is filled."""
    from codegauge.plans import q_metrics, q_findings, q_scoring, q_graph, q_snapshots, q_changes, q_project, q_misc, q_files  # noqa: F401
    return QUERIES, ORACLE
