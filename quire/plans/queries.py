"""Registry of the core queries (each takes a session and a data folder) and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators.packed_values import split_packed
from quire.session import load, one_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is DuckDB text giving the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = one_row(load(spark, d, "training_rows").select("row_id", "tags").where("tags is not null"), "row_id")
    return split_packed(rows, "tags", ["row_id"], "pos", "tag")


def _register() -> None:
    """Load the modules whose queries join the registry."""
    from quire.plans import catalogue, works  # noqa: F401


_register()
