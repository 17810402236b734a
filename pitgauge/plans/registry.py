"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its SQL twin, when it has one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def rounded(df: DataFrame, keep: Sequence[str | Column], doubles: Sequence[str], digits: int = 4) -> DataFrame:
    """Result columns with the floating ones rounded, as in the SQL twin."""
    return df.select(*keep, *[F.round(F.col(c), digits).alias(c) for c in doubles])


def R(expr: str, digits: int = 4, alias: str | None = None) -> str:
    """SQL for a rounded column (adding zero turns -0.0 into 0.0)."""
    return f"(round({expr}, {digits}) + 0e0) AS {alias or expr}"


def Rs(names: Sequence[str], digits: int = 4) -> str:
    return ", ".join(R(n, digits) for n in names)
