"""All registered queries of the library: a Spark form and, where one exists, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}
FLAGSHIP = "site_findings"


def load() -> dict[str, Query]:
    """Import the modules that register queries."""
    from . import actions, analytics, lifecycle, listings, market, planning, sitefiles, streams, technical  # noqa: F401

    return QUERIES
