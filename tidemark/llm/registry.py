"""The queries of this subpackage and, where SQL can express them, the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(q, name) for name in dir(q) if name.startswith("op") and name[2:3].isdigit()
}
ORACLES: dict[str, str] = dict(q.ORACLES)
