"""Query registry: each module gives QUERIES (name to function of session and folder) and SQL (name to oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
