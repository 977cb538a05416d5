"""The library's front door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.plans.planner import plan
from granary.sources.tables import open_table
from granary.sources.tsv import convert as load_tsv

__all__ = ["load_tsv", "open_table", "query"]


def query(spark: SparkSession, source: str | DataFrame, sql: str) -> DataFrame:
    """The result of one SELECT over a frame, a Parquet path or a view's name; nothing runs until it is used.

    A name without slash, colon or ".parquet" is a view or a table of the catalog.
    """
    if isinstance(source, str):
        is_path = "/" in source or ":" in source or source.endswith(".parquet")
        source = open_table(spark, source) if is_path else spark.table(source)
    return plan(sql, source)
