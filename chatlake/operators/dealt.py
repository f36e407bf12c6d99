"""Dealing rows out by key to as many tasks as the session asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in exactly ``spark.sql.shuffle.partitions`` partitions.

    Left alone, adaptive execution joins partitions up to 64 MB of shuffled bytes. Rows of repetitive texts and
    small numbers shuffle as a few bytes each, so a task would sort ten million of them.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
