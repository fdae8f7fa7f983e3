"""Broadcasts of tables whose size is checked, and tasks by the work there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def sent(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df, to be sent to all tasks if it has that many rows at most; a larger one is left to the optimiser."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, *keys: str, work: int, most: int) -> DataFrame:
    """df dealt by keys over so many tasks that each has some most units of all the work; those aren't put together again. Groupings by keys, or by more than them, need no further exchange."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-work // most)), *keys)
