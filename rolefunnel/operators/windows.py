"""First-wins, latest and capped selections per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Column | Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of every key in a total ``order``.

    Spark prunes a small rank limit per map task (window group limit) before the
    shuffle, so a key with a third of all rows ships ``limit`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, Column) else order))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def first_wins(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The earliest row of every key."""
    return cap_per_group(df, keys, order, 1)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of every key; ``order`` must be a total order, newest first."""
    return cap_per_group(df, keys, order, 1)
