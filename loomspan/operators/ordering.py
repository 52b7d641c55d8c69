"""NULLS LAST ordering, top-k and per-group top-k for the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key(column: str | Column, descending: bool = False) -> Column:
    """A sort key with nulls last, whichever the direction."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def order_by(df: DataFrame, *columns: str) -> DataFrame:
    """``-name`` sorts descending."""
    return df.orderBy(*(key(c.lstrip("-"), c.startswith("-")) for c in columns))


def top_k(df: DataFrame, k: int, *columns: str, offset: int = 0) -> DataFrame:
    """The first ``k`` rows after ``offset``: a heap per task and one merge, no full sort."""
    ordered = order_by(df, *columns)
    return (ordered.offset(offset) if offset else ordered).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: list[str], *columns: str) -> DataFrame:
    """Spark prunes each map task's groups to ``k`` rows before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*group).orderBy(*(key(c.lstrip("-"), c.startswith("-")) for c in columns))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
