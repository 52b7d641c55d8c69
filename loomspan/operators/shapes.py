"""Plans that an optimizer rule elsewhere would make and Catalyst does not: written as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def eager_aggregate(fact: DataFrame, dimension: DataFrame, key: str, dimension_key: str, group: str, value: str) -> DataFrame:
    """Sum ``value`` by a dimension's ``group``, aggregated by the join key before the join: the join then has one row
    per key where it had one per fact."""
    early = fact.groupBy(key).agg(F.sum(value).alias("_part"), F.count(F.lit(1)).alias("_n"))
    joined = early.join(dimension.select(F.col(dimension_key).alias("_k"), group), F.col(key) == F.col("_k"))
    return joined.groupBy(group).agg(F.sum("_part").alias(f"sum_{value}"), F.sum("_n").alias("n"))


def share_of_total(df: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """HAVING sum(value) > least * total, with the total from the groups rather than a second scan."""
    groups = df.groupBy(key).agg(F.sum(value).alias("s"))
    total = groups.agg(F.sum("s").alias("t"))  # one row
    return groups.join(F.broadcast(total), F.col("s") > F.col("t") * least).select(key, "s")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, share: int = 1000) -> DataFrame:
    """An inner equi-join for keys that hold a large share of ``left``. Keys with more than one in ``share`` of its rows,
    of which there are ``share`` at most, are broadcast as a list; their left rows are dealt over ``salts`` parts row by
    row, also equal ones, and their right rows repeated for these. Other keys stay as they are."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    hot = F.broadcast(counts.join(F.broadcast(total), F.col("n") * share > F.col("t")).select(F.col(key).alias("_hot")))
    marked = lambda df: df.join(hot, F.col(key) == F.col("_hot"), "left")
    spread = marked(left).withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(salts))).cast("int")).drop("_hot")
    all_salts = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    return spread.join(marked(right).withColumn("_salt", F.explode(all_salts)).drop("_hot"), [key, "_salt"]).drop("_salt")


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The latest ``value`` of ``right`` at or before each row of ``left``: one union and one window, no range join."""
    both = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(F.col(by), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    w = W.partitionBy(by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_t", "_side", "_v")
