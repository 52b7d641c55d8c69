"""Connected components by alternating large-star and small-star steps, on DataFrames of links.

A node with very many links is never gathered: each step takes the minimum of a node's neighbours by a map-side
aggregation and joins it back, a row per link. Every round is written to the shared folder, which cuts the lineage, and
its links are counted and hashed while they are written: a round is one query.

Defined cases
  links of a node with itself and links with a null end: no rows; repeated and turned links: as one; no links: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .base import Scratch


def _saved(links: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The saved links, and how many they are with the sum of their hashes."""
    seen = Observation()
    state = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")
    saved = scratch.save(links.observe(seen, *state), name)
    return saved, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b: long)."""
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, state = _saved(ordered, scratch, f"{name}-0")
    for n in range(1, max_rounds + 1):
        if state[0] == 0:
            break
        # Large star: a node's larger neighbours join the smallest of its neighbours and itself.
        least = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        large = now.join(least, F.col("lo") == F.col("node"), "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours join the smallest of them.
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        small = large.join(least, F.col("hi") == F.col("node")).select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x")).select("x.hi", "x.lo").filter("hi <> lo").distinct()
        now, after = _saved(small, scratch, f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("id")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
