"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of points. A row stands at the point its text hashes to, so equal texts stand together;
each shard owns several points (virtual nodes). A row goes clockwise to the next virtual node whose shard still has
room. Every shard's room is exact, ``n // shards`` or one more, so counts differ by one at most (law ``rows``), and a
row moves on only where its shard is full.

Rows are not walked one by one. A count per point (a table of fixed size, the only thing the driver sees) decides how
many rows of each point stay at their first shard and how many continue to which next ones; a row's rank within its
point then tells its shard and its slot. Ranks come from cells: a point with many rows (one text may hold a third of
all rows) is salted by id into cells of about ``max(CELL_ROWS, sqrt(n))`` rows, ranked side by side and offset by the
sizes of the cells before them.

Defined cases
  null text: hashes, counts and sizes as the empty text; null or repeated ids: rows like others, each with a slot of
  its own; empty table: empty result; fewer rows than shards: some shards stay empty; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import Scratch

#: Points of the ring (the size of the broadcast table), virtual nodes of a shard, rows of a cell at least.
POINTS, VIRTUAL_NODES, CELL_ROWS = 4096, 64, 512


def ring_order(shards: int, points: int = POINTS, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each point, all shards in the order in which a clockwise walk first meets them."""
    nodes = sorted((int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big") % points, hashlib.sha256(f"{v} {s}".encode()).digest(), s) for s in range(shards) for v in range(virtual_nodes))
    order: list[list[int]] = [[] for _ in range(points)]
    for p in range(points):
        after = [s for at, _, s in nodes if at >= p]
        order[p] = list(dict.fromkeys([*after, *(s for _, _, s in nodes)]))
    return order


def placements(counts: dict[int, int], order: list[list[int]], shards: int) -> dict[int, list[dict]]:
    """For each point with rows: from which rank on which shard takes them, and at which slot it begins.

    Round by round: every point offers its rows to its first shard, what did not fit to its second, and so on.
    """
    n = sum(counts.values())
    wanted = [0] * shards
    for p, c in counts.items():
        wanted[order[p][0]] += c
    larger = set(sorted(range(shards), key=lambda s: (-wanted[s], s))[: n % shards])
    room = [n // shards + (s in larger) for s in range(shards)]
    used, left, rank = [0] * shards, dict(counts), dict.fromkeys(counts, 0)
    out: dict[int, list[dict]] = {p: [] for p in counts}
    for turn in range(shards):
        for p in sorted(counts):
            s = order[p][turn]
            if take := min(left[p], room[s] - used[s]):
                out[p].append({"start": rank[p], "shard": s, "slot": used[s]})
                used[s] += take
                left[p] -= take
                rank[p] += take
    return out


def shard(docs: DataFrame, shards: int = 8, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, size (UTF-8 bytes plus one), text_crc32, shard, slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = scratch.save(
        docs.select(F.col(id_column).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(body), F.lit(POINTS)).cast("int").alias("point")),
        "rows",
    )
    counts = {r["point"]: r["n"] for r in rows.groupBy("point").agg(F.count(F.lit(1)).alias("n")).collect()}  # POINTS rows at most
    placed = placements(counts, ring_order(shards), shards)
    cell_rows = max(CELL_ROWS, math.isqrt(sum(counts.values())))
    table = json.dumps([{"at": p, "cells": -(-counts[p] // cell_rows), "takes": placed[p]} for p in sorted(placed)])
    ring = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<at: int, cells: long, takes: array<struct<start: long, shard: int, slot: long>>>>")))
    cells = rows.join(F.broadcast(ring.select("at", "cells")), F.col("point") == F.col("at")).drop("at").withColumn("cell", F.pmod(F.xxhash64("id", F.lit(7)), F.col("cells"))).drop("cells")
    before = W.partitionBy("point").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.groupBy("point", "cell").agg(F.count(F.lit(1)).alias("n")).select("point", "cell", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset"))
    within = W.partitionBy("point", "cell").orderBy("id", "text_crc32", "size")
    ranked = cells.withColumn("nth", F.row_number().over(within)).join(offsets, ["point", "cell"]).withColumn("rank", F.col("offset") + F.col("nth") - 1)
    take = F.element_at(F.filter("takes", lambda t: t["start"] <= F.col("rank")), -1)
    out = ranked.join(F.broadcast(ring.select("at", "takes")), F.col("point") == F.col("at")).withColumn("take", take)
    return out.select("id", "size", "text_crc32", F.col("take.shard").alias("shard"), (F.col("take.slot") + F.col("rank") - F.col("take.start")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, 8).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
