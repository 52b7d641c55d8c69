"""Exact deduplication over a log-structured merge index, in DataFrame operations only.

Texts are equal when they are identical after each run of ASCII white space has become one space. The index maps the
SHA-256 of a normalised text to the smallest document id and the number of rows:

* a *memtable* is a share of the rows, aggregated by digest (map-side first, so a text with a third of all rows
  reaches the shuffle as one row per task);
* a memtable is *flushed* as a run: Parquet sorted by digest, with Parquet's Bloom filter on the digest for point
  lookups;
* *compaction* merges ``fanout`` runs at a time into the next level, keeping the smallest id and adding up counts,
  until one run is left;
* *hits*, rows whose digest has more than one row, take the smallest id and the count from the index, once verified by
  their bytes: their texts are read again (found by a fixed-size bit filter on the id, so no other text moves) and grouped
  by digest **and** text; a digest must have one text, in as many rows as the index says;
* ``lookup`` asks the index for single texts: the sorted run's statistics and Bloom filter leave out what cannot hold them.

Defined cases
  null text: as the empty text; null id: counts in its group, never stays unless the whole group has none; repeated
  ids in a group: each of these rows is marked as kept (``deduplicate`` returns one); an id with several texts: told apart by
  the text; very long texts: whole, a row each;
  empty table: empty result; extra columns: pass through ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import BitFilter, Scratch, free_name, join_unique

#: Rows of a memtable, and the most memtables that are flushed before they grow instead.
MEMTABLE_ROWS, MAX_RUNS, FANOUT = 1 << 17, 16, 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class MergeIndex:
    """Digest -> (smallest id, rows), built from ``docs`` in runs and compacted to one."""

    def __init__(self, docs: DataFrame, scratch: Scratch, *, id_column: str = "doc_id", text: str = "text", memtable_rows: int = MEMTABLE_ROWS, max_runs: int = MAX_RUNS, fanout: int = FANOUT):
        self.scratch = scratch
        norm = docs.select(F.col(id_column).alias("id"), normalised(F.col(text)).alias("norm"))
        self.keys = scratch.save(norm.select("id", F.unhex(F.sha2("norm", 256)).alias("digest")), "keys")
        self.runs = max(1, min(max_runs, -(-self.keys.count() // memtable_rows)))
        self.entries = self._flush()
        level = 0
        while self.runs > 1:
            self.runs, level = -(-self.runs // fanout), level + 1
            self.entries = self._compact(fanout, level)
            scratch.drop(f"level-{level - 1}")

    def _write(self, entries: DataFrame, level: int) -> DataFrame:
        return self.scratch.save(entries.sortWithinPartitions("run", "digest"), f"level-{level}", ["run"], **{"parquet.bloom.filter.enabled#digest": "true"})

    def _flush(self) -> DataFrame:
        memtable = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(self.runs)).cast("int")
        table = self.keys.groupBy(memtable.alias("run"), "digest").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n"))
        return self._write(table.select("digest", "min_id", "n", "run"), 0)

    def _compact(self, fanout: int, level: int) -> DataFrame:
        merged = self.entries.groupBy((F.col("run") / fanout).cast("int").alias("to"), "digest").agg(F.min("min_id").alias("min_id"), F.sum("n").alias("n"))
        return self._write(merged.select("digest", "min_id", "n", F.col("to").alias("run")), level)

    def lookup(self, texts: list[str | None]) -> dict[str | None, tuple]:
        """(smallest id, rows) of those of a few texts that the index knows."""
        digests = {t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest() for t in texts}
        found = self.entries.filter(F.col("digest").isin([bytearray(d) for d in set(digests.values())])).select("digest", "min_id", "n").collect()  # as many as texts
        rows = {bytes(r["digest"]): (r["min_id"], r["n"]) for r in found}
        return {t: rows[d] for t, d in digests.items() if d in rows}

    def hits(self) -> DataFrame:
        """The rows whose digest others share too."""
        return join_unique(self.keys, self.entries.filter("n > 1").select("digest", "n"), ["digest"], "n")


def exact_groups(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each row of ``docs``: id, digest (binary SHA-256), keep_id, group_size, kept."""
    scratch = Scratch(docs.sparkSession, "exact")
    index = MergeIndex(docs, scratch, id_column=id_column, text=text, **options)
    body = docs.select(F.col(id_column).alias("id"), F.col(text).alias("body"))
    again = BitFilter(index.hits(), "id").keep(body, "id").select("id", normalised(F.col("body")).alias("norm"))
    # Grouping by the text itself compares bytes; map-side aggregation leaves one copy of a text per task.
    verified = again.groupBy(F.unhex(F.sha2("norm", 256)).alias("digest"), "norm").agg(F.count(F.lit(1)).alias("of_text"))
    verified = verified.groupBy("digest").agg(F.max("of_text").alias("of_text"), F.count(F.lit(1)).alias("texts"))
    entries = index.entries.filter("n > 1").select("digest", "min_id", "n")
    agreed = (F.col("texts") == 1) & (F.col("of_text") == F.col("n"))
    # Two texts with equal SHA-256 would show here; that is reported, not passed over.
    known = entries.join(verified, "digest", "left").select("digest", F.col("min_id").alias("keep_id"), F.when(agreed, F.col("n")).otherwise(F.raise_error(F.lit("the index and the texts disagree")).cast("long")).alias("group_size"))
    known = scratch.save(known, "verified")
    out = join_unique(index.keys, known, ["digest"], "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the smallest id."""
    scratch = Scratch(docs.sparkSession, "deduplicate")
    groups = exact_groups(docs, id_column=id_column, text=text, **options)
    gone = scratch.save(groups.filter("NOT kept").select("id", "digest").distinct(), "gone")
    # Rows of one id with one text, of which one stays: few, so only those that may be such, or may go, are joined.
    twice = groups.filter("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    maybe = scratch.save(gone.select("id").unionByName(twice).distinct(), "maybe")
    flag, digest, g_id, g_digest = (free_name(docs, c) for c in ("_maybe", "_digest", "_gone_id", "_gone_digest"))
    marked = BitFilter(maybe, "id").mark(docs, id_column, flag)
    some = marked.filter(flag).withColumn(digest, F.unhex(F.sha2(normalised(F.col(text)), 256)))
    gone = gone.select(F.col("id").alias(g_id), F.col("digest").alias(g_digest))
    left = some.join(gone, F.col(id_column).eqNullSafe(F.col(g_id)) & (F.col(digest) == F.col(g_digest)), "left_anti")
    return marked.filter(~F.col(flag)).select(*docs.columns).unionByName(left.dropDuplicates([id_column, digest]).select(*docs.columns))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
