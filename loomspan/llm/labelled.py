"""Labelled rows, all of them or a bounded sample, shared by the classifiers.

Defined cases
  null ids and labels other than 0 and 1: not learned from; an id labelled twice: the larger label holds; documents that
  share an id: each is learned from; null texts: as empty ones; very long texts: learned from whole, within the bound on
  the sample's bytes; ties in the hash of an id: by the id; empty tables: an empty sample; clashing column names: avoided.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BitFilter, held_out


def class_totals(labels: DataFrame, label: str, id_column: str = "doc_id") -> tuple[int, int]:
    """How many rows outside the held-out fold have label 0 and label 1, over all of ``labels``."""
    row = labels.filter(~held_out(F.col(id_column))).agg(F.count_if(F.col(label) == 0).alias("zero"), F.count_if(F.col(label) == 1).alias("one")).first()
    return row["zero"], row["one"]


def _known(labels: DataFrame, label: str, id_column: str) -> DataFrame:
    """(_id, y, order): each labelled id outside the held-out fold once."""
    y = F.col(label).cast("int")
    return labels.filter(F.col(id_column).isNotNull() & ~held_out(F.col(id_column))).groupBy(F.col(id_column).alias("_id")).agg(F.max(y).alias("y")).withColumn("order", F.xxhash64("_id", F.lit(11)))


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))


def _may_be_labelled(docs: DataFrame, labels: DataFrame, label: str, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The ids labelled 0 or 1, never of the held-out fold, and the texts that may have one of them."""
    known = _known(labels, label, id_column).filter(F.col("y").isin(0, 1))
    read = _texts(docs, id_column, text)
    if known.schema["_id"].dataType == read.schema["_doc"].dataType:  # else equal ids may have unequal hashes
        read = BitFilter(known, "_id").keep(read, "_doc")
    return known, read


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, body, y): all documents labelled 0 or 1, never of the held-out fold. Only texts that may be labelled move."""
    known, read = _may_be_labelled(docs, labels, label, id_column, text)
    return read.join(known, F.col("_doc") == F.col("_id")).select("order", "body", "y")


def labels_and_texts(docs: DataFrame, labels: DataFrame, label: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, key, body, y): the rows of ``labelled_rows`` before their join, for a reader who deals them out by ``order``,
    sorts by it, ``key`` and null ``y`` last, and joins them there, so that texts move once: a label has a null body, and a
    text, which holds for the label before it if that has its key, a null y. Ids of other types than these come joined."""
    known, read = _may_be_labelled(docs, labels, label, id_column, text)
    kind = known.schema["_id"].dataType
    if kind != read.schema["_doc"].dataType or kind not in (T.LongType(), T.IntegerType(), T.StringType()):
        return labelled_rows(docs, labels, label, id_column=id_column, text=text).select("order", F.lit("").alias("key"), "body", "y")
    texts = read.filter(F.col("_doc").isNotNull()).select(F.xxhash64("_doc", F.lit(11)).alias("order"), F.col("_doc").cast("string").alias("key"), "body", F.lit(None).cast("int").alias("y"))
    return known.select("order", F.col("_id").cast("string").alias("key"), F.lit(None).cast("string").alias("body"), "y").unionByName(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(order, body, y): documents of at most ``per_class`` rows of ``labels`` for each label, never of the held-out fold.

    The rows are those with the smallest hash of their id, so the choice is the same on every run and its size is
    ``2 * per_class`` whatever the table's; that bound is what makes broadcasting the ids safe.
    """
    known = _known(labels, label, id_column)
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("y") == value).orderBy("order", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return _texts(docs, id_column, text).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("order", "body", "y")


def within(features: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Of each label (``y``) the rows in ``order``, as long as the bytes of ``columns`` add up to ``limit`` at most."""
    size = sum((F.octet_length(c) for c in columns), F.lit(0).cast("long"))
    so_far = F.sum(size).over(W.partitionBy("y").orderBy("order", *columns).rowsBetween(W.unboundedPreceding, 0))
    return features.withColumn("so_far", so_far).filter(F.col("so_far") <= limit).drop("so_far")


def arrays_of(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """A binary column's values as arrays, without copies."""
    return [np.frombuffer(v.as_buffer() or b"", kind) for v in column]


def prior_shift(totals: tuple[int, int], sampled: tuple[int, int]) -> float:
    """What to add to a logit learned on the sample so that it holds for all labelled rows."""
    import math

    if min(*totals, *sampled) == 0:
        return 0.0
    return math.log(totals[1] / totals[0]) - math.log(sampled[1] / sampled[0])
