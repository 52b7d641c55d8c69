"""Toxicity by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one word between, and of the words
cut to ``STEM`` bytes, which brings inflected forms of a word together. Training keeps
FTRL's per-coordinate learning rates; its L1 term leaves few weights that are not zero, and only those are broadcast.
The learner reads every labelled row outside the held-out fold, on the executors: the hash of its id deals each row to a
shard of about ``shard_rows`` rows and tells its place there, one learner goes over each shard, and the model is the mean
of theirs. Labels are dealt out likewise and meet their texts in the shard, so that texts move once. Shards are fewer and
longer where one label is rare, so that each has some ``LEAST`` rows of it. The driver gets the summed weights that are not zero, ``2**BITS`` at most whatever the tables' size.

Defined cases
  null text: scored as the empty text, which gets the prior; no labels of one kind: every score is the smoothed prior;
  repeated rows: each scored alike; very long texts: read whole, in memory that follows the text; ties: equal feature sets
  have equal scores, and rows of equal ids are learned from in the order of label and text; empty table: empty result; extra columns
  pass through ``score_toxicity``, whose ``out`` replaces a column of that name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Memo, held_out, pieces, utf8
from .decontamination import words_of
from .labelled import class_totals, labelled_rows, labelled_sample, labels_and_texts, prior_shift, within

BITS, EPOCHS = 20, 3
#: Rows of a shard, and rows of the rarer label that a shard has on average at least, if there are as many.
SHARD_ROWS, LEAST = 8192, 400
#: Weights are added up as whole numbers of this unit: the sum is then the same in any order.
UNIT = 2.0**-32
STEM = 4


def word_hashes() -> Memo:
    """word -> 32-bit hash of the word, then 32 of its stem."""
    return Memo(lambda word: zlib.crc32(word) << 32 | zlib.crc32(word[:STEM], 1))


def feature_indices(words: list[bytes], cache: Memo, bits: int = BITS) -> np.ndarray:
    """Hashes of words, stems, pairs and skip-pairs; not yet distinct."""
    both = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    h, stems = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    pairs = h[:-1] * a + (h[1:] ^ b) * c
    skips = h[:-2] * b + (h[2:] ^ c) * a
    out = np.concatenate((h * a, pairs * b, skips * c, stems * (a ^ b)))
    return ((out ^ (out >> np.uint32(15))) * a) >> np.uint32(32 - bits)


@dataclass
class FtrlModel:
    indices: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self, bits: int = BITS) -> np.ndarray:
        w = np.zeros(1 << bits, np.float32)
        w[self.indices] = self.weights
        return w


def distinct_features(text: bytes, cache: Memo) -> np.ndarray:
    return np.unique(feature_indices(words_of(text), cache)).astype(np.int32)


class Rows:
    """Feature indices and labels to go over several times; beyond ``limit`` bytes in a file of the worker's own."""

    def __init__(self, limit: int = 64 << 20):
        self.file, self.sizes = SpooledTemporaryFile(limit), []

    def add(self, idx: np.ndarray, y: int) -> None:
        self.file.write(idx.tobytes())
        self.sizes.append((len(idx), y))

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        self.file.seek(0)
        for n, y in self.sizes:
            yield np.frombuffer(self.file.read(4 * n), np.int32), y


def train_ftrl(rows: Iterable[tuple[np.ndarray, int]], *, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, shift: float = 0.0) -> FtrlModel:
    """``rows``: distinct feature indices and the label, in the order of training."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for idx, y in rows:
            zi, root = z[idx], np.sqrt(ni := n[idx])
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, bias + w.sum()))))
            g = p - y
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[idx] = ni + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    live = np.flatnonzero(w)
    return FtrlModel(live.astype(np.int32), w[live].astype(np.float32), -bias_z / ((beta + math.sqrt(bias_n)) / alpha) + shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_column: str = "doc_id", text: str = "text", per_class: int | None = None, sample_bytes: int | None = None, shard_rows: int = SHARD_ROWS, **options) -> FtrlModel:
    """Learn from all documents with labels outside the held-out fold; on request, of each label from ``per_class`` rows
    and ``sample_bytes`` of features at most."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in pieces(batches, "body"):
            idx = [distinct_features(t, cache).tobytes() for t in utf8(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("order", "body", "y")), pa.array(idx, pa.binary())], ["order", "body", "y", "idx"])

    def learned(rows: Rows) -> pa.RecordBatch:
        model = train_ftrl(rows, **options)
        weights = np.rint(np.append(model.weights.astype(np.float64), model.bias) / UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.append(model.indices, -1).astype(np.int32)), pa.array(weights)], ["index", "weight"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at, rows, known = word_hashes(), None, Rows(), (None, None)
        for batch in pieces(batches, "body"):
            for shard, key, y, t in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "y")), utf8(batch.column("body"))):
                if shard != at and rows.sizes:
                    yield learned(rows)
                    rows = Rows()
                at = shard
                if y is not None:
                    known = (key, y)
                if t is not None and known[0] == key:
                    rows.add(distinct_features(t, cache), known[1])
        if rows.sizes:
            yield learned(rows)

    if per_class is None:
        found = labelled_rows(docs, labels, label, id_column=id_column, text=text)
    else:
        found = labelled_sample(docs, labels, label, per_class, id_column=id_column, text=text)
    if sample_bytes is not None:
        found = within(found.mapInArrow(sized, "order long, body string, y int, idx binary"), ["idx"], sample_bytes).drop("idx")
    counts = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    totals, read = class_totals(labels, label, id_column), (counts.get(0, 0), counts.get(1, 0))
    if min(read) == 0:
        return FtrlModel(np.zeros(0, np.int32), np.zeros(0, np.float32), math.log((totals[1] + 1) / (totals[0] + 1)))
    shards = max(1, min(math.ceil(sum(read) / shard_rows), min(read) // LEAST))
    shard = F.pmod(F.xxhash64("order", F.lit(5)), F.lit(shards)).cast("int")
    if per_class is None and sample_bytes is None:
        found = labels_and_texts(docs, labels, label, id_column=id_column, text=text)
    else:
        found = found.withColumn("key", F.lit(""))
    dealt = found.withColumn("shard", shard).repartitionById(shards, "shard").sortWithinPartitions("shard", "order", "key", F.col("y").asc_nulls_last(), "body")
    summed = dealt.mapInArrow(learn, "index int, weight long").groupBy("index").agg(F.sum("weight").alias("weight"), F.count("*").alias("shards")).toArrow().sort_by("index")
    index, weight = summed.column("index").to_numpy(), summed.column("weight").to_numpy() * (UNIT / summed.column("shards")[0].as_py())  # the bias, which each shard with rows has, is first
    return FtrlModel(index[1:], weight[1:].astype(np.float32), float(weight[0]) + prior_shift(totals, read))


def score_toxicity(docs: DataFrame, model: FtrlModel, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1, over the whole text. One map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, cache = shared.value.dense(), shared.value.bias, word_hashes()
        for batch in pieces(batches, text):
            logits = []
            for t in utf8(batch.column(text)):
                idx = feature_indices(words_of(t or b""), cache)
                live = np.unique(idx[weights[idx] != 0])
                logits.append(bias + float(weights[live].sum(dtype=np.float64)))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(logits, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
