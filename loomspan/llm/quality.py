"""Quality by supervised subword embeddings.

A word is its own hashed vector and those of its character n-grams, averaged; a document is the average of its words;
a softmax layer tells good from bad. All vectors are learned together by stochastic gradient descent in numpy on at
most ``per_class`` labelled rows of each label and ``sample_bytes`` of their features (see ``labelled_sample`` and
``within``), which bounds what reaches the driver. Words keep case and punctuation, which is
where much of the difference lies. A word pair of two equal words counts as one more word, ``REPEAT``, with a vector of
its own: repetition is what no single word shows.

Since the output is linear in the average, the trained model is folded for scoring: each bucket's vector times the
softmax layer is one number, and a word's contribution is computed once and remembered. The scores are the same.

Defined cases
  null text: scored as the empty text, which gets the prior; no labels of one kind: every score is the smoothed prior;
  repeated rows: each scored alike; very long texts and words: read whole, in memory that follows the text; ties: equal
  texts have equal scores, and rows are learned from in an order set by their id's hash and the seed; empty table: empty
  result; extra columns pass through ``score_quality``, whose ``out`` replaces a column of that name.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import Memo, held_out, pieces, utf8
from .labelled import arrays_of, class_totals, labelled_sample, prior_shift, within

BITS, DIM, MIN_GRAM, MAX_GRAM, PER_CLASS, EPOCHS, RATE = 16, 8, 2, 4, 2000, 6, 2.0
#: Bytes of features of each label that the learner reads at most.
SAMPLE_BYTES = 24 << 20
#: Bytes. Longer words are not remembered, and their n-grams are hashed in blocks of ``BLOCK`` bytes.
MEMO_WORD, BLOCK = 126, 1 << 16
#: No text has this word: words have no white space.
REPEAT = b" = "


def repeats(words: list[bytes]) -> int:
    """How many words equal the word before."""
    return sum(map(operator.eq, words, words[1:]))


def buckets_of(word: bytes, bits: int = BITS) -> list[int]:
    """The word's bucket and those of its character n-grams (bytes, with word ends marked)."""
    mask = (1 << bits) - 1
    marked = b"<" + word + b">"
    grams = [zlib.crc32(marked[i : i + n], n) & mask for n in range(MIN_GRAM, MAX_GRAM + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(marked) & mask, *grams]


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def long_buckets(word: bytes, bits: int = BITS) -> Iterator[np.ndarray]:
    """The same buckets as ``buckets_of``, in blocks: memory does not follow the word."""
    mask = (1 << bits) - 1
    marked = b"<" + word + b">"
    yield np.array([zlib.crc32(marked) & mask])
    for at in range(0, len(marked), BLOCK):
        data = np.frombuffer(marked[at : at + BLOCK + MAX_GRAM - 1], np.uint8)
        for n in range(MIN_GRAM, MAX_GRAM + 1):
            begins = min(BLOCK, len(data) - n + 1)
            if begins > 0:
                crc = np.full(begins, ~n & 0xFFFFFFFF, np.uint32)  # CRC-32 of n bytes from each place, begun at n
                for k in range(n):
                    crc = _CRC[(crc ^ data[k : k + begins]) & 0xFF] ^ (crc >> 8)
                yield (~crc & mask).astype(np.int64)


def long_counts(word: bytes, bits: int = BITS) -> np.ndarray:
    """How often a long word has each bucket."""
    counts = np.zeros(1 << bits)
    for b in long_buckets(word, bits):
        counts += np.bincount(b, minlength=1 << bits)
    return counts


@dataclass
class QualityModel:
    """``fold``: for each bucket, how far its vector moves the logit of label 1."""

    fold: np.ndarray
    bias: float


def word_logits(folded: np.ndarray) -> Memo:
    """word -> its share of a document's logit."""
    fold = folded.tolist()

    class Logits(Memo):
        def __missing__(self, word: bytes) -> float:
            return super().__missing__(word) if len(word) <= MEMO_WORD else long_logit(word)

    def long_logit(word: bytes) -> float:
        total, n = 0.0, 0
        for b in long_buckets(word):
            total, n = total + float(folded[b].sum(dtype=np.float64)), n + len(b)
        return total / n

    def compute(word: bytes) -> float:
        b = buckets_of(word)
        return sum([fold[i] for i in b]) / len(b)

    return Logits(compute, 250_000)


def document_features(text: bytes, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which add up to one."""
    tokens = text.split()
    words = Counter(tokens)
    if again := repeats(tokens):
        words[REPEAT] = again
    total = sum(words.values())
    idx: list[int] = []
    share: list[float] = []
    long = np.zeros(1 << BITS)
    for w, c in words.items():
        if len(w) > MEMO_WORD:
            counts = long_counts(w)
            long += counts * (c / total / counts.sum())
            continue
        b = memo[w]
        idx += b
        share += [c / total / len(b)] * len(b)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    sums = np.bincount(np.array(idx, np.int64), np.array(share), 1 << BITS) + long
    live = np.flatnonzero(sums)
    return live.astype(np.int32), sums[live].astype(np.float32)


def train_embeddings(rows: list[tuple[np.ndarray, np.ndarray, int]], *, dim: int = DIM, bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7, shift: float = 0.0) -> QualityModel:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, share, y = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[idx] if len(idx) else np.zeros(dim, np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            back = np.clip(layer @ p, -1.0, 1.0)
            layer -= lr * np.outer(hidden, p)
            bias -= lr * p
            if len(idx):
                # An average of a document's words moves each of them little; its size is given back to the step.
                vectors[idx] -= np.float32(lr) * np.outer(share * len(idx) ** 0.5, back)
    folded = vectors @ (layer[:, 1] - layer[:, 0])
    return QualityModel(folded.astype(np.float32), float(bias[1] - bias[0]) + shift)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_column: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES, **options) -> QualityModel:
    """Learn from documents outside the held-out fold: of each label ``per_class`` rows and ``sample_bytes`` at most."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(buckets_of, 50_000)
        for batch in pieces(batches, "body"):
            both = [document_features(t, memo) for t in utf8(batch.column("body"))]
            arrays = [batch.column("order"), batch.column("y"), pa.array([i.astype(np.uint16).tobytes() for i, _ in both], pa.binary()), pa.array([s.tobytes() for _, s in both], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["order", "y", "idx", "share"])

    sample = labelled_sample(docs, labels, label, per_class, id_column=id_column, text=text)
    found = within(sample.mapInArrow(features, "order long, y int, idx binary, share binary"), ["idx", "share"], sample_bytes)
    rows = found.toArrow().sort_by([(c, "ascending") for c in ("order", "y", "idx", "share")])  # 2 * sample_bytes at most
    totals, y = class_totals(labels, label, id_column), rows.column("y").to_pylist()
    sampled = (y.count(0), y.count(1))
    if min(sampled) == 0:
        return QualityModel(np.zeros(1 << BITS, np.float32), math.log((totals[1] + 1) / (totals[0] + 1)))
    ready = zip(arrays_of(rows.column("idx"), np.uint16), arrays_of(rows.column("share"), np.float32), y)
    return train_embeddings(list(ready), shift=prior_shift(totals, sampled), **options)


def score_quality(docs: DataFrame, model: QualityModel, *, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a column ``out``: the softmax probability of label 1, over the whole text. One map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bias = word_logits(shared.value.fold), shared.value.bias
        for batch in pieces(batches, text):
            logits = []
            for t in utf8(batch.column(text)):
                tokens = (t or b"").split()
                again = repeats(tokens)
                total = sum(map(words.__getitem__, tokens)) + again * words[REPEAT]
                logits.append(bias + (total / (len(tokens) + again) if tokens else 0.0))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(logits, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))
