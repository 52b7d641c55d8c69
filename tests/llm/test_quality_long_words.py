"""A long word, or a text without white space, counts from its first byte to its last."""

import math
import random
import zlib

import numpy as np

from loomspan.llm import quality


def grams(word):
    m = b"<" + word + b">"
    return [zlib.crc32(m) & 0xFFFF] + [zlib.crc32(m[i : i + n], n) & 0xFFFF for n in (2, 3, 4) for i in range(len(m) - n + 1)]


def test_long_words_are_read_whole(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 100, raising=False)
    rng = random.Random(3)
    fold = np.random.default_rng(5).normal(size=1 << quality.BITS).astype(np.float32)
    for size in (1, 125, 126, 127, 198, 199, 200, 201, 1000):
        word = rng.randbytes(size).translate(bytes(b if b not in b" \t\n\v\f\r" else 65 for b in range(256)))
        want = grams(word)
        logits = quality.word_logits(fold)
        assert math.isclose(logits[word], fold[want].sum(dtype=np.float64) / len(want), abs_tol=1e-6)
        assert size <= 126 or word not in logits
        idx, share = quality.document_features(word + b" ab", quality.Memo(quality.buckets_of))
        both = np.bincount(want, minlength=1 << quality.BITS) / len(want) / 2 + np.bincount(grams(b"ab"), minlength=1 << quality.BITS) / len(grams(b"ab")) / 2
        assert (idx == np.flatnonzero(both)).all() and np.allclose(share, both[idx])


def test_the_middle_of_a_long_text_matters(spark):
    fold = np.random.default_rng(5).normal(size=1 << quality.BITS).astype(np.float32)
    ends = "日" * 100
    docs = spark.createDataFrame([(1, ends + "本" * 900 + ends), (2, ends + "語" * 900 + ends), (3, "x" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["quality"] for r in quality.score_quality(docs, quality.QualityModel(fold, 0.0)).collect()}
    assert abs(got[1] - got[2]) > 0.01 and 0 <= got[3] <= 1
