"""Sketches that are folded before they go with every pair that meets in a bucket."""

import numpy as np
import pytest
from test_toxicity_whole import shuffled

from loomspan.llm import ngram_join

#: Bytes: 27.5 million are shuffled, 32.0 million when whole sketches went with every pair.
LIMIT = 29_000_000


@pytest.fixture(scope="module")
def halves(spark):
    """60 groups of 20 texts of 600 words: half of a text is its group's, so that its texts meet but are not similar. The
    first two of each group are near copies."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        shared = [f"w{w}" for w in rng.integers(0, 10**6, 300)]
        for i in range(20):
            own = [f"w{w}" for w in rng.integers(0, 10**6, 300)]
            if i == 1:
                own = [*first[:-3], "x", "y", "z"]
            first = own
            rows.append((20 * g + i, " ".join(shared + own)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()


def test_whole_sketches_stay_where_pairs_only_meet(spark, halves):
    found = []
    moved = shuffled(spark, lambda: found.extend(ngram_join.similarity_classes(halves).collect()))
    assert {r["id"]: r["component_id"] for r in found} == {i: i - (i % 20 == 1) for i in range(1200)}
    assert moved < LIMIT


@pytest.mark.parametrize("percent", [80, 90])
def test_folding_loses_no_similar_pair(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        size = int(rng.integers(1, 40_000 if _ % 50 == 0 else 1500))
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        b = np.concatenate((a[int(rng.integers(0, size // 8 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64)))
        x, y = map(ngram_join.count_sketch, (a, b))
        rough = [ngram_join.folded(np.frombuffer(v, np.uint8), ngram_join.ROUGH).astype(np.uint8).tobytes() for v in (x, y)]
        if ngram_join.may_be_similar(x, len(a), y, len(b), percent):
            assert ngram_join.may_be_similar(rough[0], len(a), rough[1], len(b), percent)
