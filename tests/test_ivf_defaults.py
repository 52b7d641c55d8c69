import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators.vector import IvfIndex, distances, knn


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_recall_of_the_defaults(spark, sf, metric):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    index = IvfIndex(df, metric=metric)
    index.table = index.table.cache()
    rows = df.collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hits = total = 0
    for q in matrix[ids % 50 == 0]:
        exact = set(ids[np.lexsort((ids, distances(matrix, q, metric)))[:10]].tolist())
        got = {r["vec_id"] for r in index.search(q, 10).collect()}
        hits, total = hits + len(exact & got), total + 10
    print(sf, metric, "nprobe", getattr(index, "nprobe", 4), "recall", hits / total)
    assert hits / total >= 0.9


def test_filtered_search_is_whole_by_default(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = df.filter("vec_id = 50").first()["embedding"]
    where = F.col("label") == 1
    assert [r["vec_id"] for r in IvfIndex(df).search(q, 10, where=where).collect()] == [r["vec_id"] for r in knn(df, q, 10, where=where).collect()]
