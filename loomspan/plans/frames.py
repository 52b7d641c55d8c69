"""Registered queries that are DataFrame programs rather than SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import ordering, shapes, vector
from ..session import shared_folder
from ..sources.snapshots import SnapshotTable
from ..streaming import events as streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    return _table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


def knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = vector.knn(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, metric=metric)
        return found.select("vec_id", F.round("distance", 4).alias("distance"))

    return run


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.knn(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, metric="l2", where=F.col("label") == 1)
    return found.select("vec_id", F.round("distance", 4).alias("distance"))


def knn_ivf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cell probed an index search is exact."""
    index = vector.IvfIndex(_table(spark, sf_dir, "embeddings"), cells=8)
    return index.search(_query_vector(spark, sf_dir), 10, nprobe=8).select("vec_id", F.round("distance", 4).alias("distance"))


def knn_of_all(metric: str):
    """Every row whose id is divisible by 50 against all rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "embeddings")
        found = vector.knn_all(rows, rows.filter("vec_id % 50 = 0"), 10, metric=metric)
        return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), "place")

    return run


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index finds of the true neighbours, with the cells that it probes by default: 0.9 of them or more."""
    rows = _table(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 50 = 0")
    found = vector.IvfIndex(rows).search_all(queries).select("query_id", "id", F.lit(1).alias("hit"))
    both = vector.knn_all(rows, queries).join(found, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table from a list of files."""
    return Engine(spark).register_parquet("both_nations", [f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed mode with all cells and codes refined: the true neighbours."""
    engine = Engine(spark)
    engine.register_parquet("indexed_vectors", f"{sf_dir}/embeddings.parquet")
    found = engine.knn("indexed_vectors", _query_vector(spark, sf_dir), 10, mode="indexed", nprobe=16, refine=20)
    return found.select("vec_id", F.round("distance", 4).alias("distance"))


def snapshot_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, append, overwrite; rows of each version."""
    nation = _table(spark, sf_dir, "nation")
    table = SnapshotTable(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    table.write(nation.filter("n_regionkey = 0"), "create")
    table.write(nation.filter("n_regionkey = 1"), "append")
    table.write(nation.filter("n_regionkey > 1"), "overwrite")
    parts = [table.read(v).select(F.lit(v).alias("version"), "n_nationkey") for v in table.versions()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eager_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shapes.eager_aggregate(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part"), "l_partkey", "p_partkey", "p_brand", "l_quantity")
    return out.select("p_brand", F.round("sum_l_quantity", 2).alias("q"), "n")


def having_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.share_of_total(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 0.0101).select("l_suppkey", F.round("s", 2).alias("s"))


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customer and supplier by nation; suppliers are counted first, so that the join has a row per customer, not per pair."""
    left = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    right = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return shapes.salted_join(left, right, "k").groupBy("k").agg(F.sum("suppliers").alias("n"))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return shapes.as_of_join(errors, buys, "user_id", "ts", "ts", "ts").select("event_id", F.col("as_of").alias("last_purchase"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_k(_table(spark, sf_dir, "orders"), 10, "-o_totalprice", "o_orderkey", offset=5).select("o_orderkey", "o_totalprice")


def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_k_per_group(_table(spark, sf_dir, "orders"), 1, ["o_custkey"], "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(_table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(_table(spark, sf_dir, "events"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(_table(spark, sf_dir, "events"))


_KNN = "SELECT vec_id, round({d}, 4) AS distance FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7){w} ORDER BY {d}, vec_id LIMIT 10"
_L2, _COS, _DOT = "list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))", "(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])))", "(-list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])))"
_ALL_L2, _ALL_COS = (d.replace("CAST(q AS", "CAST(q.embedding AS") for d in (_L2, _COS))
FRAMES = {
    "vector_knn_l2": (knn("l2"), _KNN.format(d=_L2, w="")),
    "vector_knn_cosine": (knn("cosine"), _KNN.format(d=_COS, w="")),
    "vector_knn_dot": (knn("dot"), _KNN.format(d=_DOT, w="")),
    "vector_knn_filtered": (knn_filtered, _KNN.format(d=_L2, w=" WHERE e.label = 1")),
    "vector_knn_ivf_full": (knn_ivf_full, _KNN.format(d=_L2, w="")),
    **{f"vector_knn_all_{m}": (knn_of_all(m), f"SELECT query_id, vec_id, round(distance, 4) AS distance, CAST(place AS INTEGER) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id, {d} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, e.vec_id) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 10") for m, d in (("l2", _ALL_L2), ("cosine", _ALL_COS))},
    "vector_ivf_recall": (ivf_recall, "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0"),
    "vector_knn_indexed": (indexed_search, _KNN.format(d=_L2, w="")),
    "scan_file_list": (file_list, "SELECT n_name, 2 AS n FROM nation"),
    "snapshot_time_travel": (snapshot_time_travel, "SELECT 1 AS version, n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_regionkey <= 1 UNION ALL SELECT 3, n_nationkey FROM nation WHERE n_regionkey > 1"),
    "shape_eager_aggregation": (eager_aggregation, "SELECT p_brand, round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"),
    "shape_having_total": (having_total, "SELECT l_suppkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT sum(l_quantity) * 0.0101 FROM lineitem)"),
    "shape_salted_join": (salted, "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY c_nationkey"),
    "shape_as_of_join": (as_of, "SELECT e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND p.ts <= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id"),
    "frame_top_k_offset": (top_k, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "frame_top_k_per_group": (top_k_per_group, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1"),
    "stream_tumbling": (tumbling_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type"),
    "stream_sliding": (sliding_windows, "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start FROM events, (VALUES (0), (1)) AS o(i)) GROUP BY start"),
    "stream_sessions": (session_windows, "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s"),
}
