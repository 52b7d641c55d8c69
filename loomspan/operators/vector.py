"""Vector search: exact k-NN, filtered k-NN, and an IVF index (opt-in, approximate) with exact refinement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "cosine", "dot")
#: What the default ``nprobe`` of an index reaches on rows of its own sample, for so many neighbours and query rows at most.
RECALL, RECALL_K, RECALL_ROWS = 0.95, 10, 200


def distances(matrix: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is closer for every metric here; ``dot`` is negated."""
    if metric == "l2":
        return np.sqrt(((matrix - query) ** 2).sum(axis=1))
    dots = matrix @ query
    if metric == "dot":
        return -dots
    return 1.0 - dots / (np.linalg.norm(matrix, axis=1) * np.linalg.norm(query))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != width * len(column):
        raise ValueError(f"a vector's dimension is not the query's, {width}")
    return flat.reshape(-1, width)


def with_distance(df: DataFrame, query: Sequence[float], metric: str = "l2", column: str = "embedding", out: str = "distance", codes: float | None = None) -> DataFrame:
    """``df`` with the distance to one query vector, in Arrow batches: one matrix product per batch. Null vectors drop.
    ``codes``: distances of vectors rounded to multiples of it, at most 127 of them."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    q = np.asarray(query, np.float64)
    df = df.drop(out).filter(F.col(column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(column), len(q))
            d = distances(rows if codes is None else np.clip(np.rint(rows / codes), -127, 127) * codes, q, metric)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def knn(df: DataFrame, query: Sequence[float], k: int = 10, *, metric: str = "l2", column: str = "embedding", where: Column | None = None, id_column: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows, exact; ``where`` filters before the search. Ends in a top-k, never in a full sort."""
    if where is not None:
        df = df.filter(where)
    return with_distance(df, query, metric, column).orderBy(F.col("distance").asc(), F.col(id_column).asc()).limit(k)


def _best(matrix: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, metric: str, allowed: np.ndarray | None) -> list[pa.RecordBatch]:
    """The ``k`` nearest rows of one batch to each query: (query_id, id, distance)."""
    d = np.array([distances(matrix, q, metric) for q in queries]) if metric == "l2" else _products(matrix, queries, metric)
    if allowed is not None:
        d = np.where(allowed, d, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k] if len(ids) <= 4 * k else None
    if order is None:
        # All rows as near as the k-th nearest, so that ties are settled by id.
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero(d <= limit)
    else:
        q, r = np.repeat(np.arange(len(queries)), order.shape[1]), order.ravel()
    found = np.isfinite(d[q, r])
    q, r = q[found], r[found]
    return [pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(d[q, r])], ["query_id", "id", "distance"])]


def _products(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    dots = queries @ matrix.T
    return -dots if metric == "dot" else 1.0 - dots / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :])


#: Queries of one block: what is broadcast at a time.
QUERY_BLOCK = 1024


def _query_blocks(queries: DataFrame, column: str, id_column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``QUERY_BLOCK`` queries at a time, read partition by partition."""
    rows = queries.filter(F.col(column).isNotNull()).select(F.col(id_column).cast("long"), column).toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        yield np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)


def knn_all(df: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "l2", column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(query_id, id, distance, place): the ``k`` nearest rows of ``df`` to every row of ``queries``, exact.

    Queries are broadcast in blocks; a batch of rows meets a block in one matrix product, and only its ``k`` best rows for
    each query leave the task. Null vectors drop; ties go to the smaller id.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    rows = df.filter(F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v"))
    return _ranked([_block_search(rows, ids, vectors, k, metric, None) for ids, vectors in _query_blocks(queries, column, id_column)], df, k)


def _block_search(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, probed: np.ndarray | None) -> DataFrame:
    """``probed``: for each query, which cells are read (rows then have a column ``cell``)."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors, probed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, cells = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                allowed = None if cells is None else cells[:, batch.column("cell").to_numpy()]
                yield from _best(_matrix(batch.column("v"), queries.shape[1]), queries, query_ids, batch.column("id").to_numpy(), k, metric, allowed)

    return rows.mapInArrow(run, "query_id long, id long, distance double")


def _ranked(blocks: list[DataFrame], df: DataFrame, k: int) -> DataFrame:
    if not blocks:
        return df.sparkSession.createDataFrame([], "query_id long, id long, distance double, place int")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return reduce(DataFrame.unionByName, blocks).withColumn("place", place).filter(F.col("place") <= k)


class IvfIndex:
    """Inverted file: vectors by nearest centroid. Centroids come from Lloyd's rounds on a sample of at most
    ``sample`` rows; every row is assigned. A search reads the cells of the ``nprobe`` nearest centroids and ranks their
    vectors exactly, so refinement is complete within the cells. The default ``nprobe`` is the least that finds
    ``RECALL`` of the true neighbours of sampled rows within the sample; searches it says nothing about (a filter, more
    than ``RECALL_K`` neighbours) read all cells unless ``nprobe`` is given."""

    def __init__(self, df: DataFrame, cells: int = 16, *, metric: str = "l2", column: str = "embedding", id_column: str = "vec_id", sample: int = 10_000, rounds: int = 10, seed: int = 7):
        self.metric, self.column, self.id_column = metric, column, id_column
        rows = df.filter(F.col(column).isNotNull()).select(column, F.xxhash64(id_column).alias("h")).orderBy("h").limit(sample).collect()  # ``sample`` rows at most
        data = self._unit(np.array([r[column] for r in rows], np.float64))
        rng = np.random.default_rng(seed)
        self.centroids = data[rng.choice(len(data), min(cells, len(data)), replace=False)]
        for _ in range(rounds):
            near = self._cell(data)
            self.centroids = np.array([data[near == c].mean(axis=0) if (near == c).any() else self.centroids[c] for c in range(len(self.centroids))])
        self.scale = float(np.abs(np.array([r[column] for r in rows], np.float64)).max(initial=0.0) or 1.0) / 127
        self.nprobe = self._enough(data)
        self.table = self._assigned(df)

    def _enough(self, data: np.ndarray) -> int:
        cell, ranks = self._cell(data), []
        for q in data[:: -(-len(data) // RECALL_ROWS)]:
            place = np.empty(len(self.centroids), int)
            place[self._nearest(q)] = np.arange(len(place))
            ranks.append(place[cell[np.argsort(distances(data, q, self.metric), kind="stable")[:RECALL_K]]])
        return next(n for n in range(1, len(self.centroids) + 1) if (np.concatenate(ranks) < n).mean() >= RECALL)

    def _nearest(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(((self.centroids - q) ** 2).sum(axis=1))

    def _unit(self, m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if self.metric == "cosine" else m

    def _cell(self, m: np.ndarray) -> np.ndarray:
        return ((m**2).sum(axis=1)[:, None] - 2 * m @ self.centroids.T + (self.centroids**2).sum(axis=1)[None, :]).argmin(axis=1)

    def _assigned(self, df: DataFrame) -> DataFrame:
        column, width = self.column, self.centroids.shape[1]
        df = df.filter(F.col(column).isNotNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = self._cell(self._unit(_matrix(batch.column(column), width))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))

    def save(self, path: str) -> IvfIndex:
        """Write the table by cell: a search then reads only the cells it probes (partition pruning)."""
        self.table.write.mode("overwrite").partitionBy("cell").parquet(path)
        self.table = self.table.sparkSession.read.parquet(path)
        return self

    def _probes(self, k: int, nprobe: int | None, where: Column | None = None) -> int:
        if nprobe is not None:
            return nprobe
        return self.nprobe if where is None and k <= RECALL_K else len(self.centroids)

    def search(self, query: Sequence[float], k: int = 10, nprobe: int | None = None, where: Column | None = None, refine: int | None = None) -> DataFrame:
        """``refine``: rank by distances of vectors rounded to eight bits a number first, the best ``refine * k`` exactly."""
        q = self._unit(np.asarray(query, np.float64)[None, :])[0]
        near = self._nearest(q)[: self._probes(k, nprobe, where)].tolist()
        cells = self.table.filter(F.col("cell").isin(near))
        if refine is not None:
            rows = cells if where is None else cells.filter(where)
            cells, where = with_distance(rows, query, self.metric, self.column, out="distance", codes=self.scale).orderBy("distance").limit(refine * k), None
        return knn(cells, query, k, metric=self.metric, column=self.column, where=where, id_column=self.id_column).drop("cell")

    def search_all(self, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
        """As ``knn_all``, each query in the cells nearest to it."""
        rows = self.table.select(F.col(self.id_column).cast("long").alias("id"), F.col(self.column).alias("v"), "cell")
        blocks = []
        for ids, vectors in _query_blocks(queries, self.column, self.id_column):
            probed = np.zeros((len(ids), len(self.centroids)), np.bool_)
            for i, q in enumerate(self._unit(vectors)):
                probed[i, self._nearest(q)[: self._probes(k, nprobe)]] = True
            blocks.append(_block_search(rows, ids, vectors, k, self.metric, probed))
        return _ranked(blocks, self.table, k)
