"""The engine: a Spark session, its tables, and SQL with the engine's function names and defaults."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pyfuncs
from .operators import vector
from .plans.counts import counted_apart
from .plans.dialect import tokens, translate
from .plans.division import integer_divisions
from .plans.percentile import exact_percentiles
from .session import TABLES, build_session


class Engine:
    """``Engine(spark).sql("SELECT ...")``. Results are lazy DataFrames; Catalyst plans them."""

    #: (application, view) -> folder, of what ``register_dir`` has registered: a table's footers are read once.
    _registered: dict[tuple[str, str], str] = {}

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or build_session()
        self._indexes: dict[tuple[str, str, str], vector.IvfIndex] = {}

    # tables

    def register_parquet(self, name: str, path: str | Sequence[str]) -> DataFrame:
        """A Parquet file, folder, or list of files as a table."""
        df = self.spark.read.parquet(*([path] if isinstance(path, str) else path))
        return self.register(name, df)

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self._registered.pop((self.spark.sparkContext.applicationId, name), None)
        return df

    def register_dir(self, folder: str, only: set[str] | None = None, refresh: bool = False, some: bool = False) -> Engine:
        """The tables of ``folder``, one Parquet each; with ``some``, those of them that are there. One that is registered
        from there stays as it is, files and schema as they were seen, unless ``refresh``."""
        for name in TABLES:
            key = (self.spark.sparkContext.applicationId, name)
            if (only is None or name in only) and (refresh or self._registered.get(key) != folder):
                try:
                    self.register_parquet(name, f"{folder}/{name}.parquet")
                except AnalysisException as e:
                    if some and e.getCondition() == "PATH_NOT_FOUND":
                        continue
                    raise
                self._registered[key] = folder
        return self

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def cache(self, name: str) -> None:
        """Keep a table decoded in memory, spilling to disk."""
        self.spark.sql(f"CACHE TABLE `{name}` OPTIONS ('storageLevel' 'MEMORY_AND_DISK')")

    # queries

    def translate(self, sql: str, joined_not_in: bool = True) -> str:
        """The Spark SQL of ``sql``; functions it needs are registered."""
        text = translate(sql.strip().rstrip(";"), joined_not_in)
        pyfuncs.register(self.spark, set(re.findall(r"\bloom_(\w+)\(", text)))
        return text

    def sql(self, sql: str) -> DataFrame:
        exact = exact_percentiles(sql)
        if exact != sql:
            try:
                return self._planned(exact)
            except AnalysisException:
                pass  # rows that refer to a query around them, or names that only the statement as it was resolves
        return self._planned(sql)

    def _planned(self, sql: str) -> DataFrame:
        text = self.translate(sql)
        try:
            df = self.spark.sql(text)
        except AnalysisException:
            plain = self.translate(sql, joined_not_in=False)
            if plain == text:
                raise
            text, df = plain, self.spark.sql(plain)  # a NOT IN whose subquery refers to the query around it
        while (turned := integer_divisions(df, text, tokens(text))) is not None:
            text, df = turned, self.spark.sql(turned)
        counted = counted_apart(df)
        return df if counted is None else counted

    # vectors

    def knn(self, table: str, query: Sequence[float], k: int = 10, *, mode: str = "exact", metric: str = "l2", column: str = "embedding", id_column: str = "vec_id", where: Column | None = None, nprobe: int | None = None, refine: int | None = 10) -> DataFrame:
        """The ``k`` nearest rows of ``table``. ``mode``: ``exact``, or ``indexed``, which reads the ``nprobe`` nearest cells
        of the table's index (made by ``create_index``, or now), ranks by codes and then the best ``refine * k`` exactly
        (None: all of them exactly)."""
        if mode == "exact":
            return vector.knn(self.spark.table(table), query, k, metric=metric, column=column, where=where, id_column=id_column)
        if mode != "indexed":
            raise ValueError("mode is exact or indexed")
        index = self._indexes.get((table, column, metric)) or self.create_index(table, metric=metric, column=column, id_column=id_column)
        return index.search(query, k, nprobe, where, refine)

    def create_index(self, table: str, path: str | None = None, **options) -> vector.IvfIndex:
        """An index over a table's vectors, under ``path`` if given, for ``knn`` in indexed mode."""
        index = vector.IvfIndex(self.spark.table(table), **options)
        self._indexes[table, index.column, index.metric] = index.save(path) if path else index
        return index

    # statistics

    def analyze(self, name: str, path: str) -> None:
        """``name`` as a catalog table over the Parquet at ``path``, with row counts and column statistics for the
        cost-based optimizer, which is switched on."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` USING parquet LOCATION '{path}'")
        self.spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS FOR ALL COLUMNS")
        for setting in ("enabled", "joinReorder.enabled", "planStats.enabled"):
            self.spark.conf.set(f"spark.sql.cbo.{setting}", "true")

    def expr(self, text: str) -> Column:
        """An expression with the engine's functions, for the DataFrame API."""
        return F.expr(self.translate(text))

    def explain(self, sql: str, mode: str = "formatted") -> None:
        self.sql(sql).explain(mode)


def query(sql: str):
    """A registered query: (spark, sf_dir) -> DataFrame, with just the tables that the text names."""
    named = {t for t in TABLES if re.search(rf"\b{t}\b", sql)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).register_dir(sf_dir, named).sql(sql)

    return run
