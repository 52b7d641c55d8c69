"""Pieces shared by the corpus operators: shared storage, fixed-size bit filters, Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the labelled fold held out of every training run, crc32(doc_id as text) mod 4.
HELD_OUT = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Where it is unset: on one machine (tests) a folder of our
    own, on a cluster one in the warehouse, never a machine-local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        path = tempfile.mkdtemp(prefix="loomspan-shared-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_loomspan"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: While a table is saved: shuffle files go as soon as it has been written, and batches sent to Python stay small.
_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Once the driver's heap has been grown beyond this share of its limit, garbage is collected after each saved table.
GROWN_HEAP = 0.4


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables written to the shared folder, so that a lost executor costs no recomputation
    beyond its own tasks. ``drop`` frees one early; the rest goes when the driver's process ends, or with ``close``, once
    everything that reads the tables has been written elsewhere. ``collected`` notes what is made within it, for a caller
    who closes what operators leave."""

    _notes: ContextVar[list[Scratch] | None] = ContextVar("loomspan_scratch", default=None)

    @classmethod
    @contextmanager
    def collected(cls, into: list[Scratch]) -> Iterator[None]:
        token = cls._notes.set(into)
        try:
            yield
        finally:
            cls._notes.reset(token)

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomspan-{label}-{uuid.uuid4().hex}"
        if (notes := self._notes.get()) is not None:
            notes.append(self)
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str, partition_by: Iterable[str] = (), **options: str) -> DataFrame:
        """Write ``df`` as Parquet and return the reread table."""
        path = f"{self.root}/{name}"
        with _settings(self.spark, _SAVING):
            df.write.mode("overwrite").options(**{"parquet.block.size": str(32 << 20)} | options).partitionBy(*partition_by).parquet(path)
        runtime = self.spark.sparkContext._jvm.Runtime.getRuntime()
        if runtime.totalMemory() > GROWN_HEAP * runtime.maxMemory():
            self._collect()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more. The plans that made them are garbage by then, here and in the JVM;
        collecting it keeps the driver's memory near what it holds."""
        for name in names:
            self._remove(f"{self.root}/{name}".rstrip("/"))
        self._collect()

    def _collect(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        self.drop("")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended already; the cluster's own cleaner takes the rest
            return


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels may never be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


class BitFilter:
    """A Bloom filter over 64-bit hashes, kept as ``2**log2_words`` rows of 64 bits.

    Its size is fixed by ``log2_words`` alone (default: 2**17 rows, 8.4 million bits), so broadcasting it is
    bounded whatever the data. It has no false negatives: ``keep`` never loses a row of ``keys``. When far more
    keys than bits go in it passes everything, which costs speed, never rows.
    """

    def __init__(self, keys: DataFrame, column: str, log2_words: int = 17):
        self.log2_words = log2_words
        h = F.xxhash64(F.col(column))
        word, bits = self._place(h)
        self.words = keys.select(word.alias("_bf_word"), bits.alias("_bf_mask")).groupBy("_bf_word").agg(F.expr("bit_or(_bf_mask)").alias("_bf_bits"))

    def _place(self, h: Column) -> tuple[Column, Column]:
        word = h.bitwiseAND(F.lit((1 << self.log2_words) - 1)).cast("int")
        one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        return word, one(40).bitwiseOR(one(50))

    def mark(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """Add ``flag``: whether the row's key may be among ``keys``. No other column of ``df`` changes, whatever its name."""
        word, mask = self._place(F.xxhash64(F.col(column)))
        probe, want, at, bits = (free_name(df, f"_bf_{n}") for n in ("probe", "want", "word", "bits"))
        words = self.words.select(F.col("_bf_word").alias(at), F.col("_bf_bits").alias(bits))
        joined = df.withColumns({probe: word, want: mask}).join(F.broadcast(words), F.col(probe) == F.col(at), "left")
        hit = F.coalesce(F.col(bits).bitwiseAND(F.col(want)) == F.col(want), F.lit(False))
        return joined.withColumn(flag, hit).drop(probe, want, at, bits)

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows whose key may be among ``keys``."""
        flag = free_name(df, "_bf_hit")
        return self.mark(df, column, flag).filter(flag).drop(flag)


#: A key with more than one in so many of all rows is hot; no more than so many keys can be.
HOT_SHARE = 1000


def join_unique(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``rows`` how many rows of ``left`` have it.

    The hot keys, ``HOT_SHARE`` at most whatever the data, are broadcast, so that their rows stay where they are; the
    others are dealt out by key, of which none then holds more than that share of all rows.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(rows) * HOT_SHARE > total
    columns = [c for c in right.columns if c not in on]
    hot = F.broadcast(right.filter(is_hot))
    in_hot = left.join(hot, on, "inner")
    rest = left.join(F.broadcast(right.filter(is_hot).select(*on)), on, "left_anti").join(right.filter(~is_hot), on, how)
    return in_hot.select(*left.columns, *columns).unionByName(rest.select(*left.columns, *columns))


def without_ids(docs: DataFrame, gone: DataFrame, id_column: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone`` (one column). Only rows that may go are joined; the rest, most
    of the texts, do not move. Null ids stay."""
    (key,) = gone.columns
    flag, to = free_name(docs, "_maybe"), free_name(docs, "_gone")
    marked = BitFilter(gone, key).mark(docs, id_column, flag)
    left = marked.filter(flag).join(gone.select(F.col(key).alias(to)), F.col(id_column) == F.col(to), "left_anti")
    return marked.filter(~F.col(flag)).unionByName(left).select(*docs.columns)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: str, rows: int = 512, limit: int = 16 << 20) -> Iterable[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``rows`` rows and, beyond its first row, ``limit`` bytes of
    ``column``: working memory then follows the longest text, not the batch size."""
    for batch in batches:
        lengths = [n or 0 for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or total + n > limit):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(lengths) > start:
            yield batch.slice(start)


class Memo(dict):
    """A function's results, remembered in two generations of at most ``limit`` keys: memory is bounded, and what is
    used again survives."""

    def __init__(self, compute, limit: int = 50_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value
