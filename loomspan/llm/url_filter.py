"""URL filtering against a sorted digest array.

The rules, as ``host/path-prefix`` strings, become one file: their 64-bit xxhash keys ascending, offsets, verdicts and
the strings themselves. The file lies in the shared folder; Spark hands it to every executor, whose workers map it into
memory. A URL offers its host suffixes with its path prefixes (only numbers of host labels and lengths of paths that some
rule has); all candidates of a batch are hashed and looked up by one vectorised binary search, and a found key counts only
if the stored string is the candidate itself, so colliding digests change nothing. The longest fitting rule wins.

A rule set over ``MAX_BYTES`` is not shipped: candidates are then joined with the rules by their strings.

Defined cases
  null URL or none with ``://``: host and path are empty and no rule fits; empty URL: likewise; ports and user names stay
  in the host; no rules: the default verdict for all; a rule given twice: blocked wins; rules that are null: ignored;
  rules of equal length that both fit: that with the longer host; repeated rows: judged alike; very long URLs: whole;
  letters other than A-Z: as they are, also in hosts; empty table: empty result; extra columns pass through, ``out``
  replaces a column of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import free_name, pieces, shared_dir, utf8

MAX_BYTES = 64 << 20
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UPPER = bytes.maketrans(_CAPITALS.encode(), _CAPITALS.lower().encode())
_END_OF_HOST, _END_OF_PATH = re.compile(rb"[/?#]"), re.compile(rb"[?#]")


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z in lower case) and path."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    m = _END_OF_HOST.search(rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, b"")
    return host.translate(_UPPER), _END_OF_PATH.split(rest, maxsplit=1)[0]


def normal_rule(rule: bytes) -> bytes:
    host, slash, path = rule.partition(b"/")
    return host.translate(_UPPER) + slash + path


class DigestArray:
    """Sorted xxhash64 keys with the strings they stand for."""

    @staticmethod
    def pack(rules: Iterable[tuple[bytes, bool]]) -> bytes:
        """``rules``: (string, blocked)."""
        verdict: dict[bytes, bool] = {}
        for rule, blocked in rules:
            rule = normal_rule(rule)
            verdict[rule] = verdict.get(rule, False) or blocked
        entries = sorted((xxhash.xxh64_intdigest(r), r) for r in verdict)
        keys = np.array([k for k, _ in entries], np.uint64)
        offsets = np.concatenate(([0], np.cumsum([len(r) for _, r in entries], dtype=np.int64))).astype(np.int64)
        flags = np.array([verdict[r] for _, r in entries], np.uint8)
        lengths = np.array(sorted({len(r) - r.index(b"/") if b"/" in r else 0 for r in verdict}), np.int64)
        labels = np.array(sorted({r.partition(b"/")[0].count(b".") + 1 for r in verdict}), np.int64)
        head = np.array([len(entries), len(lengths), len(labels)], np.int64)
        return b"".join([*(x.tobytes() for x in (head, keys, offsets, lengths, labels, flags)), *(r for _, r in entries)])

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, lengths, labels = (int(x) for x in raw[:24].view(np.int64))
        cut = np.cumsum([24, 8 * n, 8 * (n + 1), 8 * lengths, 8 * labels, n]).tolist()
        self.keys = raw[cut[0] : cut[1]].view(np.uint64)
        self.offsets = raw[cut[1] : cut[2]].view(np.int64)
        self.lengths = raw[cut[2] : cut[3]].view(np.int64).tolist()
        self.labels = raw[cut[3] : cut[4]].view(np.int64).tolist()
        self.blocked = raw[cut[4] : cut[5]]
        self.strings = raw[cut[5] :]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The place of each candidate, or -1."""
        place = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return place
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == candidates[i]:
                    place[i] = k
                    break
                k += 1
        return place


def candidates_of(host: bytes, path: bytes, labels: list[int], lengths: list[int]) -> list[tuple[bytes, int]]:
    """(candidate rule, length of its host), for each number of host labels and each prefix length that rules have."""
    if not host:
        return []
    parts = host.rsplit(b".", max(labels, default=0))
    hosts = [b".".join(parts[-n:]) for n in labels if n < len(parts)] + ([host] if host.count(b".") + 1 in labels else [])
    return [(h + path[:n], len(h)) for h in hosts for n in lengths if n <= len(path)]


_JUDGED = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
_JUDGED_ARROW = pa.struct([(n, pa.string()) for n in ("host", "path", "rule", "verdict")])


_SHIPPED: set[tuple[str, str]] = set()


def _ship(spark: SparkSession, packed: bytes) -> str:
    """Put the array into the shared folder and have every executor, also later ones, fetch it. Its name is its digest's,
    so an application ships a rule set once; the file goes when the driver's process ends."""
    name = f"loomspan-urls-{spark.sparkContext.applicationId}-{xxhash.xxh128_hexdigest(packed)}.bin"
    if (spark.sparkContext.applicationId, name) in _SHIPPED:
        return name
    target = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    for i in range(0, len(packed), 1 << 20):
        stream.write(packed[i : i + (1 << 20)])
    stream.close()
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    spark.sparkContext.addFile(place.makeQualified(files.getUri(), place).toString())
    _SHIPPED.add((spark.sparkContext.applicationId, name))
    return name


_OPEN: dict[str, DigestArray] = {}


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", rule: str = "rule", verdict: str = "verdict", default: str = "allow", out: str = "judgement", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with a struct column ``out``: host, path, rule (null where none fits) and verdict.

    ``rules``: strings like ``example.org/news/`` with ``allow`` or ``block``. ``out`` replaces a column of that name.
    """
    spark = pages.sparkSession
    pages = pages.drop(out)
    rules = rules.select(F.col(rule).cast("string").alias("rule"), (F.lower(F.col(verdict)) == "block").alias("blocked")).filter("rule IS NOT NULL")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 32), F.lit(0)).alias("b")).first()["b"]
    schema = T.StructType([*pages.schema.fields, T.StructField(out, _JUDGED)])
    if size > max_bytes:
        return _judge_by_join(pages, rules, url, default, out)
    name = _ship(spark, DigestArray.pack((r["rule"].encode(), bool(r["blocked"])) for r in rules.toLocalIterator()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = DigestArray(SparkFiles.get(name))
        array = _OPEN[name]
        for batch in pieces(batches, url, rows=4096, limit=1 << 20):
            split = [split_url(u) for u in utf8(batch.column(url))]
            offered, owner = [], []
            for i, (host, path) in enumerate(split):
                for c in candidates_of(host, path, array.labels, array.lengths):
                    offered.append(c)
                    owner.append(i)
            best: dict[int, tuple[int, int, int, int]] = {}
            for j in np.flatnonzero((place := array.find([c for c, _ in offered])) >= 0).tolist():
                c, host_length = offered[j]
                best[owner[j]] = max(best.get(owner[j], (0, 0, 0, 0)), (len(c), host_length, j, int(place[j])))
            rows = []
            for i, (host, path) in enumerate(split):
                won = best.get(i)
                rows.append({"host": host.decode(), "path": path.decode(), "rule": offered[won[2]][0].decode() if won else None, "verdict": ("block" if array.blocked[won[3]] else "allow") if won else default})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _JUDGED_ARROW)], [*batch.schema.names, out])

    return pages.mapInArrow(judge, schema)


def _judge_by_join(pages: DataFrame, rules: DataFrame, url: str, default: str, out: str) -> DataFrame:
    """For rule sets of any size: distinct URLs explode into candidates, which join the rules by string."""
    host = F.substring_index("rule", "/", 1)
    normal = F.concat(F.translate(host, _CAPITALS, _CAPITALS.lower()), F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)"))
    rules = rules.groupBy(normal.alias("candidate")).agg(F.max("blocked").alias("blocked"))
    host = F.substring_index("candidate", "/", 1)
    shapes = rules.select((F.octet_length("candidate") - F.octet_length(host)).alias("n"), (F.regexp_count(host, F.lit(r"\.")) + 1).alias("k")).distinct().collect()  # as many as rules have shapes
    lengths, labels = sorted({r["n"] for r in shapes}), sorted({r["k"] for r in shapes})
    schema = "u string, host string, path string, candidate string, host_length int"

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "u", rows=1024, limit=1 << 20):
            rows = []
            for u in utf8(batch.column("u")):
                host, path = split_url(u)
                for c, n in [*candidates_of(host, path, labels, lengths), (None, 0)]:
                    rows.append({"u": u, "host": host, "path": path, "candidate": c, "host_length": n})
            kinds = [pa.field(n, pa.binary()) for n in ("u", "host", "path", "candidate")]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*kinds, pa.field("host_length", pa.int32())])).cast(pa.schema([*(pa.field(k.name, pa.string()) for k in kinds), pa.field("host_length", pa.int32())]))

    offered = pages.select(F.col(url).alias("u")).distinct().mapInArrow(offer, schema)
    judged = offered.join(rules, "candidate", "left").filter("candidate IS NULL OR blocked IS NOT NULL")
    best = judged.groupBy("u").agg(F.max(F.struct(F.coalesce(F.octet_length("candidate"), F.lit(-1)), "host_length", "candidate", "blocked", "host", "path")).alias("b"))
    verdict = F.when(F.col("b.candidate").isNull(), F.lit(default)).when(F.col("b.blocked"), F.lit("block")).otherwise(F.lit("allow"))
    best = best.select("u", F.struct(F.col("b.host").alias("host"), F.col("b.path").alias("path"), F.col("b.candidate").alias("rule"), verdict.alias("verdict")).alias(out))
    key = free_name(pages, "u")
    return pages.join(best.withColumnRenamed("u", key), F.col(url).eqNullSafe(F.col(key))).drop(key)


#: The rules of op5.
OP5_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(OP5_RULES, "rule string, verdict string")
    return judge_urls(pages, rules).select("page_id", "judgement.host", "judgement.path", "judgement.rule", "judgement.verdict")


OP5_SQL = """
WITH r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC) AS n
  FROM s LEFT JOIN r ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
                    AND starts_with(s.path, substr(r.rule, strpos(r.rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
