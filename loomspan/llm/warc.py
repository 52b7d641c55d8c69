"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: one record per page. Of pages with equal payloads (SHA-1) that with the smallest id is a ``response``, whose
block is an HTTP message in chunked transfer framing; others are ``revisit`` records that refer to it. A block over
``segment_bytes`` continues in ``continuation`` records. Records go out through Spark's own text writer, whose line
separator is the blank lines that end a WARC record, so any store that Spark writes to will do.

Reading: WARC/1.0 and 1.1. Files are split at what may be record heads, so one large archive is read by many tasks; a
payload that happens to hold such text is told from a record by Content-Length and put together again. What lies across the
border of two tasks' stretches of a file goes, by file and place, to one task that reads it in order, a record at a time.
Segments are grouped by origin, ordered by number, and their length is held against WARC-Segment-Total-Length; then chunked
framing is decoded and the payload's digest is held against the record's. Whatever does not agree, and any file that does
not begin with a record, fails the read.

Defined cases
  null html: the empty payload; null id: read back as null, and never the response while another row has an id; repeated rows
  (equal id and payload): each is read back, all as responses if their id is the smallest; empty table: no records; null
  or odd URLs: control characters are percent-encoded, a null URL has no WARC-Target-URI; very long payloads: in segments;
  ties (equal payloads): the smallest id responds; extra columns: ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import _SAVING, BitFilter, Scratch, _settings, pieces

HEAD, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Where readers cut, and what follows it in a record of either version.
CUT, _BEGINS = b"WARC/1.", re.compile(rb"[01]\r\n")
SEGMENT_BYTES, CHUNK_BYTES = 1 << 20, 8192
#: What a worker takes up at a time, beyond one record.
BATCH_BYTES = 4 << 20
#: While pages are read: batches sent to Python stay small, and so do those of the Parquet reader, which holds whole payloads.
_READING = _SAVING | {"spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Of the archive, for each file of the narrow table made from it.
ARCHIVE_BYTES_PER_FILE = 128 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body ends inside a size line")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The entity of an HTTP message."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP message has no end of headers")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return HEAD + lines.encode() + b"\r\n" + block


def _cuts(block: bytes, segment_bytes: int) -> list[bytes]:
    """The block in segments; a record head inside it is cut in two, so that readers may split at heads."""
    at = {0, len(block), *range(segment_bytes, len(block), segment_bytes)}
    at |= {m.start() + 5 for m in re.finditer(re.escape(CUT), block)}
    edges = sorted(at)
    return [block[a:b] for a, b in zip(edges, edges[1:])] or [b""]


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", min_payload: int = 0, segment_bytes: int = SEGMENT_BYTES, mode: str = "errorifexists") -> None:
    """Write ``pages`` as WARC files under ``path``. Payloads under ``min_payload`` bytes are all responses."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("key"), F.col(url).cast("string").alias("uri"), body.cast("binary").alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    narrow = rows.filter(F.octet_length("payload") >= min_payload).select("key", digest.alias("sha1"))
    shared = narrow.groupBy("sha1").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")
    scratch = Scratch(pages.sparkSession, "warc-write")
    with _settings(pages.sparkSession, _READING):
        shared = scratch.save(shared, "shared")
    rows = BitFilter(shared, "sha1").mark(rows.withColumn("sha1", digest), "sha1", "maybe")
    alone = rows.filter("NOT maybe").select("id", "uri", "payload", F.lit(None).cast("string").alias("refers"))
    both = rows.filter("maybe").join(shared, "sha1", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key")) & (F.octet_length("payload") >= min_payload), F.col("first").cast("string"))
    table = alone.unionByName(both.select("id", "uri", "payload", refers.alias("refers")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload", limit=BATCH_BYTES):
            out = []
            for r in batch.to_pylist():
                digest = sha1_base32(r["payload"])
                uri = None if r["uri"] is None else quote(r["uri"], safe="".join(map(chr, range(33, 127))))
                name = f"<urn:page:{r['id']}:{digest}>"
                common = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if r["refers"] is not None:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{r['refers']}:{digest}>")], b""))
                    continue
                block = _HTTP + chunked(r["payload"])
                segments = _cuts(block, segment_bytes)
                many = len(segments) > 1
                out.append(_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", 1 if many else None)], segments[0]))
                for n, part in enumerate(segments[1:], 2):
                    total = len(block) if n == len(segments) else None
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = table.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    with _settings(pages.sparkSession, _READING):
        records.write.mode(mode).option("lineSep", END.decode()).text(path)
    scratch.close()


_RAW = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, origin string, segment int, total long, block binary"
_PLACE = "path string, start long, nth long, opens boolean, fragment binary"


class _Joiner:
    """Pieces of a stretch of a file, in order, as records."""

    def __init__(self):
        self.held: bytes | None = None

    def feed(self, piece: bytes) -> dict | None:
        """The record that ``piece`` completes. The first piece must begin one."""
        self.held = piece if self.held is None else self.held + CUT + piece
        head, found, rest = self.held.partition(b"\r\n\r\n")
        if not found:
            return None
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
        if "content-length" not in fields:
            raise ValueError("a record has no Content-Length")
        size = int(fields["content-length"])
        if len(rest) < size:  # what looked like the next record's head belongs to this block
            return None
        if rest[size:].strip(b"\r\n"):
            raise ValueError("a record is longer than its Content-Length")
        self.held = None
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        return {
            "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to"),
            "origin": fields.get("warc-segment-origin-id") or (fields.get("warc-record-id") if number else None),
            "segment": int(number) if number else None, "total": int(total) if total else None, "block": rest[:size],
        }


def _stretches(spark: SparkSession, path: str, few: bool, decode: bool = False) -> DataFrame:
    """Of what lies in one task's stretch of a file: segments and, with their place, the fragments at its borders (``few``),
    or the records in one piece. ``decode``: with their payloads as blocks. The worker keeps the others back."""
    lines = spark.read.option("lineSep", CUT.decode()).text(path).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, here, nth = _Joiner(), None, 0

        def border(piece: bytes, opens: bool) -> dict:
            return {"path": here[0], "start": here[1], "nth": nth, "opens": opens, "fragment": piece}

        for batch in pieces(batches, "raw", limit=BATCH_BYTES):
            out = []
            for raw, *place in zip(batch.column("raw").to_pylist(), batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                if place != here:
                    if few and joiner.held is not None:
                        out.append(border(joiner.held, True))
                    joiner, here, nth = _Joiner(), place, 0
                    begun = False
                    if not place[1]:  # what stands before the first record
                        if raw.strip():
                            raise ValueError(f"{place[0]} is no WARC/1.0 or WARC/1.1 archive")
                        begun = True
                        continue
                nth += 1
                if joiner.held is None and not (_BEGINS.match(raw) and (begun or b"warc-type:" in raw[:8192].lower())):
                    if begun:
                        raise ValueError(f"{place[0]} has a record of an unknown version")
                    if few:
                        out.append(border(raw, False))
                    continue
                begun = True
                if (record := joiner.feed(raw)) and few == (record["segment"] is not None):
                    out.append(record | {"block": _payload(record, record["block"])} if decode else record)
            yield pa.RecordBatch.from_pylist(out, _ARROW_STRETCH)
        if few and joiner.held is not None:
            yield pa.RecordBatch.from_pylist([border(joiner.held, True)], _ARROW_STRETCH)

    return lines.mapInArrow(parse, f"{_RAW}, {_PLACE}")


def _mended(fragments: DataFrame) -> DataFrame:
    """The records across borders: each task reads the fragments of its files in order and holds one record at a time."""

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, file = _Joiner(), None
        for batch in pieces(batches, "fragment", limit=BATCH_BYTES):
            out = []
            for r in batch.to_pylist():
                if joiner.held is not None and (r["opens"] or r["path"] != file):
                    raise ValueError(f"{file}: a record ends before its Content-Length")
                if joiner.held is None and not r["opens"]:
                    raise ValueError(f"{r['path']} has what belongs to no record")
                file = r["path"]
                if record := joiner.feed(r["fragment"]):
                    out.append(record)
            yield pa.RecordBatch.from_pylist(out, _ARROW_RAW)
        if joiner.held is not None:
            raise ValueError(f"{file}: a record ends before its Content-Length")

    return fragments.repartition("path").sortWithinPartitions("path", "start", "nth").mapInArrow(mend, _RAW)


_ARROW_RAW = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "origin")), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
_ARROW_STRETCH = pa.schema([*_ARROW_RAW, ("path", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("opens", pa.bool_()), ("fragment", pa.binary())])


def _parts(spark: SparkSession, path: str, scratch: Scratch, decode: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records in one piece (``decode``: their payloads), and segments with the records across borders, few of both, which are saved."""
    few = scratch.save(_stretches(spark, path, few=True), "few")
    columns = [f.name for f in _ARROW_RAW]
    return _stretches(spark, path, few=False, decode=decode).select(*columns), few.filter("fragment IS NULL").select(*columns).unionByName(_mended(few.filter("fragment IS NOT NULL")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path`` as they stand, segments apart."""
    whole, few = _parts(spark, path, Scratch(spark, "warc-read"))
    return whole.unionByName(few)


_WHOLE = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"


def _payload(r: dict, block: bytes) -> bytes:
    """The decoded payload of a record, held against the digest it states."""
    payload = http_payload(block) if r["record_type"] == "response" else block
    said = r["payload_digest"]
    if r["record_type"] == "response" and said and said.startswith("sha1:") and said[5:] != sha1_base32(payload):
        raise ValueError(f"{r['record_id']} has another digest than it says")
    return payload


def _assembled(r: dict) -> tuple[dict, int]:
    """A record with its decoded payload, and how often it is there."""
    segments: dict[int, bytes] = {}
    for p in r["parts"]:
        if segments.setdefault(p["n"], p["b"]) != p["b"]:
            raise ValueError(f"two different segments {p['n']} of {r['record_id']}")
    copies, rest = divmod(len(r["parts"]), len(segments))
    if rest or sorted(segments) != list(range(1, len(segments) + 1)):
        raise ValueError(f"segments of {r['record_id']} are missing")
    block = b"".join(segments[n] for n in sorted(segments))
    if len(segments) > 1 and r["total"] != len(block):
        raise ValueError(f"{r['record_id']} has {len(block)} bytes, not {r['total']}")
    return {k: r[k] for k in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")} | {"payload": _payload(r, block)}, copies


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole records with decoded payloads: continuations joined to their origin, chunked framing removed.

    A group here is one record's segments, so its size is that record's.
    """
    alone, raw = _parts(spark, path, Scratch(spark, "warc-read"), decode=True)
    alone = alone.select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", F.col("block").alias("payload"))
    mended = raw.filter("segment IS NULL").select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", F.array(F.struct(F.lit(1).alias("n"), F.col("block").alias("b"))).alias("parts"), F.lit(None).cast("long").alias("total"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    parts = raw.filter("segment IS NOT NULL").groupBy("origin").agg(*(first(c) for c in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")), F.collect_list(F.struct(F.col("segment").alias("n"), F.col("block").alias("b"))).alias("parts"), F.max("total").alias("total")).drop("origin")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a row holds a record's segments
                row, copies = _assembled(batch.slice(i, 1).to_pylist()[0])
                out += [row] * copies
                held += len(row["payload"]) * copies
                if held > BATCH_BYTES or len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, _ARROW_WHOLE)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, _ARROW_WHOLE)

    return alone.unionByName(mended.unionByName(parts).mapInArrow(assemble, _WHOLE))


_ARROW_WHOLE = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")), ("payload", pa.binary())])


def _bytes_under(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to the shared folder, read the archives back, resolve revisits: a row per record."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = f"{scratch.root}/archive"
    write_warc(pages, path, **options)
    id_of = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS bigint)")
    found = read_warc(spark, path)
    found = found.select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"))
    read = scratch.save(found.repartition(1 + _bytes_under(spark, path) // ARCHIVE_BYTES_PER_FILE), "read")
    responses = read.filter("record_type = 'response'")
    targets = responses.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("target_digest"))
    revisits = read.filter("record_type = 'revisit'").drop("payload_bytes").join(targets, "refers_to", "left")
    known = F.when(F.col("payload_digest") == F.col("target_digest"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit refers to no response of its digest")).cast("long"))
    columns = lambda bytes_, refers: [id_of("record_id").alias("page_id"), bytes_.alias("payload_bytes"), "payload_digest", "record_type", refers.alias("refers_to")]
    return responses.select(*columns(F.col("payload_bytes"), F.lit(None).cast("long"))).unionByName(revisits.select(*columns(known, id_of("refers_to"))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS INTEGER), 5) AS INTEGER)) AS g FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(g, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""
