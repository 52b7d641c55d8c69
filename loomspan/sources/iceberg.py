"""Iceberg tables without an Iceberg library: metadata JSON, Avro manifests, then Spark's own Parquet reader.

Format versions 1 and 2, current or given snapshot, columns by field id, files pruned by column bounds. Refused by name:
delete files, data that is not Parquet, tables without a snapshot.
"""

from __future__ import annotations

import datetime
import json
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Avro:
    """A reader of Avro object container files (null and deflate)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def long(self) -> int:
        shift = n = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind, names: dict):
        if isinstance(kind, str) and kind in names:
            kind = names[kind]
        if isinstance(kind, list):
            return self.value(kind[self.long()], names)
        name = kind["type"] if isinstance(kind, dict) else kind
        if isinstance(name, (dict, list)):
            return self.value(name, names)
        if isinstance(kind, dict) and "name" in kind:
            names[kind["name"]] = kind
        if name == "null":
            return None
        if name == "boolean":
            return self.take(1) == b"\1"
        if name in ("int", "long"):
            return self.long()
        if name == "float":
            return struct.unpack("<f", self.take(4))[0]
        if name == "double":
            return struct.unpack("<d", self.take(8))[0]
        if name in ("bytes", "string"):
            raw = self.take(self.long())
            return raw.decode() if name == "string" else raw
        if name == "fixed":
            return self.take(kind["size"])
        if name == "enum":
            return kind["symbols"][self.long()]
        if name == "record":
            return {f["name"]: self.value(f["type"], names) for f in kind["fields"]}
        if name in ("array", "map"):
            out: list = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                for _ in range(n):
                    out.append(self.value(kind["items"], names) if name == "array" else (self.value("string", names), self.value(kind["values"], names)))
            return out if name == "array" else dict(out)
        raise ValueError(f"Avro type {name}")


def avro_records(data: bytes) -> Iterator[dict]:
    if data[:4] != b"Obj\x01":
        raise ValueError("not an Avro file")
    r = _Avro(data)
    r.at = 4
    meta = r.value({"type": "map", "values": "bytes"}, {})
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null")
    sync = r.take(16)
    while r.at < len(data):
        count, size = r.long(), r.long()
        block = r.take(size)
        if codec == b"deflate":
            block = zlib.decompress(block, -15)
        elif codec != b"null":
            raise ValueError(f"Avro codec {codec.decode()}")
        if r.take(16) != sync:
            raise ValueError("Avro sync marker is wrong")
        b, names = _Avro(block), {}
        for _ in range(count):
            yield b.value(schema, names)


def _bytes(spark: SparkSession, path: str) -> bytes:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _latest_metadata(spark: SparkSession, table: str) -> str:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{table}/metadata")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [n for n in names if n.endswith(".metadata.json")]
    if not found:
        raise ValueError(f"{table} has no metadata")
    number = lambda n: int("".join(c for c in n.split("-")[0].split(".")[0] if c.isdigit()) or 0)
    return f"{table}/metadata/{max(found, key=lambda n: (number(n), n))}"


def _spark_type(kind) -> T.DataType:
    """The Spark type of an Iceberg type; struct fields carry their ids, by which Spark's Parquet reader finds columns."""
    if isinstance(kind, dict):
        if kind["type"] == "struct":
            return T.StructType([T.StructField(f["name"], _spark_type(f["type"]), not f.get("required"), {"parquet.field.id": f["id"]}) for f in kind["fields"]])
        if kind["type"] == "list":
            return T.ArrayType(_spark_type(kind["element"]), not kind.get("element-required"))
        return T.MapType(_spark_type(kind["key"]), _spark_type(kind["value"]), not kind.get("value-required"))
    if m := re.fullmatch(r"decimal\((\d+), *(\d+)\)", kind):
        return T.DecimalType(int(m[1]), int(m[2]))
    if kind.startswith("fixed"):
        return T.BinaryType()
    if kind not in _TYPES:
        raise NotImplementedError(f"Iceberg type {kind} is not read")
    return _TYPES[kind]


#: Iceberg's primitive types.
_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "binary": T.BinaryType()}
_EPOCH = datetime.date(1970, 1, 1)


def _bound(kind, raw: bytes):
    """A column bound as a value that compares, or None."""
    if kind == "string":
        return raw.decode("utf-8", "replace")
    if kind == "boolean":
        return raw != b"\0"
    form = {"int": "<i", "date": "<i", "long": "<q", "timestamp": "<q", "timestamptz": "<q", "float": "<f", "double": "<d"}.get(kind) if isinstance(kind, str) else None
    return struct.unpack(form, raw)[0] if form and len(raw) == struct.calcsize(form) else None


def _comparable(kind: str, value):
    if kind == "date" and isinstance(value, datetime.date):
        return (value - _EPOCH).days
    if kind in ("timestamp", "timestamptz") and isinstance(value, datetime.datetime):
        zone = datetime.timezone.utc
        return (value.replace(tzinfo=value.tzinfo or zone) - datetime.datetime(1970, 1, 1, tzinfo=zone)) // datetime.timedelta(microseconds=1)
    return value


def _may_hold(file: dict, fields: dict[str, dict], where: Conditions) -> bool:
    """False if a file's column bounds rule out every row that ``where`` wants."""
    low, high = ({e["key"]: e["value"] for e in file.get(b) or []} if isinstance(file.get(b) or [], list) else dict(file[b]) for b in ("lower_bounds", "upper_bounds"))
    for name, op, value in where:
        f = fields[name]
        a, b = (_bound(f["type"], side[f["id"]]) if f["id"] in side else None for side in (low, high))
        v = _comparable(f["type"], value)
        if a is not None and (op in ("=", "<=") and a > v or op == "<" and a >= v) or b is not None and (op in ("=", ">=") and b < v or op == ">" and b <= v):
            return False
    return True


#: (column, one of = < <= > >=, value), all of which must hold.
Conditions = Sequence[tuple[str, str, object]]


def _snapshot(spark: SparkSession, table: str, snapshot_id: int | None) -> tuple[dict, dict]:
    meta = json.loads(_bytes(spark, _latest_metadata(spark, table.rstrip("/"))))
    wanted = snapshot_id if snapshot_id is not None else meta.get("current-snapshot-id", -1)
    found = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == wanted), None)
    if found is None:
        raise ValueError(f"{table} has no snapshot {wanted}")
    return meta, found


def _schema(meta: dict, snapshot: dict) -> dict | None:
    """The schema that a snapshot is read with: its own, or the table's current one."""
    wanted = snapshot.get("schema-id", meta.get("current-schema-id"))
    return next((s for s in meta.get("schemas", []) if s.get("schema-id") == wanted), meta.get("schema"))


def data_files(spark: SparkSession, table: str, snapshot_id: int | None = None, where: Conditions = ()) -> list[str]:
    """The Parquet files of a snapshot, without those whose column bounds rule out ``where``. The list is as long as the
    table has files, as in any catalog."""
    meta, snapshot = _snapshot(spark, table, snapshot_id)
    fields = {f["name"]: f for f in (_schema(meta, snapshot) or {"fields": []})["fields"]}
    moved = lambda p: p.replace(meta["location"].rstrip("/"), table.rstrip("/"), 1) if p.startswith(meta["location"].rstrip("/")) else p
    manifests = snapshot.get("manifests", [])
    if "manifest-list" in snapshot:
        listed = list(avro_records(_bytes(spark, moved(snapshot["manifest-list"]))))
        if any(m.get("content") for m in listed):
            raise NotImplementedError("delete files are not read")
        manifests = [m["manifest_path"] for m in listed]
    files = []
    for manifest in manifests:
        for entry in avro_records(_bytes(spark, moved(manifest))):
            if entry["status"] == 2:  # deleted
                continue
            f = entry["data_file"]
            if f.get("content"):
                raise NotImplementedError("delete files are not read")
            if f["file_format"].upper() != "PARQUET":
                raise NotImplementedError(f"{f['file_format']} data is not read")
            if _may_hold(f, fields, where):
                files.append(moved(f["file_path"]))
    if not files and not where:
        raise ValueError(f"snapshot {snapshot['snapshot-id']} of {table} holds no data files")
    return files


def read_iceberg(spark: SparkSession, table: str, snapshot_id: int | None = None, where: Conditions = ()) -> DataFrame:
    """A snapshot's rows that satisfy ``where``. Columns are found by field id, so renamed and added ones read as the
    schema has them; reading by id is switched on in the session."""
    files = data_files(spark, table, snapshot_id, where)
    schema = _schema(*_snapshot(spark, table, snapshot_id))
    if schema is None:  # metadata without a schema: what the files say
        df = spark.read.parquet(*files)
    else:
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        kinds = _spark_type({"type": "struct", "fields": schema["fields"]})
        df = spark.read.schema(kinds).parquet(*files) if files else spark.createDataFrame([], kinds)
    compare = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    for name, op, value in where:
        df = df.filter(getattr(F.col(name), compare[op])(F.lit(value)))
    return df
