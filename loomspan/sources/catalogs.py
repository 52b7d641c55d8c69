"""Registering the tables of REST catalogs: a metalake of schemas and tables, or databases by branch."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from .iceberg import read_iceberg
from .snapshots import SnapshotTable

#: Type names of metastores as Spark's; others are strings.
TYPES = {"boolean": "boolean", "tinyint": "tinyint", "byte": "tinyint", "smallint": "smallint", "short": "smallint", "int": "int", "integer": "int", "bigint": "bigint", "long": "bigint", "float": "float", "real": "float", "double": "double", "date": "date", "timestamp": "timestamp", "binary": "binary", "string": "string", "varchar": "string", "char": "string"}


def spark_type(name: str) -> str:
    base = name.lower().split("(")[0].strip()
    return name.lower() if base == "decimal" else TYPES.get(base, "string")


def http_json(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
        return json.loads(r.read())


def open_table(spark: SparkSession, location: str, kind: str) -> DataFrame:
    """A table by format: parquet, iceberg, or snapshot (versioned Parquet)."""
    if kind == "iceberg":
        return read_iceberg(spark, location)
    if kind in ("snapshot", "versioned"):
        return SnapshotTable(spark, location).read()
    if kind in ("", "parquet"):
        return spark.read.parquet(location)
    raise NotImplementedError(f"{kind} tables are not read")


class MetalakeCatalog:
    """Relational and fileset catalogs of a metalake."""

    def __init__(self, base: str, metalake: str, catalog: str, get: Callable[[str], dict] = http_json):
        self.root = f"{base.rstrip('/')}/api/metalakes/{quote(metalake)}/catalogs/{quote(catalog)}"
        self.get = get

    def schemas(self) -> list[str]:
        return [i["name"] for i in self.get(f"{self.root}/schemas")["identifiers"]]

    def entries(self, schema: str) -> list[tuple[str, str, str]]:
        """(name, location, format)."""
        out = []
        for what, one in (("tables", "table"), ("filesets", "fileset")):
            for i in self.get(f"{self.root}/schemas/{quote(schema)}/{what}").get("identifiers", []):
                found = self.get(f"{self.root}/schemas/{quote(schema)}/{what}/{quote(i['name'])}")[one]
                properties = found.get("properties", {})
                out.append((i["name"], found.get("storageLocation") or properties.get("location", ""), (properties.get("format") or properties.get("provider") or "parquet").lower()))
        return out

    def register_all(self, engine: Engine) -> list[str]:
        names = []
        for schema in self.schemas():
            for name, location, kind in self.entries(schema):
                engine.register(name, open_table(engine.spark, location, kind))
                names.append(name)
        return names


class BranchCatalog:
    """Databases and tables as one branch of a branching metastore sees them."""

    def __init__(self, base: str, branch: str = "main", get: Callable[[str], dict] = http_json):
        self.root, self.get = f"{base.rstrip('/')}/api/v1/branches/{quote(branch)}", get

    def tables(self, database: str) -> list[dict]:
        return self.get(f"{self.root}/databases/{quote(database)}/tables")["tables"]

    def schema_of(self, table: dict) -> str:
        return ", ".join(f"`{c['name']}` {spark_type(c['type'])}" for c in table["columns"])

    def register_all(self, engine: Engine, database: str) -> list[str]:
        for t in self.tables(database):
            engine.register(t["name"], open_table(engine.spark, t["location"], t.get("format", "parquet").lower()))
        return [t["name"] for t in self.tables(database)]
