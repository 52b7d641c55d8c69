"""Versioned tables on plain Parquet: one folder per version, a manifest per version, time travel, write modes.

A version's manifest lists the data folders it consists of, so an append adds a folder and rewrites nothing. A manifest
is written last and under a temporary name; what has no manifest does not exist.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self._conf), p

    def _read(self, name: str) -> dict:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        fs, p = self._at("_versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def history(self) -> list[dict]:
        return [self._read(f"_versions/{v}.json") for v in self.versions()]

    def read(self, version: int | None = None, as_of: float | None = None) -> DataFrame:
        """The latest version, a given one, or the last one written at or before ``as_of`` (seconds since 1970)."""
        known = self.versions()
        if as_of is not None:
            known = [v for v in known if self._read(f"_versions/{v}.json")["time"] <= as_of]
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no version {version if version is not None else ''}".rstrip())
        entry = self._read(f"_versions/{version if version is not None else known[-1]}.json")
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in entry["folders"]))

    def write(self, df: DataFrame, mode: str = "create") -> int:
        """``create`` (the table must not exist), ``append`` or ``overwrite``; returns the new version."""
        known = self.versions()
        if mode not in ("create", "append", "overwrite"):
            raise ValueError(f"unknown write mode {mode}")
        if mode == "create" and known:
            raise FileExistsError(self.path)
        kept = self._read(f"_versions/{known[-1]}.json")["folders"] if mode == "append" and known else []
        if kept and self.read().schema.simpleString() != df.schema.simpleString():
            raise ValueError("an append must have the table's columns")
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        version = known[-1] + 1 if known else 1
        entry = {"version": version, "time": time.time(), "mode": mode, "folders": [*kept, folder]}
        fs, temporary = self._at(f"_versions/.{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(json.dumps(entry).encode())
        out.close()
        _, final = self._at(f"_versions/{version}.json")
        if not fs.rename(temporary, final):
            raise RuntimeError(f"version {version} was written by someone else")
        return version

    def create_from_parquet(self, path: str) -> int:
        return self.write(self.spark.read.parquet(path), "create")

    def create_as_select(self, engine, sql: str) -> int:
        return self.write(engine.sql(sql), "create")
