import io
import json
import os
import struct

import pytest
from conftest import SF

from loomspan.__main__ import main, repl, write
from loomspan.engine import Engine
from loomspan.operators import shapes
from loomspan.operators.vector import IvfIndex, knn, knn_all
from loomspan.sources.catalogs import BranchCatalog, MetalakeCatalog, spark_type
from loomspan.sources.iceberg import avro_records, data_files, read_iceberg
from loomspan.sources.snapshots import SnapshotTable
from loomspan.sources.topics import read_topic
from loomspan.streaming import events


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.versions() == []
    with pytest.raises(ValueError):
        t.read()
    df = spark.range(5)
    assert t.write(df) == 1
    with pytest.raises(FileExistsError):
        t.write(df)
    assert t.write(spark.range(5, 8), "append") == 2
    assert t.write(spark.range(1), "overwrite") == 3
    assert [t.read(v).count() for v in t.versions()] == [5, 8, 1]
    assert t.read(as_of=t.history()[1]["time"]).count() == 8
    with pytest.raises(ValueError):
        t.write(spark.range(1).selectExpr("id AS other"), "append")
    with pytest.raises(ValueError):
        t.read(9)


def zigzag(n):
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def text(s):
    s = s if isinstance(s, bytes) else s.encode()
    return zigzag(len(s)) + s


def avro(schema, rows):
    sync = b"0123456789abcdef"
    head = b"Obj\x01" + zigzag(2) + text("avro.schema") + text(json.dumps(schema)) + text("avro.codec") + text("null") + zigzag(0) + sync
    body = b"".join(rows)
    return head + zigzag(len(rows)) + zigzag(len(body)) + body + sync


def iceberg_table(spark, root, kind="PARQUET", content=0):
    spark.range(7).coalesce(1).write.parquet(f"{root}/data")
    file = next(f"{root}/data/{f}" for f in os.listdir(f"{root}/data") if f.endswith(".parquet"))
    os.makedirs(f"{root}/metadata")
    entry = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "ratio", "type": ["null", "double"]}]}}]}
    one = lambda status: zigzag(status) + zigzag(content) + text(file) + text(kind) + zigzag(1) + struct.pack("<d", 0.5)
    with open(f"{root}/metadata/m.avro", "wb") as f:
        f.write(avro(entry, [one(1), one(2)]))
    listed = {"type": "record", "name": "file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}
    with open(f"{root}/metadata/l.avro", "wb") as f:
        f.write(avro(listed, [text(f"{root}/metadata/m.avro") + zigzag(0)]))
    meta = {"format-version": 2, "location": root, "current-snapshot-id": 5, "snapshots": [{"snapshot-id": 5, "manifest-list": f"{root}/metadata/l.avro"}]}
    with open(f"{root}/metadata/v1.metadata.json", "w") as f:
        json.dump(meta, f)


def test_iceberg(spark, tmp_path):
    iceberg_table(spark, str(tmp_path / "a"))
    assert read_iceberg(spark, str(tmp_path / "a")).count() == 7
    with pytest.raises(ValueError):
        read_iceberg(spark, str(tmp_path / "a"), 6)
    iceberg_table(spark, str(tmp_path / "b"), kind="ORC")
    with pytest.raises(NotImplementedError):
        read_iceberg(spark, str(tmp_path / "b"))
    iceberg_table(spark, str(tmp_path / "c"), content=1)
    with pytest.raises(NotImplementedError):
        read_iceberg(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        list(avro_records(b"nope"))


def test_catalogs(spark):
    at = f"{SF}/nation.parquet"
    answers = {"schemas": {"identifiers": [{"name": "s"}]}, "schemas/s/tables": {"identifiers": [{"name": "nation_t"}]}, "schemas/s/tables/nation_t": {"table": {"properties": {"location": at}}}, "schemas/s/filesets": {"identifiers": [{"name": "nation_f"}]}, "schemas/s/filesets/nation_f": {"fileset": {"storageLocation": at}}}
    engine = Engine(spark)
    found = MetalakeCatalog("http://h", "m", "c", get=lambda u: answers[u.split("/catalogs/c/")[1]]).register_all(engine)
    assert found == ["nation_t", "nation_f"]
    assert engine.sql("SELECT count(*) AS n FROM nation_f").first()["n"] == 25
    listing = {"tables": [{"name": "n2", "location": at, "format": "PARQUET", "columns": [{"name": "a", "type": "BIGINT"}, {"name": "b", "type": "geometry"}]}]}
    branch = BranchCatalog("http://h", "dev", get=lambda u: listing)
    assert branch.register_all(engine, "db") == ["n2"]
    assert branch.schema_of(listing["tables"][0]) == "`a` bigint, `b` string"
    assert spark_type("decimal(10,2)") == "decimal(10,2)"
    with pytest.raises(NotImplementedError):
        read_topic(spark, "pulsar://h", "t", "a int")


def test_ivf_recall(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = IvfIndex(df, cells=8, metric="cosine").save(str(tmp_path / "ivf"))
    hits = total = 0
    for r in df.filter("vec_id % 50 = 0").collect():
        exact = {x["vec_id"] for x in knn(df, r["embedding"], 10, metric="cosine").collect()}
        got = {x["vec_id"] for x in index.search(r["embedding"], 10, nprobe=5).collect()}
        hits, total = hits + len(exact & got), total + 10
    assert hits / total >= 0.8
    with pytest.raises(Exception, match="dimension"):
        knn(df, [1.0, 2.0]).collect()


def test_batch_search_ties_and_blocks(spark, monkeypatch):
    from loomspan.operators import vector

    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in knn_all(df, df.filter("vec_id < 5 OR vec_id = 99"), 6).collect():
        got.setdefault(r["query_id"], []).append((r["place"], r["id"]))
    want = {q: list(enumerate([i for _, i in sorted((abs(i % 5 - q), i) for i in range(40))][:6], 1)) for q in range(5)}
    assert {q: sorted(v) for q, v in got.items()} == want
    index = IvfIndex(df, cells=3)
    assert sorted(map(tuple, index.search_all(df.filter("vec_id < 5"), 6, nprobe=3).select("query_id", "id").collect())) == sorted((q, i) for q, v in want.items() for _, i in v)
    assert knn_all(df, df.filter("false")).count() == 0


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), pattern="*.parquet")
    assert events.run_once(events.tumbling(stream), "t1").selectExpr("sum(n)", "count(1)").first() == events.tumbling(e).selectExpr("sum(n)", "count(1)").first()
    assert events.run_once(events.distinct_events(stream), "t2", "append").count() == e.select("event_id").distinct().count()


def render(df, form, limit=1000):
    out = io.StringIO()
    write(df, form, out, limit)
    return out.getvalue()


def test_command_line_formats(spark):
    df = Engine(spark).sql("SELECT 1 AS a, NULL AS b")
    assert "NULL" in render(df, "table") and render(df, "csv").startswith("a,b")
    assert json.loads(render(df, "json")) == [{"a": 1, "b": None}] and json.loads(render(df.limit(0), "json")) == []
    assert "a | 1" in render(df, "vertical")
    many = spark.range(1500)
    assert render(many, "csv").count("\n") == 1501 and len(json.loads(render(many, "json"))) == 1500
    assert "first 3 rows" in render(many, "table", 3) and "rows;" not in render(many.limit(3), "table", 3)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("loomspan.__main__.build_session", lambda **_: spark)
    out = str(tmp_path / "g")
    assert main(["generate", out, "--sf", "0.001"]) == 0
    assert spark.read.parquet(f"{out}/lineitem.parquet").count() == 6000
    wanted = spark.read.parquet(f"{SF}/orders.parquet").dtypes
    assert [(n, t.replace("_ntz", "")) for n, t in spark.read.parquet(f"{out}/orders.parquet").dtypes] == [(n, t.replace("_ntz", "")) for n, t in wanted]
    assert main(["query", "q1", "--dir", out, "--format", "csv"]) == 0
    assert "l_returnflag" in capsys.readouterr().out
    main(["write-table", str(tmp_path / "s"), "--dir", SF, "--sql", "SELECT * FROM nation"])
    main(["versions", str(tmp_path / "s")])
    assert '"version": 1' in capsys.readouterr().out
    repl(Engine(spark), "csv", io.StringIO(f".snapshot n {tmp_path}/s\n.versions {tmp_path}/s\nSELECT count(*) AS c\nFROM n;\nSELECT nope;\n.nope\n.quit\n"))
    said = capsys.readouterr().out
    assert "25" in said and "error:" in said and "Commands:" in said
    Engine(spark).register_dir(SF, refresh=True)


def evolved_table(root, spark):
    """Two files of an Iceberg table whose columns were renamed and added between them, with column bounds."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(f"{root}/metadata"), os.makedirs(f"{root}/data")
    field = lambda name, kind, i: pa.field(name, kind, metadata={"PARQUET:field_id": str(i)})
    pq.write_table(pa.table([[1, 2], ["x", "y"]], pa.schema([field("old_name", pa.int64(), 1), field("s", pa.string(), 2)])), f"{root}/data/a.parquet")
    pq.write_table(pa.table([[5, 9], ["z", None], [0.5, 1.5]], pa.schema([field("k", pa.int64(), 1), field("s", pa.string(), 2), field("d", pa.float64(), 3)])), f"{root}/data/b.parquet")
    pair = {"type": "array", "items": {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}
    of = {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "lower_bounds", "type": pair}, {"name": "upper_bounds", "type": {"type": "array", "items": "kv"}}]}
    entry = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": of}]}
    bound = lambda v: zigzag(1) + zigzag(1) + text(struct.pack("<q", v)) + zigzag(0)
    rows = [zigzag(1) + zigzag(0) + text(f"{root}/data/{f}.parquet") + text("PARQUET") + bound(a) + bound(b) for f, a, b in (("a", 1, 2), ("b", 5, 9))]
    with open(f"{root}/metadata/m.avro", "wb") as f:
        f.write(avro(entry, rows))
    listed = {"type": "record", "name": "file", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}
    with open(f"{root}/metadata/l.avro", "wb") as f:
        f.write(avro(listed, [text(f"{root}/metadata/m.avro") + zigzag(0)]))
    columns = [{"id": 1, "name": "k", "type": "long"}, {"id": 2, "name": "label", "type": "string"}, {"id": 3, "name": "d", "type": "double"}]
    meta = {"format-version": 2, "location": root, "current-snapshot-id": 5, "current-schema-id": 1, "schemas": [{"schema-id": 1, "type": "struct", "fields": columns}], "snapshots": [{"snapshot-id": 5, "schema-id": 1, "manifest-list": f"{root}/metadata/l.avro"}]}
    with open(f"{root}/metadata/v1.metadata.json", "w") as f:
        json.dump(meta, f)


def test_iceberg_evolution_and_pruning(spark, tmp_path):
    root = str(tmp_path / "t")
    evolved_table(root, spark)
    everything = [(1, "x", None), (2, "y", None), (5, "z", 0.5), (9, None, 1.5)]
    assert sorted(map(tuple, read_iceberg(spark, root).collect())) == everything
    for where, files in (([("k", ">", 2)], 1), ([("k", "=", 2)], 1), ([("k", "<=", 5), ("k", ">=", 2)], 2), ([("k", "<", 1)], 0), ([("label", "=", "z")], 2)):
        assert len(data_files(spark, root, where=where)) == files
        ops = {"=": "=="}
        keep = [r for r in everything if all(v is not None and eval(f"v {ops.get(op, op)} w") for c, op, w in where for v in [r[("k", "label").index(c)]])]
        assert sorted(map(tuple, read_iceberg(spark, root, where=where).collect())) == keep


def test_statistics(spark, tmp_path):
    engine = Engine(spark)
    spark.range(1000).selectExpr("id", "id % 7 AS g").write.parquet(str(tmp_path / "p"))
    engine.analyze("analysed_table", str(tmp_path / "p"))
    stats = spark.table("analysed_table")._jdf.queryExecution().optimizedPlan().stats()
    assert stats.rowCount().get() == 1000 and stats.attributeStats().size() == 2
    spark.sql("DROP TABLE analysed_table")
    for setting in ("enabled", "joinReorder.enabled", "planStats.enabled"):
        spark.conf.unset(f"spark.sql.cbo.{setting}")


def test_salted_join_of_equal_rows(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 1 ELSE id END AS k", "'same' AS v")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2500, "c")], "k long, w string")
    got = shapes.salted_join(left, right, "k")
    assert got.groupBy("k").count().orderBy("k").collect() == [(1, 4000), (2500, 1)]


def test_plans_push_down(spark):
    """Filters and columns reach the scan; a top-k is no full sort; a reused subplan is read once."""
    q = Engine(spark).register_dir(SF, {"lineitem"}).sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 ORDER BY l_extendedprice DESC LIMIT 5")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "TakeOrderedAndProject" in plan and "l_comment" not in plan and "l_tax" not in plan
