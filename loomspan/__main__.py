"""Command line: ``python -m loomspan COMMAND``.

sql TEXT, query qN, explain TEXT, tables, repl: over the Parquet tables of ``--dir``;
benchmark: times the 22 TPC-H queries over ``--dir``; generate OUT: writes tables of scale factor ``--sf``;
write-table PATH: the result of ``--sql`` as a version of a snapshot table (``--mode`` create, append or overwrite);
versions PATH; create-index OUT: an index over the vectors of ``--table``.
"""

from __future__ import annotations

import argparse
import csv
import json
import sys
import time
from collections.abc import Iterator
from itertools import islice
from typing import TextIO

from pyspark.sql import DataFrame

from .engine import Engine
from .plans.tpch import TPCH
from .session import build_session
from .sources.generator import generate
from .sources.snapshots import SnapshotTable

#: Rows that a terminal gets in the forms table and vertical; csv and json give all, a row at a time.
SHOWN = 1000


def write(df: DataFrame, form: str, out: TextIO, limit: int = SHOWN) -> None:
    """Rows as table, csv, json or vertical."""
    rows = (r.asDict(recursive=True) for r in df.toLocalIterator())
    if form == "csv":
        w = csv.DictWriter(out, df.columns)
        w.writeheader()
        w.writerows(rows)
    elif form == "json":
        mark = "["
        for r in rows:
            out.write(f"{mark}\n  {json.dumps(r, default=str, ensure_ascii=False)}")
            mark = ","
        out.write("[]\n" if mark == "[" else "\n]\n")
    else:
        first = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        out.write("\n".join((_vertical if form == "vertical" else _table)(df.columns, first[:limit])) + "\n")
        if len(first) > limit:
            out.write(f"(the first {limit} rows; csv and json give all)\n")


def _vertical(columns: list[str], rows: list[dict]) -> Iterator[str]:
    for n, r in enumerate(rows):
        yield f"-RECORD {n}"
        yield from (f"{k} | {v}" for k, v in r.items())


def _table(columns: list[str], rows: list[dict]) -> Iterator[str]:
    cells = [columns, *([("NULL" if r[c] is None else str(r[c])) for c in columns] for r in rows)]
    wide = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    line = "+" + "+".join("-" * (n + 2) for n in wide) + "+"
    body = ("| " + " | ".join(v.ljust(n) for v, n in zip(row, wide)) + " |" for row in cells)
    yield from (line, next(body), line, *body, line)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("loomspan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["sql", "query", "explain", "tables", "repl", "benchmark", "generate", "write-table", "versions", "create-index"])
    p.add_argument("text", nargs="?", default="")
    p.add_argument("--dir", help="folder of Parquet tables")
    p.add_argument("--format", default="table", choices=["table", "csv", "json", "vertical"])
    p.add_argument("--master", default=None)
    p.add_argument("--sf", type=float, default=0.01)
    p.add_argument("--sql", default="")
    p.add_argument("--mode", default="create", choices=["create", "append", "overwrite"])
    p.add_argument("--table", default="embeddings")
    a = p.parse_args(argv)
    engine = Engine(build_session(master=a.master))
    if a.dir:
        engine.register_dir(a.dir, some=True)
    if a.command == "tables":
        print("\n".join(engine.tables()))
    elif a.command == "repl":
        return repl(engine, a.format)
    elif a.command == "generate":
        print("\n".join(generate(engine.spark, a.sf, a.text)))
    elif a.command == "benchmark":
        for name, seconds in benchmark(engine):
            print(f"{name}\t{seconds:.3f}")
    elif a.command == "write-table":
        print(SnapshotTable(engine.spark, a.text).write(engine.sql(a.sql), a.mode))
    elif a.command == "versions":
        for h in SnapshotTable(engine.spark, a.text).history():
            print(json.dumps(h, default=str))
    elif a.command == "create-index":
        print(f"nprobe {engine.create_index(a.table, a.text).nprobe}")
    else:
        sql = TPCH[a.text][0] if a.command == "query" else a.text
        if a.command == "explain":
            engine.explain(sql)
        else:
            write(engine.sql(sql), a.format, sys.stdout)
    return 0


def benchmark(engine: Engine) -> Iterator[tuple[str, float]]:
    """Seconds of each query, results counted on the executors."""
    for name, (sql, _) in TPCH.items():
        began = time.perf_counter()
        engine.sql(sql).write.format("noop").mode("overwrite").save()
        yield name, time.perf_counter() - began


def repl(engine: Engine, form: str, lines: TextIO | None = None) -> int:
    """Statements end with ``;``. Commands: .quit .tables .schema T .load NAME PATH .snapshot NAME PATH [VERSION]
    .versions PATH .mode FORMAT .tpch N .analyze NAME PATH .help"""
    held = ""
    for line in lines or sys.stdin:
        word = line.split()
        try:
            if not held and word and word[0].startswith("."):
                if word[0] == ".quit":
                    break
                form = _command(engine, word, form)
                continue
            held += line
            if held.rstrip().endswith(";"):
                began, sql, held = time.time(), held, ""
                write(engine.sql(sql), form, sys.stdout)
                print(f"{time.time() - began:.3f} s")
        except Exception as e:
            print(f"error: {e}")
    return 0


def _command(engine: Engine, word: list[str], form: str) -> str:
    """Carry out a dot-command; the output format from now on."""
    name, given = word[0], word[1:]
    if name == ".tables":
        print("\n".join(engine.tables()))
    elif name == ".schema" and given:
        print(engine.spark.table(given[0]).schema.simpleString())
    elif name == ".load" and len(given) > 1:
        engine.register_parquet(given[0], given[1])
    elif name == ".snapshot" and len(given) > 1:
        engine.register(given[0], SnapshotTable(engine.spark, given[1]).read(*map(int, given[2:3])))
    elif name == ".versions" and given:
        print(*SnapshotTable(engine.spark, given[0]).versions())
    elif name == ".analyze" and len(given) > 1:
        engine.analyze(*given[:2])
    elif name in (".mode", ".format") and given:
        return given[0]
    elif name == ".tpch" and given:
        write(engine.sql(TPCH[f"q{given[0]}"][0]), form, sys.stdout)
    else:
        print(repl.__doc__)
    return form


if __name__ == "__main__":
    sys.exit(main())
