"""Star-schema tables of any size from row numbers alone: every value is a hash of its row's number and its column.

Rows are made on the executors, so a table of any scale factor is written in parallel, and the same factor gives the
same rows whatever the number of tasks. Scale factor 1 has 6,000,000 lines and 1,500,000 orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the tables' categories.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
ADJECTIVES, NOUNS = ("big", "blue", "bright", "cold", "green", "hot", "old", "red", "small"), ("anvil", "bolt", "gadget", "gear", "ring", "spring", "valve", "widget")

#: Rows at scale factor 1.
ROWS = {"customer": 150_000, "supplier": 10_000, "part": 200_000, "orders": 1_500_000, "lineitem": 6_000_000}
_DAYS = 2555


def _below(n: int, column: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(column)), F.lit(n))


def _one_of(names: tuple[str, ...], column: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (_below(len(names), column) + 1).cast("int"))


def _cents(low: int, high: int, column: str) -> Column:
    return ((_below(high - low + 1, column) + low) / 100).cast("double")


def _day(column: str) -> Column:
    return F.timestamp_add("DAY", _below(_DAYS, column).cast("int"), F.lit("1995-01-01").cast("timestamp_ntz"))


def _padded(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 9, "0"))


def table(spark: SparkSession, name: str, sf: float) -> DataFrame:
    """One table at scale factor ``sf``."""
    n = {k: max(1, round(v * sf)) for k, v in ROWS.items()}
    rows = spark.range({"region": 5, "nation": 25}.get(name) or n[name])
    key = F.col("id")
    columns = {
        "region": lambda: {"r_regionkey": key.cast("int"), "r_name": F.element_at(F.array(*map(F.lit, REGIONS)), (key + 1).cast("int"))},
        "nation": lambda: {"n_nationkey": key.cast("int"), "n_name": F.concat(F.lit("NATION_"), key.cast("string")), "n_regionkey": (key % 5).cast("int")},
        "customer": lambda: {"c_custkey": key, "c_name": _padded("Customer#"), "c_nationkey": _below(25, "nation").cast("int"), "c_acctbal": _cents(-99_999, 999_999, "balance"), "c_mktsegment": _one_of(SEGMENTS, "segment")},
        "supplier": lambda: {"s_suppkey": key, "s_name": _padded("Supplier#"), "s_nationkey": _below(25, "nation").cast("int"), "s_acctbal": _cents(-99_999, 999_999, "balance")},
        "part": lambda: {"p_partkey": key, "p_name": F.concat(_one_of(ADJECTIVES, "adjective"), F.lit(" "), _one_of(NOUNS, "noun")), "p_brand": F.concat(F.lit("Brand#"), (_below(25, "brand") + 1).cast("string")), "p_type": _one_of(TYPES, "type"), "p_size": (_below(50, "size") + 1).cast("int"), "p_retailprice": (F.lit(900.0) + (key % 1000) / 10)},
        "orders": lambda: {"o_orderkey": key, "o_custkey": _below(n["customer"], "customer"), "o_orderstatus": _one_of(("F", "O", "P"), "status"), "o_totalprice": _cents(100_000, 40_000_000, "price"), "o_orderdate": _day("date"), "o_orderpriority": _one_of(PRIORITIES, "priority")},
        "lineitem": lambda: {"l_orderkey": _below(n["orders"], "order"), "l_partkey": _below(n["part"], "part"), "l_suppkey": _below(n["supplier"], "supplier"), "l_linenumber": (_below(7, "line") + 1).cast("int"), "l_quantity": (_below(50, "quantity") + 1).cast("double"), "l_extendedprice": _cents(100_000, 10_000_000, "price"), "l_discount": _cents(0, 10, "discount"), "l_tax": _cents(0, 8, "tax"), "l_returnflag": _one_of(("A", "N", "R"), "flag"), "l_linestatus": _one_of(("F", "O"), "status"), "l_shipdate": _day("date")},
    }[name]()
    return rows.select(*(c.alias(k) for k, c in columns.items()))


def generate(spark: SparkSession, sf: float, folder: str) -> list[str]:
    """Write all tables under ``folder`` as Parquet; their names."""
    names = ["region", "nation", *ROWS]
    for name in names:
        table(spark, name, sf).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return names
