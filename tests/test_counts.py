import pytest
from conftest import SF

from loomspan.engine import Engine
from loomspan.plans.counts import counted_apart


def plain(spark, sql):
    e = Engine(spark)
    return sorted(map(tuple, spark.sql(e.translate(sql)).collect()), key=repr)


A = "(VALUES (1, 'x'), (1, 'x'), (1, 'y'), (2, 'x'), (NULL, 'z'), (3, NULL)) AS a(k, s)"
B = "(VALUES (1, 10), (1, 10), (2, 20), (NULL, 30), (3, 5)) AS b(k, v)"
C = "(VALUES (10), (10), (20), (30), (5)) AS c(v)"


@pytest.mark.parametrize(
    "sql",
    [
        f"SELECT a.s, count(*) AS n FROM {A} JOIN {B} ON a.k = b.k GROUP BY a.s",
        f"SELECT count(*) AS n, count(1) AS m FROM {A} JOIN {B} ON a.k = b.k AND v > 5",
        f"SELECT count(*) AS n, a.k FROM {A}, {B}, {C} WHERE a.k <=> b.k AND b.v = c.v AND (a.s <> 'y' OR c.v = 10) AND 1 = 1 GROUP BY a.k, a.s",
        f"SELECT b.v, count(*) AS n FROM {A} CROSS JOIN {B} GROUP BY b.v",
        f"SELECT count(*) AS n FROM {A}, {B}",
        f"SELECT count(*) AS n FROM {A} JOIN {B} ON a.k = b.k AND a.k > 99",
        f"SELECT b.v, count(*) AS n FROM {B} CROSS JOIN (SELECT 1 WHERE false) GROUP BY b.v",
        f"SELECT count(*) AS n FROM {B} CROSS JOIN (SELECT 1 WHERE false)",
        f"SELECT a.k, b.k, count(*) AS n FROM {B} JOIN {A} ON a.k < b.k GROUP BY a.k, b.k",
        "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey",
        "SELECT count(*) AS n FROM customer c JOIN supplier s ON c_nationkey = s_nationkey AND c_acctbal > 5000 AND s_acctbal > 100",
    ],
)
def test_counts_by_sides_are_those_of_the_join(spark, sql):
    e = Engine(spark).register_dir(SF)
    assert counted_apart(spark.sql(e.translate(sql))) is not None
    df = e.sql(sql)
    assert sorted(map(tuple, df.collect()), key=repr) == plain(spark, sql)
    assert df.schema == spark.sql(e.translate(sql)).schema


@pytest.mark.parametrize(
    "sql",
    [
        f"SELECT a.s, count(*) AS n FROM {A} LEFT JOIN {B} ON a.k = b.k GROUP BY a.s",
        f"SELECT count(v) AS n FROM {A} JOIN {B} ON a.k = b.k",
        f"SELECT count(*) FILTER (WHERE v > 5) AS n, sum(v) AS s FROM {A} JOIN {B} ON a.k = b.k",
        f"SELECT count(*) AS n FROM {A} JOIN {B} ON a.k = b.k WHERE rand() < 2",
        "SELECT count(*) AS n FROM customer c JOIN supplier s ON c_acctbal < s_acctbal",
        f"SELECT a.s, count(*) AS n FROM {A} JOIN {B} ON a.k = b.k GROUP BY ROLLUP (a.s)",
    ],
)
def test_other_statements_stay(spark, sql):
    e = Engine(spark).register_dir(SF)
    assert counted_apart(spark.sql(e.translate(sql))) is None
    assert sorted(map(tuple, e.sql(sql).collect()), key=repr) == plain(spark, sql)


def test_no_row_for_each_pair(spark):
    """A million pairs of equal keys are counted without being made: no join has more rows than keys."""
    e = Engine(spark)
    df = e.sql("SELECT a.k, count(*) AS n FROM (SELECT id % 2 AS k FROM range(20000)) a JOIN (SELECT id % 2 AS k FROM range(2000)) b ON a.k = b.k GROUP BY a.k")
    assert sorted(map(tuple, df.collect())) == [(0, 10_000_000), (1, 10_000_000)]
    plan = df._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Aggregate") == 3


def test_salted_count_joins_no_pairs(spark, monkeypatch):
    from loomspan.operators import shapes
    from loomspan.plans import frames

    joined = []
    monkeypatch.setattr(frames.shapes, "salted_join", lambda *a, real=shapes.salted_join: joined.append(real(*a)) or joined[-1])
    folder = "/root/testdata/sf0.01"
    pairs = sum(r["n"] for r in frames.salted(spark, folder).collect())
    assert joined[0].count() <= spark.read.parquet(f"{folder}/customer.parquet").count() < pairs
