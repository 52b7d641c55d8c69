import pytest
from conftest import SF

from loomspan.engine import Engine
from loomspan.plans.percentile import SMALL, exact_percentiles


def least_at_rank(values, p):
    values = sorted(v for v in values if v is not None)
    return float(values[max(-(-int(round(p * 1000)) * len(values) // 1000), 1) - 1]) if values else None


@pytest.mark.parametrize("p", ["0", "0.001", "0.25", "0.5", "0.999", "1"])
def test_large_and_small_groups_are_exact(spark, p):
    # Group 0: 300,000 distinct values; 1: six values, one in half of its rows; 2: small; 3: all NULL; NULL: a group as well.
    rows = "SELECT CASE WHEN id < 900000 THEN id % 3 WHEN id < 900010 THEN 3 END AS g, CASE WHEN id % 3 = 0 AND id < 900000 THEN (id * 7919) % 899981 WHEN id % 3 = 1 AND id < 900000 THEN greatest(id % 10, 5) WHEN id < 900000 OR id >= 900010 THEN id - 800000 END AS x FROM range(900300) WHERE id % 3 <> 2 OR id > 890000"
    e = Engine(spark)
    want = {}
    for g, x in e.sql(rows).collect():
        want.setdefault(g, []).append(x)
    assert len(want[0]) > SMALL > len(want[2]) and set(want[3]) == {None} and None in want
    df = e.sql(f"WITH t AS ({rows}) SELECT g, approx_percentile(x, {p}) AS q, count(*) AS n FROM t GROUP BY g")
    assert {r["g"]: (r["q"], r["n"]) for r in df.collect()} == {g: (least_at_rank(xs, float(p)), len(xs)) for g, xs in want.items()}


def test_without_groups_with_having_and_several_calls(spark):
    e = Engine(spark).register_dir(SF)
    assert e.sql("SELECT approx_percentile(id) AS m, approx_percentile(-id, 0.1) AS d FROM range(1000001)").collect() == [(500000.0, -900000.0)]
    assert e.sql("SELECT approx_percentile(id, 0.5) AS m, count(*) AS n FROM range(0)").collect() == [(None, 0)]
    got = e.sql("SELECT o.o_orderstatus, approx_percentile(o.o_orderkey, 0.5) AS m FROM orders o, customer c WHERE o_custkey = c_custkey OR o_custkey < 0 GROUP BY o.o_orderstatus HAVING count(*) > 10").collect()
    assert got and all(r["m"] > 0 for r in got)


def test_other_statements_keep_to_the_sketch(spark):
    e = Engine(spark).register_dir(SF)
    for sql in (
        "SELECT approx_percentile(n_nationkey, 0.5) + 1 AS m FROM nation",
        "SELECT approx_percentile(n_nationkey, 0.5) FROM nation",
        "SELECT n_regionkey, approx_percentile(n_nationkey, 0.5) AS m FROM nation GROUP BY 1",
        "SELECT approx_percentile(k, 0.5) AS m FROM (SELECT n_nationkey AS k FROM nation LIMIT 7)",
        "SELECT n_regionkey, approx_percentile(n_nationkey, 0.5) AS m FROM nation GROUP BY ROLLUP (n_regionkey)",
    ):
        assert exact_percentiles(sql) == sql and e.sql(sql).count() > 0
    correlated = "SELECT r_name, (SELECT approx_percentile(n_nationkey, 0.5) AS m FROM nation WHERE n_regionkey = r_regionkey) AS m FROM region"
    assert exact_percentiles(correlated) != correlated and e.sql(correlated).count() == 5


def test_percentile_sketch_is_not_kept_for_each_distinct_value(spark):
    e = Engine(spark).register_dir(SF)
    plan = e.sql("SELECT l_returnflag, approx_distinct(l_suppkey) AS a, approx_percentile(l_orderkey, 0.5) AS p FROM lineitem GROUP BY l_returnflag")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "percentile_approx" in line and "distinct" in line]
