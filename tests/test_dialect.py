import pytest

from loomspan.engine import Engine
from loomspan.plans.dialect import translate


def one(spark, expression):
    return Engine(spark).sql(f"SELECT {expression} AS x").first()["x"]


def test_text_inside_strings_and_comments_stays():
    sql = "SELECT 'concat(a, b) ORDER BY x' AS s -- concat(a)\n FROM t /* cast(x AS y) */"
    assert translate(sql) == sql


def test_nulls_last_is_added_only_where_none_is_given():
    assert translate("SELECT a FROM t ORDER BY a, f(b, c) DESC NULLS FIRST LIMIT 3").count("NULLS LAST") == 1


def test_nested_calls_and_operators_keep_their_grouping(spark):
    assert one(spark, "bitwise_and(1 + 2, 2) * 2") == 4
    assert one(spark, "concat(upper('a'), NULL, lower('B'))") == "Ab"


def test_quotes_and_backslashes(spark):
    assert one(spark, "'it''s'") == "it's"
    assert one(spark, r"regexp_replace('a1b22', '\d+', '#')") == "a#b#"
    assert Engine(spark).sql('SELECT 1 AS "a b"').columns == ["a b"]


def test_quantified_comparisons_follow_three_valued_logic(spark):
    assert one(spark, "1 > ALL (SELECT x FROM (VALUES (0), (NULL)) AS t(x))") is None
    assert one(spark, "1 > ALL (SELECT x FROM (VALUES (2), (NULL)) AS t(x))") is False
    assert one(spark, "1 < ANY (SELECT x FROM (VALUES (2), (NULL)) AS t(x))") is True
    assert one(spark, "1 = ALL (SELECT x FROM (VALUES (1), (1)) AS t(x))") is True


# Results that public SQL documentation gives for these calls.
DOCUMENTED = {
    "cbrt(27.0)": 3.0, "truncate(-2.7D)": -2.0, "from_base('ff', 16)": 255, "to_base(255, 2)": "11111111", "width_bucket(5.3D, 0.2D, 10.6D, 5)": 3,
    "hamming_distance('karolin', 'kathrin')": 3, "levenshtein_distance('kitten', 'sitting')": 3, "codepoint('A')": 65, "split_part('a,b,c', ',', 2)": "b", "split_part('a', ',', 5)": "",
    "chr(8364)": "€", "luhn_check('79927398713')": True, "date_diff('month', DATE '2020-01-31', DATE '2020-02-01')": 1, "human_readable_seconds(96)": "1.60 minutes",
    "parse_data_size('1KB')": 1024, "regexp_extract('1a 2b', '(\\d+)([a-z]+)', 2)": "a", "regexp_extract('x', 'y')": None, "regexp_position('abc', 'c')": 3, "to_hex(255)": "ff",
    "crc32('hello')": 907060870, "xxhash64('')": -1205034819632174695, "url_encode('a b')": "a%20b", "json_array_contains('[1, 2]', 2)": True, "json_extract('{\"a\":\"x\"}', '$.a')": '"x"',
    "json_extract_scalar('{\"a\":{\"b\":1}}', '$.a')": None, "array_last(array(1, 2))": 2, "contains_sequence(array(1, 2, 3), array(2, 3))": True, "to_base32('foobar')": "MZXW6YTBOI======",
    "hmac_sha256('key', 'The quick brown fox jumps over the lazy dog')": "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8", "combinations(array('a', 'b', 'c'), 2)": [["a", "b"], ["a", "c"], ["b", "c"]],
    "from_big_endian_32(to_big_endian_32(-5))": -5, "ln(-1.0D) = ln(-1.0D)": True, "typeof(ceil(1.5D))": "double", "parse_duration('2m')": 120.0,
}


@pytest.mark.parametrize("call", sorted(DOCUMENTED))
def test_documented_values(spark, call):
    assert one(spark, call) == DOCUMENTED[call]


def test_distributions(spark):
    for call, want in {"normal_cdf(0, 1, 1.96D)": 0.9750021, "inverse_normal_cdf(0, 1, 0.975D)": 1.959964, "beta_cdf(3, 4, 0.5D)": 0.65625, "t_cdf(2.0D, 10)": 0.963306, "t_pdf(0, 10)": 0.389108}.items():
        assert one(spark, call) == pytest.approx(want, abs=1e-6)


def test_refused_functions_say_so(spark):
    with pytest.raises(NotImplementedError):
        one(spark, "spooky_hash_v2_32('x')")


def test_braces_in_strings_and_refusals(spark):
    e = Engine(spark)
    assert e.sql("SELECT strpos('a{1}', 'b{0}') AS x, split_part('a{*}b', '{*}', 2) AS y").first() == (0, "b")
    for sql in ("SELECT sum(id) OVER (ORDER BY id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM range(3)", "SELECT sum(id) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING EXCLUDE TIES) FROM range(3)"):
        with pytest.raises(NotImplementedError):
            e.sql(sql)


def test_not_in_is_three_valued(spark):
    e = Engine(spark)
    rows = "(VALUES (1), (2), (NULL)) AS t(x)"
    for inner, want in (("SELECT 1", [False, True, None]), ("SELECT 1 UNION ALL SELECT NULL", [False, None, None]), ("SELECT 1 WHERE false", [True, True, True])):
        assert [r[0] for r in e.sql(f"SELECT x NOT IN ({inner}) AS y FROM {rows}").collect()] == want
        assert e.sql(f"SELECT x FROM {rows} WHERE x NOT IN ({inner})").count() == want.count(True)
        assert e.sql(f"SELECT x FROM {rows} WHERE NOT (x + 0 NOT IN ({inner}))").count() == want.count(False)
    correlated = e.sql("SELECT x FROM (VALUES (1), (2)) AS t(x) WHERE x NOT IN (SELECT y FROM (VALUES (1), (2)) AS u(y) WHERE y < t.x)")
    assert sorted(r[0] for r in correlated.collect()) == [1, 2]
    plan = e.sql("SELECT id FROM range(9) WHERE id NOT IN (SELECT id FROM range(5))")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "ExistenceJoin" in plan


def test_integer_division(spark):
    e = Engine(spark)
    row = e.sql("SELECT 7 / 2 AS a, -7 / 2 AS b, 7::DOUBLE / 2::DOUBLE AS e, 7 / 2.0 AS c, CAST(7 AS DOUBLE) / 2 AS d, 100 / 7 / 2 AS f, (1 + 6) / (4 / 2) AS g, 2 * 7 / 4 AS h, 7 / 2 + 0.5 AS i, '7/2' AS s").first()
    assert [type(row[c]) for c in "abfgh"] == [int] * 5 and [row[c] for c in "abfgh"] == [3, -3, 7, 3, 3]
    assert (float(row["c"]), row["d"], row["e"], float(row["i"]), row["s"]) == (3.5, 3.5, 3.5, 3.5, "7/2")
    assert e.sql("SELECT sum(id) / count(*) AS m FROM range(4) WHERE id / 2 = 1 OR id IN (SELECT id / 3 FROM range(3))").first()["m"] == 5 // 3
    assert e.sql("WITH t AS (SELECT id / 2 AS h FROM range(6)) SELECT h, count(*) AS n FROM t GROUP BY h ORDER BY h").collect() == [(0, 2), (1, 2), (2, 2)]


def test_approx_distinct_keeps_no_sketch_for_each_distinct_value(spark):
    e = Engine(spark)
    df = e.sql("SELECT approx_distinct(id % 3000) AS a, approx_distinct(id % 3000, 0.02) AS b, approx_count_distinct(id) FILTER (WHERE id < 5000) AS c, count(DISTINCT id % 7) AS d FROM range(20000)")
    assert df.first() == (3000, 3000, 5000, 7)
    assert "approx_count_distinct" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    over = e.sql("SELECT DISTINCT approx_distinct(id % 5) OVER (PARTITION BY id % 2) AS a FROM range(100)")
    assert over.collect() == [(5,)]
