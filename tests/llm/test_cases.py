"""The defined cases of every operator: nulls, empties, ties, repeats, long texts, empty tables, and columns whose names
are those that operators use inside. Values are held against the same rows without the extra columns."""

import pytest

from loomspan.llm import decontamination, exact_dedup, line_dedup, ngram_join, quality, sentencepiece, toxicity, url_filter, warc
from loomspan.llm.base import BitFilter, Scratch, join_unique, without_ids

DOCS = "doc_id long, text string"
#: Names that the operators give to columns of their own.
INSIDE = ["id", "key", "body", "digest", "norm", "n", "tkey", "lines", "runs", "_runs", "_maybe", "_gone", "_twice", "_r_id", "_r_tkey", "_bf_probe", "_bf_want", "_bf_word", "_bf_bits", "_bf_mask", "_bf_hit", "_toxicity", "_decoded", "_contamination", "_digest", "_more", "_doc", "_id", "y", "order", "u", "host", "path", "rule", "payload", "sha1", "maybe", "first", "refers", "component", "rep", "sig", "rows", "label"]
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(400_000))  # some 3 MB
LINES = "\n".join(" ".join(f"l{k}w{j}" for j in range(12)) for k in range(6))
ROWS = [(None, "alpha beta"), (1, None), (2, ""), (3, " \t\n "), (4, LINES), (5, LINES), (5, LINES), (6, LINES + "\ntail"), (7, "one"), (8, "One"), (9, LONG), (10, "é\x00ß 日本"), (11, "a\n" * 80), (None, LINES), (12, "日本語" * 3000)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    extra = ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame([(i, t, *(f"{c}!" for c in INSIDE)) for i, t in ROWS], f"{DOCS}, {extra}")


def operators(spark):
    items = spark.createDataFrame([(1, " ".join(LINES.split()[:15])), (2, "one"), (3, None)], "item_id long, text string")
    model = sentencepiece.PieceModel.load()
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (4, 6, 7, 8, 10, 11)] + [(4, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    one, both = (
        {
            "decontaminate": lambda df: decontamination.decontaminate(df, items),
            "decontaminate in blocks": lambda df: decontamination.decontaminate(df, items, block_words=15),
            "dedup_lines": lambda df: line_dedup.dedup_lines(df, drop_emptied=True),
            "keep_one": ngram_join.keep_one,
            "deduplicate": exact_dedup.deduplicate,
        },
        {
            "find_contamination": lambda df: decontamination.find_contamination(df, items),
            "score_toxicity": lambda df: toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels)),
            "score_quality": lambda df: quality.score_quality(df, quality.fit_quality(df, labels)),
            "encode": lambda df: sentencepiece.encode(df, model, decoded="back"),
        },
    )
    return one, both


NAMES = ["decontaminate", "decontaminate in blocks", "dedup_lines", "keep_one", "deduplicate", "find_contamination", "score_toxicity", "score_quality", "encode"]


@pytest.mark.parametrize("name", NAMES)
def test_columns_of_any_name(spark, plain, clashing, name):
    same, more = operators(spark)
    run = same.get(name) or more[name]
    got, want = run(clashing), run(plain)
    added = [c for c in want.columns if c not in ("doc_id", "text")]
    assert got.columns == [*clashing.columns, *added] and (name in more) == bool(added)
    rows = [r.asDict(recursive=True) for r in got.collect()]
    assert all(r[c] == f"{c}!" for r in rows for c in INSIDE)
    assert sorted(repr([r[c] for c in want.columns]) for r in rows) == sorted(repr([r.asDict(recursive=True)[c] for c in want.columns]) for r in want.collect())
    empty = run(clashing.filter("false"))
    assert empty.columns == got.columns and empty.count() == 0


def test_decontamination_in_blocks_equals_one_block(spark, plain):
    same, _ = operators(spark)
    assert sorted(map(repr, same["decontaminate"](plain).collect())) == sorted(map(repr, same["decontaminate in blocks"](plain).collect()))


def test_what_stays(spark, plain):
    """The rows that each filter keeps, by id and length of the text."""
    same, _ = operators(spark)
    kept = {n: sorted((str(r["doc_id"]), len(r["text"] or "")) for r in f(plain).collect()) for n, f in same.items()}
    given = sorted((str(i), len(t or "")) for i, t in ROWS)
    lines = len(LINES)
    cut = lines - len(" ".join(LINES.split()[:15]))
    assert kept["decontaminate"] == sorted((i, {lines: cut, lines + 5: cut + 5}.get(n, n)) for i, n in given if i not in ("7", "8"))  # which are items
    assert [x for x in kept["deduplicate"] if x[1] == lines] == [("4", lines)] and ("None", 10) in kept["deduplicate"]
    assert {i for i, n in kept["keep_one"]} >= {"None", "1", "2", "3", "4", "9", "10", "12"} and not {"5", "6"} & {i for i, _ in kept["keep_one"]}
    assert [x for x in kept["dedup_lines"] if x[1] >= lines and x[1] < lines + 5] == [("None", lines)]  # null ids come first
    assert ("6", 4) in kept["dedup_lines"]
    several = spark.createDataFrame([(5, "a"), (4, "a"), (5, "b x"), (5, "b  x"), (None, "c"), (None, "c"), (None, "a"), (None, "d")], DOCS)
    assert sorted((str(r["doc_id"]), " ".join(r["text"].split())) for r in exact_dedup.deduplicate(several).collect()) == [("4", "a"), ("5", "b x"), ("None", "c"), ("None", "d")]


def test_url_filter_columns(spark):
    rows = [(1, "http://a.example.org/x"), (2, None), (3, ""), (3, ""), (4, "http://" + "a." * 3000 + "org/" + "p" * 100_000)]
    extra = ", ".join(f"`{c}` string" for c in INSIDE)
    pages = spark.createDataFrame([(i, u, *(f"{c}!" for c in INSIDE)) for i, u in rows], f"page_id long, url string, {extra}")
    rules = spark.createDataFrame([("example.org/", "block"), ("org/", "allow")], "rule string, verdict string")
    for limit in (url_filter.MAX_BYTES, 0):
        got = url_filter.judge_urls(pages, rules, max_bytes=limit)
        assert sorted((r["page_id"], r["judgement"]["rule"], r["judgement"]["verdict"], r["u"]) for r in got.collect()) == [(1, "example.org/", "block", "u!"), (2, None, "allow", "u!"), (3, None, "allow", "u!"), (3, None, "allow", "u!"), (4, "org/", "allow", "u!")]
        assert url_filter.judge_urls(pages.filter("false"), rules, max_bytes=limit).count() == 0


def test_warc_long_payloads(spark):
    pages = spark.createDataFrame([(1, "u", LONG), (2, "u", LONG), (3, "u", "x"), (3, "u", "x")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(1, len(LONG), "response", None), (2, len(LONG), "revisit", 1), (3, 1, "response", None), (3, 1, "response", None)]


def test_held_out_labels_and_other_columns_leave_scores_alone(spark):
    """Scores depend on the text alone, and models not on labels of the held-out fold."""
    rows = [(i, f"{'vile scum' if i % 3 == 0 else 'fine day'} number{i % 7} tail{i % 5}", "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, f"{DOCS}, lang string, source string")
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = [(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(400)]
    turned = [(i, 1 - a, 1 - b) if held(i) else (i, a, b) for i, a, b in labels]
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'other' AS source")
    schema = "doc_id long, toxic int, quality int"
    for fit, score, column in ((toxicity.fit_toxicity, toxicity.score_toxicity, "toxicity"), (quality.fit_quality, quality.score_quality, "quality")):
        first = {r["doc_id"]: r[column] for r in score(docs, fit(docs, spark.createDataFrame(labels, schema))).collect()}
        again = {r["doc_id"]: r[column] for r in score(other, fit(other, spark.createDataFrame(turned, schema))).collect()}
        assert first == again
        assert fit(docs, spark.createDataFrame(labels, schema), sample_bytes=0).bias == pytest.approx(fit(docs, spark.createDataFrame(labels, schema), per_class=0).bias)


def test_ftrl_equals_its_definition():
    """The learner against FTRL-proximal written out coordinate by coordinate."""
    import math
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(16), 4)), np.int32), rng.randint(0, 1)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.3, 0.1
    z, n, bz, bn = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(2):
        for idx, y in rows:
            w, b = {i: weight(i) for i in idx.tolist()}, -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
            bn += g * g
    got = toxicity.train_ftrl(rows, bits=4, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    dense = got.dense(4)
    assert dense.tolist() == pytest.approx([weight(i) for i in range(16)], abs=1e-6) and got.bias == pytest.approx(-bz / ((beta + math.sqrt(bn)) / alpha))


def test_shared_pieces(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, _bf_word string")
    keys = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(r["_bf_word"] for r in BitFilter(keys, "k").keep(df, "k").collect())[:2] == ["a", "b"]
    assert sorted(str(r["k"]) for r in without_ids(df, keys, "k").collect()) == ["3", "None"]
    left = spark.range(5000).selectExpr("CASE WHEN id < 2000 THEN -1 ELSE id END AS k", "id")
    right = left.filter("k < 4000").groupBy("k").count()
    for how, n in (("inner", 4000), ("left", 5000)):
        assert join_unique(left, right, ["k"], "count", how).count() == n
    mine: list[Scratch] = []
    outside = Scratch(spark, "outside")
    saved = outside.save(spark.range(3), "t")
    with Scratch.collected(mine):
        Scratch(spark, "inside").save(spark.range(2), "t")
    assert len(mine) == 1
    mine[0].close()
    assert saved.count() == 3


def test_pipeline_stages_on_odd_rows(spark, clashing):
    """Every stage over nulls, empties, ties, repeats, long texts and clashing names; and over no rows."""
    import corpus_pipeline as p
    from conftest import SF

    docs = clashing.selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars")
    kept = {}
    before, empty = docs, docs.filter("false")
    for name, stage in p.STAGES:
        after = Scratch(spark, "odd").save(stage(spark, before, SF), name)
        rows = [r.asDict(recursive=True) for r in after.collect()]
        assert after.columns[: len(docs.columns)] == docs.columns and (name == "tokens" or after.columns == docs.columns)
        assert all(r[c] == f"{c}!" for r in rows for c in INSIDE)
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        kept[name] = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in rows)
        if name in ("toxicity", "decontamination", "tokens"):
            assert stage(spark, empty, SF).count() == 0
        before = after
    assert kept["toxicity"] == sorted((str(i), len(t or "")) for i, t in ROWS)
    # Null ids come first: the passage stays there and goes elsewhere; of document 6 a line is left, of 11 its fifty words.
    assert {i for i, _ in kept["line_dedup"]} == {"None", "1", "2", "3", "6", "7", "8", "9", "10", "11", "12"} and ("None", len(LINES)) in kept["line_dedup"] and ("6", 4) in kept["line_dedup"]
    assert {i for i, _ in kept["near_duplicates"]} == {i for i, _ in kept["line_dedup"]} - {"8"}  # "one" and "One" are alike
    assert kept["decontamination"] == kept["near_duplicates"] and kept["tokens"] == kept["decontamination"]
    tokens = {str(r["doc_id"]): r for r in before.collect()}
    assert all(r["round_trip"] for r in tokens.values()) and tokens["1"]["ids"] is None and tokens["1"]["n_tokens"] is None and tokens["2"]["n_tokens"] == 0
