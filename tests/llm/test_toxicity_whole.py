"""The toxicity classifier on more labelled rows than the 4,000 of each label that it used to learn from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import toxicity
from loomspan.llm.base import held_out

CLEAN, TOXIC = 40_000, 6_000


@pytest.fixture(scope="module")
def many(spark):
    """Texts of 5 to 124 words of 3,000; toxic ones hold an insult that clean ones do not. Of toxic ones those whose ids
    have the larger hashes say it with another word."""
    rng = np.random.default_rng(4)
    texts = [[f"w{w}" for w in rng.integers(0, 3000, n)] for n in rng.integers(5, 125, CLEAN + TOXIC)]
    ids = spark.range(CLEAN + TOXIC).select("id", F.xxhash64("id", F.lit(11)).alias("h"), held_out(F.col("id")).alias("out")).toPandas()
    toxic = ids[ids["id"] % (CLEAN + TOXIC) >= CLEAN]
    late = set(toxic[toxic["h"] > toxic[~toxic["out"]]["h"].sort_values().iloc[4000]]["id"]) if (~toxic["out"]).sum() > 4000 else set()
    for i in range(CLEAN, CLEAN + TOXIC):
        texts[i][len(texts[i]) // 2] = "foul" if i in late else "vile"
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs.repartition(8), docs.selectExpr("doc_id", f"int(doc_id >= {CLEAN}) AS toxic"), late


def test_clean_documents_stay_whatever_the_share_of_toxic_ones(many):
    docs, labels, late = many
    assert late
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).select("doc_id", (F.col("toxicity") >= 0.3).alias("gone")).toPandas()
    clean = scored[scored["doc_id"] < CLEAN]
    assert clean["gone"].sum() <= CLEAN // 1000
    assert scored[scored["doc_id"] >= CLEAN]["gone"].mean() > 0.99 and scored[scored["doc_id"].isin(late)]["gone"].mean() > 0.99


def test_shards_do_not_follow_the_layout(many):
    docs, labels, _ = many
    few = docs.filter(f"doc_id % 5 = 0 OR doc_id >= {CLEAN}")
    one, other = (toxicity.fit_toxicity(d, labels, shard_rows=2000, epochs=1) for d in (few.coalesce(1), few.repartition(9)))
    assert len(one.indices) and one.indices.tolist() == other.indices.tolist() and one.weights.tolist() == other.weights.tolist() and one.bias == other.bias


def test_one_shard_is_plain_ftrl(spark, many):
    """A table that fits one shard: the learner over all rows in the order of their ids' hashes; a spooled file changes nothing."""
    docs, labels, _ = many
    few = docs.filter(f"doc_id % 100 = 0 OR doc_id >= {CLEAN + TOXIC - 400}")
    order = few.join(labels, "doc_id").filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit(11))).toPandas().sort_values("h")
    cache, plain, spooled = toxicity.word_hashes(), [], toxicity.Rows(limit=1000)
    for text, y in zip(order["text"], order["toxic"]):
        plain.append((toxicity.distinct_features(text.encode(), cache), int(y)))
        spooled.add(*plain[-1])
    want, same, got = toxicity.train_ftrl(plain), toxicity.train_ftrl(spooled), toxicity.fit_toxicity(few, labels.join(few.select("doc_id"), "doc_id"))
    assert same.weights.tolist() == want.weights.tolist() and same.bias == want.bias
    assert got.indices.tolist() == want.indices.tolist() and got.weights.tolist() == pytest.approx(want.weights.tolist(), abs=1e-6) and got.bias == pytest.approx(want.bias)


def shuffled(spark, work):
    """Bytes written for shuffles while ``work`` runs, no table being small enough to broadcast by itself."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        work()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return sum(n for k, n in written().items() if k not in before)


def test_texts_move_once(spark, many):
    docs, labels, _ = many
    docs, labels = docs.localCheckpoint(), labels.localCheckpoint()
    plain = docs.join(F.broadcast(labels.filter(~held_out(F.col("doc_id")))), "doc_id").select("doc_id", "text", "toxic").repartition(5, "doc_id")
    once = shuffled(spark, lambda: plain.write.format("noop").mode("overwrite").save())
    assert shuffled(spark, lambda: toxicity.fit_toxicity(docs, labels, epochs=1)) < 1.7 * once


def test_labels_and_texts_of_odd_ids(spark):
    """Null ids, repeated ids, ids without a text, labels other than 0 and 1: as ``labelled_rows`` has them, of any type."""
    from loomspan.llm.labelled import labelled_rows, labels_and_texts

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(3, "again"), (4, None), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    for kind, other in (("long", "long"), ("string", "string"), ("long", "int"), ("double", "double")):
        d, la = docs.withColumn("doc_id", F.col("doc_id").cast(kind)), labels.withColumn("doc_id", F.col("doc_id").cast(other))
        want = sorted((r["order"], r["body"], r["y"]) for r in labelled_rows(d, la, "toxic").collect())
        got, last = [], (None, None)
        for r in labels_and_texts(d, la, "toxic").orderBy("order", "key", F.col("y").asc_nulls_last(), "body").collect():
            last = (r["key"], r["y"]) if r["y"] is not None else last
            if r["body"] is not None and r["key"] == last[0]:
                got.append((r["order"], r["body"], last[1]))
        assert want and sorted(got) == want
