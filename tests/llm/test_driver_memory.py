"""What an operator leaves in the driver: queries, and garbage between them."""

import gc

from loomspan.llm import base
from loomspan.llm.base import Scratch
from loomspan.llm.components import components


def test_a_round_of_components_is_one_query(spark, monkeypatch):
    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *a, **b: saved.append(name) or save(self, df, name, *a, **b))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 101), (7, 7)], "a long, b long").localCheckpoint()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = components(links, Scratch(spark, "t"), "one")
    assert store.executionsCount() - before == len(saved) > 3
    assert {r["id"]: r["component"] for r in found.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_a_grown_heap_is_collected_after_each_saved_table(spark, monkeypatch):
    full = []
    noted = lambda phase, info: full.append(1) if phase == "start" and info["generation"] == 2 else None
    gc.callbacks.append(noted)
    try:
        scratch = Scratch(spark, "t")
        for share, least in ((0.0, 3), (2.0, 0)):
            monkeypatch.setattr(base, "GROWN_HEAP", share, raising=False)
            gc.collect()
            full.clear()
            for i in range(3):
                assert scratch.save(spark.range(5), f"{share}-{i}").count() == 5
            assert len(full) >= least
    finally:
        gc.callbacks.remove(noted)
