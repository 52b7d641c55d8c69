"""Times the headline queries: each once to warm up, then the best of two runs, results counted on the executors.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8); prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time

from loomspan.plans import registry
from loomspan.session import build_session

HEADLINE = [f"q{n}" for n in range(1, 23)] + ["agg_rollup", "window_ranking", "window_rows_frame", "subquery_correlated_scalar", "vector_knn_l2", "shape_as_of_join", "topk"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "12g", "spark.sql.autoBroadcastJoinThreshold": "32m"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for attempt in range(3):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
