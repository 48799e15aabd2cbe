"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fieldmanual.plans import QUERIES  # noqa: E402

# Names as registered: lexical and vector search, hybrid retrieval, preparation, cases, tracing, throttling.
HEADLINE = ("search_like", "search_bm25", "hybrid_retrieval", "vector_topk", "text_similarity", "sentence_chunks", "lines_without_noise",
            "distinct_contents", "packed_windows", "token_index", "visible_counts", "secured_search", "occurrences", "entry_rollup", "ranked_causes",
            "merged_edges", "page_variants", "cross_references", "procedures", "snapshot_diff", "throttled_events", "residual_stats")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
