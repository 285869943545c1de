"""Time the headline queries: one JSON line with seconds by query.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of threads, BENCH_RUNS the timed runs after a first one.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from pagesearch.plans import testbed  # noqa: E402

NAMES = ["flagship_search", "hits_per_page", "response_json", "query_clean", "match_theta", "match_contains_rewrite", "word_index_build", "word_index_lookup", "image_join_inner", "metadata_image_semi", "strip_tags_text", "media_dims_json", "alto_scan"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in NAMES:
        took = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            testbed.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
