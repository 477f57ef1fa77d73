"""Times the headline queries; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from keyloom.queries import QUERIES

HEADLINE = ["replay_live", "mget_ordered", "lsm_merge_newest", "lsm_compaction_drop", "incr_fold", "histogram_quantiles", "keys_glob_star", "scan_page_first"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, rows = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first warms up
            began = time.time()
            # the whole result is made, and thrown away
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
        rows[name] = df.count()
    print(json.dumps({"metric": "sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
