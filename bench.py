"""Times the catalogue's headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from millrace.catalogue import QUERIES

HEADLINE = ("revenue_by_nation", "statistics", "two_leaves", "child_group_counts_once", "any_child", "threshold_percentile", "monthly_series", "look_backs", "share_and_total", "totals_rows", "distribution", "conversion", "stock_closing_day", "history_join", "joined_parts")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, seconds in all", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
