"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line: the median of three runs after a warm-up."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from geocell.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["geohash_encode_p12", "geohash_decode_box", "geohash_neighbours", "polygon_count", "polygon_rows", "bbox_filter", "route_base", "route_split", "ingest_upsert_latest", "skew_partition_stats", "skew_80_20", "hot_partitions_topk", "char_count", "hash_semi_filter", "knn_confusion"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        times = []
        for _ in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))


if __name__ == "__main__":
    main()
