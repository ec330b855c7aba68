"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, and BENCH_QUERIES (names, comma-separated) are read.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from spanstat.plans.queries import QUERIES

HEADLINE = ("overlap_counts", "overlap_pairs", "overlap_counts_snp", "anti_overlap", "clip_whitelist", "region_merge", "stats_nb", "pairwise_pval", "mc_circular", "tile_cosine_gram", "corpus_stats", "zscore_state")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark.range(1000).count()
    took = {}
    for n in names:
        at = time.time()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - at, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
