"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from mentionflow.plans import catalogue

HEADLINE = (
    "entity_counts", "entity_vocab", "max_active", "seen_split", "dense_ids", "string_match", "date_split", "muc", "b_cubed", "backward_links", "backward_cluster", "mention_similarity", "feature_cluster", "dendrogram_purity",
    "tfidf", "ceaf_e", "tree_cut", "find_threshold", "mention_index", "stream_cache", "hierarchy_blocks",
)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for the session's start; that is no query's time.
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
