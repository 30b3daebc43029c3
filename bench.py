"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sedimill.plans.queries import QUERIES

HEADLINE = [
    "recipe_flagship", "text_length_filter", "alphanumeric_filter", "special_characters_filter", "stopwords_filter", "word_repetition_filter", "clean_email_mapper", "clean_links_mapper",
    "remove_long_words_mapper", "document_deduplicator", "document_minhash_deduplicator", "topk_specified_field_selector", "frequency_specified_field_selector", "encode_and_get_nearest_mapper",
    "analyzer", "token_counts", "baseline_pricing", "baseline_join",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus)))).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
