"""Time the headline queries and print one JSON line.

Every query is built and run to the end into Spark's ``noop`` sink, twice; the
faster run counts, since the first one pays for starting Python workers and
compiling.  Settings: ``BENCH_SF_DIR``, ``BENCH_CPUS``, ``BENCH_QUERIES``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from listloom.queries import QUERIES  # noqa: E402

# From single operators to whole flows.
HEADLINE = [
    "static_images",
    "listing_body",
    "first_success",
    "log_routes",
    "fetch_status_rollup",
    "cache_misses",
    "site_names",
    "size_convert_men",
    "json_fields",
    "expand_variants",
    "unique_file_names",
    "glossary",
    "dom_tag_counts",
    "paragraph_texts",
    "sku_quantity",
    "css_grammar",
    "color_fields",
    "converted_sizes",
    "article_rows",
    "stream_listings",
    "listing_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], cold[name] = round(min(runs), 3), round(runs[0], 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
