"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from gramtide.plans import catalog  # noqa: E402

#: Those that the baseline has figures for come first.
HEADLINE = (
    "vocab_census", "matrix_long", "nms", "windows_long", "pca_spectrum", "norm_compare", "stage_counts", "kernel_spectrum", "series_point",
    "unigram_counts", "bigram_counts", "ngram_min_total", "query_month", "top_month", "evolution", "vocab_sliding", "rolling_freq", "corr_spearman", "success_windows", "tfidf", "fit_nb",
)
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            if sum(runs) > 40:
                break
        took[name] = round(median(runs[1:] or runs), 3)  # the first run compiles
    print(json.dumps({"metric": "total seconds of the headline queries, warm median", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
