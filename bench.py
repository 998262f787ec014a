"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs its whole plan into a sink that keeps nothing. The time of a
query is the better of two runs; stores that several queries read are written
before and timed as ``prepare_store``. Loading orders also give rows per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from rowloom.plans import fixtures
from rowloom.plans.queries import QUERIES

HEADLINE = [
    "subset_batches",
    "loading_run_permutation",
    "loading_run_block",
    "loading_run_chunk_window",
    "batch_sequential",
    "global_permutation",
    "sorted_within_batch",
    "block_shuffle",
    "chunk_window_shuffle",
    "row_group_shuffle",
    "part_shuffle",
    "stream_chunk_shuffle",
    "epochs",
    "batch_callback",
    "row_gather",
    "concat_scan",
    "x_label_join",
    "assemble_rows",
    "densify",
    "gene_subset",
    "subset_rewrite",
    "reshard_shuffled",
    "reshard_ordered",
    "axis_query",
    "throughput_epochs",
    "batch_intervals",
    "nested_results_json",
    "prepare_collections",
    "write_dense_chunked",
    "write_two_level_chunks",
    "write_wide_row_groups",
    "row_group_scan",
    "loading_run_budget",
    "loading_run_epochs",
    "keyed_permutation",
    "loading_run_resumed",
    "axis_query_row_set",
    "row_gather_index",
    "coord_range_tiles",
    "gene_subset_columns",
]
# Rows each loading query puts in batches, in passes over the row table.
LOADING = {
    "loading_run_permutation": 1,
    "loading_run_block": 1,
    "loading_run_chunk_window": 1,
    "batch_sequential": 1,
    "global_permutation": 1,
    "block_shuffle": 1,
    "chunk_window_shuffle": 1,
    "part_shuffle": 1,
    "epochs": 5,
    "batch_callback": 1,
    "keyed_permutation": 1,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    n_rows = fixtures.row_ids(spark, sf_dir).count()

    times: dict[str, float] = {}
    started = time.perf_counter()
    fixtures.sharded_store(spark, sf_dir)
    times["prepare_store"] = round(time.perf_counter() - started, 3)
    for name in names:
        best = float("inf")
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "samples_per_sec": {
                    name: round(n_rows * passes / times[name]) for name, passes in LOADING.items() if name in times
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
