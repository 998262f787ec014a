"""All queries on tables where one key holds a third of the rows."""

import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from compare import connect, rows_of_spark, rows_of_sql

HOT = {
    "lineitem": """* replace (case when l_linenumber % 3 = 0 then 11 else l_orderkey end as l_orderkey,
        case when l_suppkey % 3 = 0 then 17 else l_partkey end as l_partkey,
        case when l_quantity % 3 = 0 then 3 else l_suppkey end as l_suppkey)""",
    "orders": """* replace (case when o_orderkey % 3 = 0 then 5 else o_custkey end as o_custkey,
        case when o_orderkey % 2 = 0 then '1-URGENT' else o_orderpriority end as o_orderpriority)""",
    "events": """* replace (case when event_id % 3 = 0 then 'click' else event_type end as event_type,
        case when event_id % 2 = 0 then 10 else user_id end as user_id)""",
}


@pytest.fixture(scope="module")
def skewed_dir(sf_dir, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("skewed"))
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        if table in HOT:
            duckdb.execute(f"copy (select {HOT[table]} from '{sf_dir}/{name}') to '{target}/{name}' (format parquet)")
        else:
            shutil.copy(f"{sf_dir}/{name}", f"{target}/{name}")
    return target


NAMES = [
    "append_result_row",
    "assemble_rows",
    "axis_query",
    "axis_query_row_set",
    "batch_callback",
    "batch_intervals",
    "coord_range_tiles",
    "subset_batches",
    "densify",
    "effective_batch",
    "gene_subset",
    "gene_subset_columns",
    "growing_store",
    "label_codes",
    "nested_results_json",
    "obs_semi_join",
    "reshard_shuffled",
    "sized_part_shuffle",
    "stream_chunk_shuffle",
    "subset_rewrite",
    "throughput_epochs",
    "variable_counts",
    "write_sparse",
    "x_label_join",
]


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed_dir, name):
    want = rows_of_sql(connect(skewed_dir), entry.oracle_sql()[name])
    assert rows_of_spark(entry.queries()[name](spark, skewed_dir)) == want


@pytest.mark.parametrize("kept", [10**6, 3])
def test_codes_of_hot_and_null_categories_beyond_the_broadcast_bound(spark, monkeypatch, kept):
    from pyspark.sql import functions as F

    from rowloom.operators import layouts

    monkeypatch.setattr(layouts, "MAX_BROADCAST_CODES", kept)
    n = 3_000
    name = F.when(F.col("row_id") % 3 == 0, "hot").when(F.col("row_id") % 3 == 1, F.concat(F.lit("c"), F.col("row_id") % 40))
    rows = spark.range(n).withColumnRenamed("id", "row_id").withColumn("name", name)
    names = sorted({"hot", *(f"c{i % 40}" for i in range(1, n, 3))})
    want = {i: names.index("hot" if i % 3 == 0 else f"c{i % 40}") if i % 3 < 2 else -1 for i in range(n)}
    coded = layouts.label_codes(rows, "name")
    assert coded.columns == ["row_id", "name", "label_code"]
    assert {r.row_id: r.label_code for r in coded.collect()} == want
    if kept == 3:
        spread = coded.groupBy("name", F.spark_partition_id().alias("task")).count().groupBy("name").count()
        assert "_salt" in coded._jdf.queryExecution().optimizedPlan().toString() and spread.count() == len(names) + 1


def test_intervals_of_a_log_take_one_exchange(spark):
    from pyspark.sql import functions as F

    from rowloom.operators import metrics

    log = spark.range(1_000).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("run"),
        F.col("id").alias("idx"),
        F.timestamp_seconds(F.col("id") * F.col("id")).alias("ts"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = metrics.batch_intervals(log, "run", "idx", "ts", F.timestamp_seconds(F.lit(0)), width=100)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = {r.idx: r.interval_us for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One for the log; three for its ranges: their sums, their window and the join.
    assert plan.count("Exchange hashpartitioning(_run") == 4
    assert rows == {i: (i * i - (i - 3) ** 2 if i > 2 else i * i) * 1_000_000 for i in range(1_000)}
