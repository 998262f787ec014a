"""Physical plans: what is read, and what is never in them."""

import re

import pytest

from rowloom.operators import ordering
from rowloom.plans import fixtures, loading
from rowloom.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_joins(spark, sf_dir, name):
    text = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan_of(QUERIES["coord_range"](spark, sf_dir))
    assert "LessThanOrEqual(l_partkey,999)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    text = plan_of(QUERIES["head_slice"](spark, sf_dir))
    assert "LessThan(l_orderkey,256)" in text and "LessThan(l_partkey,500)" in text
    text = plan_of(QUERIES["value_filter_eq"](spark, sf_dir))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text
    assert "ReadSchema: struct<row_id:bigint,cell_line:string>" in plan_of(QUERIES["obs_columns"](spark, sf_dir))
    text = plan_of(QUERIES["layer_select"](spark, sf_dir))
    assert re.search(r"PartitionFilters: \[.*measurement#\d+ = RNA\), \(layer#", text)


def test_sequential_batches_do_not_shuffle(spark, sf_dir):
    plan = ordering.batch_sequential(fixtures.row_ids(spark, sf_dir), 128)
    assert "Exchange" not in plan_of(plan)


def test_payload_of_shuffled_batches_is_exchanged_once(spark, sf_dir):
    text = plan_of(QUERIES["batch_callback"](spark, sf_dir))
    main = text.split("BroadcastExchange")[0]
    assert main.count("Exchange hashpartitioning") == 1
    # Only ids are read for the permutation itself.
    assert len(re.findall(r"FileScan parquet \[row_id#\d+L,indices", text)) == 1
    assert len(re.findall(r"FileScan parquet \[row_id", text)) == 3


@pytest.mark.parametrize("method", ["permutation", "block", "chunk_window"])
def test_payload_of_a_loading_run_is_exchanged_once(spark, sf_dir, method):
    store = fixtures.sharded_store(spark, sf_dir)
    run = loading.loading_run(spark, store.manifest, fixtures.COLLECTION, store.schema, method, n_datasets=-1)
    text = plan_of(run.batches)
    main = text.split("BroadcastExchange")[0]
    assert main.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"FileScan parquet \[row_id#\d+L,indices", text)) == 1


def test_subset_of_sparse_rows_does_not_move_them(spark, sf_dir):
    from rowloom.operators.slicing import gene_subset_rows

    rows = fixtures.stored_rows(spark, sf_dir)
    text = plan_of(gene_subset_rows(rows, fixtures.var(spark, sf_dir), fixtures.gene_list(spark, sf_dir)))
    outside = text.split("Subquery")[0]
    assert "Exchange" not in outside


def test_global_orders_gather_only_bucket_counts_in_one_task(spark, sf_dir):
    ids = fixtures.row_ids(spark, sf_dir)
    for planner in (ordering.global_permutation, ordering.block_shuffle, ordering.chunk_window_shuffle):
        text = plan_of(planner(ids, 128, drop_last=False))
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                below = next(l for l in lines[i + 1 :] if "Aggregate" in l or "Scan" in l or "Window" in l)
                assert "Aggregate" in below, text
