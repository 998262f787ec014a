"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import schemas, workdir
from rowloom.functions import scalars
from rowloom.operators import batches, growing, keyed_order, layouts, metrics, ordering, reshard, rowsets, slicing, tiles
from rowloom.operators.ordinals import grouped_positions
from rowloom.plans import fixtures as fx
from rowloom.plans import layout_study, loading, preparation
from rowloom.plans.subsets import batch_summary
from rowloom.sources import group_index, registry, scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REGION = "ASIA"
LAST_VAR = 999
BATCH = 128
# A store small enough to be in more than one chunk or segment at test scale.
TIMED_SEGMENT = 100
PART_BYTES = 65_536


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _row_sums(df: DataFrame, *keep: str) -> DataFrame:
    """Entries and total of each sparse row; counts are whole numbers."""
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return df.select(*keep, F.size("indices").cast("bigint").alias("nnz"), total.alias("total"))


def _weighted(indices, values):
    """Sum of value x (index + 1): tells apart rows that differ in order or place."""
    pairs = F.arrays_zip(indices.alias("i"), values.alias("v"))
    return F.aggregate(
        pairs, F.lit(0.0), lambda s, e: s + e["v"].cast("double") * (e["i"].cast("double") + 1)
    )


# --- sub-matrix query ------------------------------------------------------


@query
def subset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(
        fx.obs(spark, sf_dir),
        fx.datasets_of(spark, sf_dir, REGION),
        fx.x_coo(spark, sf_dir),
        last_var=LAST_VAR,
        batch_size=BATCH,
    )


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    """A written store as one matrix, as its readers see it: many files per shard."""
    stored = spark.read.parquet(path)
    manifest = registry.shard_manifest(stored, collection_key="back", description="", key_prefix="back", root=path)
    schema = schemas.T.StructType([f for f in stored.schema.fields if f.name != "shard"])
    return scans.concat_scan(spark, manifest, "back", schema)


def _loaded(spark: SparkSession, sf_dir: str, method: str, **options) -> DataFrame:
    """What each batch of a loading run on the whole collection holds."""
    store = fx.sharded_store(spark, sf_dir)
    run = loading.loading_run(spark, store.manifest, fx.COLLECTION, store.schema, method, **options)
    epoch = ["epoch"] if options.get("epochs") else []
    rows = run.batches.select(
        *epoch,
        "batch_id",
        "row_id",
        "pos",
        "cell_line",
        F.size("indices").cast("bigint").alias("nnz"),
        F.aggregate("values", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total"),
    )
    return rows.groupBy(*epoch, "batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("nnz").alias("nnz"),
        F.sum("total").alias("total"),
        F.sum(F.col("row_id") * F.col("pos")).alias("order_sum"),
        F.count_distinct("cell_line").alias("n_labels"),
    )


@query
def loading_run_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "permutation")


@query
def loading_run_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "block")


@query
def loading_run_chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "chunk_window")


@query
def loading_run_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "permutation", n_samples=1_000, batch_size=96)


@query
def loading_run_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "block", epochs=3, batch_size=96, drop_last=False)


@query
def prepare_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fx.sharded_store(spark, sf_dir)
    # The source shards are joined in reverse of their number.
    keys = [r.shard_key for r in store.manifest.orderBy(F.desc("shard_ord")).select("shard_key").collect()]
    manifest = preparation.prepare_collections(
        spark,
        store.manifest,
        keys,
        store.schema,
        fx.var(spark, sf_dir),
        fx.gene_list(spark, sf_dir),
        workdir.fresh_path(spark, "prepared"),
        name="orders",
        shard_rows=fx.SHARD_ROWS,
        rows_per_file=fx.FILE_ROWS,
        relayout_chunk=512,
    )
    sums = None
    for key in ("orders_sharded", "orders_sharded_subset", "orders_chunked", "orders_chunked_mini"):
        schema = schemas.T.StructType([*store.schema.fields])
        rows = registry.collection_scan(spark, manifest, key, schema, -1)
        one = _row_sums(rows, F.lit(key).alias("collection_key"), "shard", "row_id")
        sums = one if sums is None else sums.unionByName(one)
    return sums.join(
        manifest.select("collection_key", F.col("shard_ord").alias("shard"), "n_observations"),
        ["collection_key", "shard"],
    )


# --- scans -----------------------------------------------------------------


@query
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_sums(fx.stored_rows(spark, sf_dir), "row_id", "shard", "cell_line")


@query
def collection_scan_first_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fx.sharded_store(spark, sf_dir)
    rows = registry.collection_scan(spark, store.manifest, fx.COLLECTION, store.schema, 2)
    return _row_sums(rows, "row_id", "shard", "cell_line")


@query
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return registry.unique_lookup(customer, F.col("c_name") == "Customer#000000042")


@query
def uid_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fx.sharded_store(spark, sf_dir)
    listed = [r.shard_key for r in store.manifest.orderBy(F.md5("shard_key")).select("shard_key").collect()]
    found = registry.uid_list_scan(spark, store.manifest, listed)
    rows = fx.stored_rows(spark, sf_dir).select("row_id", "shard")
    return rows.join(found, F.col("shard") == F.col("shard_ord")).select(
        "list_ord", "shard_key", "row_id"
    )


@query
def dir_suffix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workdir.fresh_path(spark, "mixed")
    fx.x_dense(spark, sf_dir).select("row_id", "x").write.parquet(f"{root}/matrix")
    fx.x_dense(spark, sf_dir).select("row_id", "code").write.json(f"{root}/notes")
    rows = scans.dir_suffix_scan(spark, root, ".parquet", schemas.X_DENSE)
    return rows.select(
        "row_id", F.size("x").cast("bigint").alias("n_values"), F.array_max("x").cast("double").alias("largest")
    )


@query
def numbered_shard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fx.sharded_store(spark, sf_dir)
    n_shards = store.manifest.count()
    rows = scans.numbered_shard_scan(spark, store.root, n_shards, store.schema, max_shards=n_shards)
    return rows.select("row_id", "shard", "cell_states")


@query
def concat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fx.sharded_store(spark, sf_dir)
    rows = scans.concat_scan(spark, store.manifest, fx.COLLECTION, store.schema)
    return _row_sums(rows, "row_id", "shard", "cell_line")


@query
def checked_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored shards as one matrix, each with a stored variable list of its own."""
    store = fx.sharded_store(spark, sf_dir)
    path = workdir.fresh_path(spark, "shard-variables")
    names = fx.var(spark, sf_dir).select(F.col("var_id").alias("var_ord"), "var_name")
    fx.write_shard_lists(names, store.manifest.count(), path)
    rows = scans.concat_scan(spark, store.manifest, fx.COLLECTION, store.schema)
    return _row_sums(scans.checked_concat(rows, spark.read.parquet(path)), "row_id", "shard")


@query
def obs_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.obs_columns(spark, fx.sharded_store(spark, sf_dir).root, ["cell_line"])


@query
def layer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "layers")
    raw = fx.x_coo(spark, sf_dir).withColumn("layer", F.lit("raw"))
    scaled = raw.withColumn("value", F.col("value") / 2).withColumn("layer", F.lit("data"))
    both = raw.unionByName(scaled).withColumn("measurement", F.lit("RNA"))
    both.write.partitionBy("measurement", "layer").parquet(path)
    return scans.layer_select(spark.read.parquet(path))


@query
def wide_scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(fx.layout_stores(spark, sf_dir)["parquet"])
    rows = scans.wide_scan_split(wide)
    return rows.select(F.posexplode("x").alias("var_id", "value"), F.col("label").cast("int").alias("label")).select(
        "var_id", F.col("value").cast("double").alias("value"), "label"
    )


@query
def list_column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = fx.x_dense(spark, sf_dir)
    path = fx.layout_stores(spark, sf_dir)["h5py_dense"]
    rows = scans.list_column_scan(spark, path, fx.n_values(dense))
    return rows.select("row_id", F.posexplode("x").alias("var_id", "value")).select(
        "row_id", "var_id", F.col("value").cast("double").alias("value")
    )


@query
def gene_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "genes")
    fx.gene_list(spark, sf_dir).write.parquet(path)
    return scans.gene_list_scan(spark, path)


# --- sinks -----------------------------------------------------------------


@query
def write_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "sparse")
    layouts.write_sparse(fx.stored_rows(spark, sf_dir), path)
    by_row = _row_sums(spark.read.schema(schemas.X_ROW).parquet(f"{path}/row"), "row_id")
    entries = spark.read.schema(schemas.X_COO).parquet(f"{path}/coo")
    by_entry = entries.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("coo_nnz"), F.sum(F.col("value").cast("double")).alias("coo_total")
    )
    return by_row.join(by_entry, "row_id", "left").select(
        "row_id",
        "nnz",
        "total",
        F.coalesce("coo_nnz", F.lit(0)).alias("coo_nnz"),
        F.coalesce("coo_total", F.lit(0.0)).alias("coo_total"),
    )


def _value_sums():
    """Label sum and, exact in any order, the places and values of a group of dense rows."""
    weighted = F.aggregate(
        F.transform("x", lambda v, i: F.round(v.cast("double") * 1e6).cast("bigint") * (i + 1)),
        F.lit(0).cast("bigint"),
        lambda s, v: s + v,
    )
    return F.sum("code").alias("code_sum"), F.sum(weighted * (F.col("row_id") + 1)).alias("x_sum")


@query
def write_dense_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "dense_chunked")
    layouts.write_dense_chunked(fx.x_dense(spark, sf_dir), path, batch=BATCH, batches_per_file=2)
    groups = layouts.row_groups(spark, path, key="row_id").select(F.col("first_key").alias("first_row"), "n_rows")
    first = F.expr(f"row_id div {BATCH} * {BATCH}")
    stored = spark.read.parquet(path).groupBy(first.alias("first_row")).agg(*_value_sums())
    return groups.join(stored, "first_row")


@query
def write_two_level_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "dense_nested")
    dense = fx.x_dense(spark, sf_dir)
    layouts.write_two_level_chunks(
        dense, dense.select("row_id", "code"), path, outer=BATCH, inner=32, chunks_per_file=2
    )
    groups = layouts.row_groups(spark, path, key="row_id")
    files = groups.groupBy("path").agg(F.sum("n_rows").alias("file_rows"))
    stored = scans.read_with_labels(spark, path)
    sums = stored.groupBy(F.expr("row_id div 32 * 32").alias("first_row")).agg(*_value_sums())
    return (
        groups.join(files, "path")
        .select(F.col("first_key").alias("first_row"), "n_rows", "file_rows")
        .join(sums, "first_row")
    )


@query
def write_wide_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "wide")
    dense = fx.x_dense(spark, sf_dir)
    names = [f"g{i}" for i in range(fx.n_values(dense))]
    wide = layouts.wide_project(dense, names, "code", keep=["row_id"])
    layouts.write_wide(wide, path, row_group=BATCH, groups_per_file=2)
    rows = scans.row_group_scan(spark, path)
    value = lambda name: F.round(F.col(name).cast("double"), 6).alias(name)
    return rows.select("row_id", "group_id", "pos", value(names[0]), value(names[-1]), F.col("code").cast("int"))


@query
def reshard_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "shuffled")
    rows = fx.stored_rows(spark, sf_dir).drop("shard")
    reshard.reshard_shuffled(rows, path, shard_rows=fx.SHARD_ROWS, rows_per_file=fx.FILE_ROWS, chunk_rows=256)
    return _row_sums(_read_back(spark, path), "shard", "row_id", "source_row_id", "cell_line")


@query
def reshard_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "ordered")
    store = fx.sharded_store(spark, sf_dir)
    rows = scans.concat_scan(spark, store.manifest, fx.COLLECTION, store.schema).drop("shard")
    n_rows = registry.collection_total(store.manifest, fx.COLLECTION, -1).first().n_samples
    reshard.reshard_ordered(rows, path, n_rows=n_rows, shard_rows=fx.SHARD_ROWS // 2, chunk_rows=128)
    return _row_sums(_read_back(spark, path), "shard", "row_id", "cell_line")


@query
def subset_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "subset")
    reshard.subset_rewrite(
        fx.stored_rows(spark, sf_dir), fx.var(spark, sf_dir), fx.gene_list(spark, sf_dir), path
    )
    rows = spark.read.parquet(path)
    return _row_sums(
        rows.withColumn("weighted", _weighted(F.col("indices"), F.col("values"))), "shard", "row_id", "weighted"
    )


@query
def append_loop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "loop_log")
    log = fx.timed_events(spark, sf_dir)
    seconds = F.sum(F.col("seconds").cast("decimal(18,2)")).cast("double").alias("seconds")
    loops = log.groupBy(F.col("tool").alias("name"), "epoch").agg(seconds)
    metrics.append_loop_log(loops.filter(F.col("epoch") < 3), path)
    metrics.append_loop_log(loops.filter(F.col("epoch") >= 3), path)
    return metrics.read_loop_log(spark, path)


@query
def nested_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "results_json")
    metrics.write_nested_results(fx.batch_log(spark, sf_dir), path, segment=TIMED_SEGMENT)
    read = metrics.read_nested_results(spark, path)
    return read.withColumns(
        {"time_per_sample": F.round("time_per_sample", 6), "samples_per_sec": F.round("samples_per_sec", 6)}
    )


@query
def register_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "manifest")
    store = fx.sharded_store(spark, sf_dir)
    rows = registry.shard_manifest(
        fx.stored_rows(spark, sf_dir),
        collection_key=fx.COLLECTION,
        description="orders by part",
        key_prefix="orders",
        root=store.root,
    )
    registry.register_collection(rows, path)
    registry.register_first_shard(spark, path, fx.COLLECTION, f"{fx.COLLECTION}_mini", "first shard")
    return registry.read_manifest(spark, path).drop("path")


@query
def append_result_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workdir.fresh_path(spark, "results")
    store = fx.sharded_store(spark, sf_dir)
    total = registry.collection_total(store.manifest, fx.COLLECTION, -1)
    log = fx.timed_events(spark, sf_dir)
    rates = metrics.throughput(log, ["tool"])
    ends = log.groupBy("tool").agg(F.max("ts").alias("timestamp"))
    rows = rates.join(ends, "tool").select(
        "tool",
        F.lit(fx.COLLECTION).alias("collection"),
        total.select("n_shards").scalar().alias("n_datasets"),
        F.round("samples_per_sec", 6).alias("n_samples_per_sec"),
        F.lit(2_000_000).alias("n_samples_requested"),
        F.col("n_rows").alias("n_samples_loaded"),
        total.select("n_samples").scalar().alias("n_samples_collection"),
        F.lit(4).alias("num_workers"),
        (F.length("tool") % 3 * 512 + 1024).alias("batch_size"),
        F.lit(256).alias("chunk_size"),
        F.lit("unknown").alias("compute_spec"),
        F.concat(F.lit("run-"), "tool").alias("run"),
        "timestamp",
        F.lit("tester").alias("user"),
    )
    registry.append_result_rows(rows, path)
    return registry.read_results(spark, path)


@query
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File counts are exact where files are; bytes depend on the writer, so they are not listed."""
    report = layouts.storage_report(spark, fx.layout_stores(spark, sf_dir))
    exact = F.contains("storage", F.lit("chunk")) | F.col("storage").isin("parquet", "arrow", "polars")
    return report.select("storage", (F.col("size") > 0).alias("sized"), F.when(exact, F.col("n_objects")).alias("n_objects"))


@query
def layout_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.x_dense(spark, sf_dir).select("row_id", "code")
    return layout_study.layout_passes(spark, fx.layout_stores(spark, sf_dir), labels, "code")


# --- slices ----------------------------------------------------------------


@query
def head_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.head_slice(fx.x_coo(spark, sf_dir), 256, 500)


@query
def coord_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.coord_range(fx.x_coo(spark, sf_dir), LAST_VAR)


@query
def value_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.value_filter_eq(
        fx.row_labels(spark, sf_dir), "cell_line", "1-URGENT", ["row_id", "cell_states"]
    )


@query
def axis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = slicing.obs_semi_join(fx.obs(spark, sf_dir), fx.datasets_of(spark, sf_dir, REGION))
    found = slicing.axis_query(cells, fx.x_coo(spark, sf_dir), LAST_VAR)
    return found.select("row_id", "cell_line", "var_id", "value")


# --- joins -----------------------------------------------------------------


@query
def x_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.stored_rows(spark, sf_dir).select("row_id", "indices", "values")
    coded = layouts.label_codes(fx.row_labels(spark, sf_dir), "cell_line")
    return _row_sums(
        batches.x_label_join(x, coded, ["cell_line", "label_code"]),
        "row_id",
        "cell_line",
        F.col("label_code").cast("int").alias("label_code"),
    )


@query
def row_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = ordering.global_order(fx.row_ids(spark, sf_dir)).withColumnRenamed("ord", "pos")
    x = fx.stored_rows(spark, sf_dir).select("row_id", "indices", "values")
    return _row_sums(batches.row_gather(indices, x), "pos", "row_id")


@query
def gene_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = slicing.gene_subset(
        fx.x_coo(spark, sf_dir), fx.var(spark, sf_dir), fx.gene_list(spark, sf_dir)
    )
    return entries.select("row_id", F.col("var_id").cast("bigint").alias("var_id"), "value")


@query
def obs_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.obs_semi_join(fx.obs(spark, sf_dir), fx.datasets_of(spark, sf_dir, REGION)).select(
        "row_id", "cell_line", "cell_states", "dataset_id"
    )


@query
def layout_mode_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = fx.sharded_store(spark, sf_dir).manifest.select("shard_ord", "n_observations")
    return metrics.run_matrix(shards)


# --- aggregations ----------------------------------------------------------


@query
def collection_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.collection_total(fx.sharded_store(spark, sf_dir).manifest, fx.COLLECTION, -1)


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.throughput(fx.timed_events(spark, sf_dir), ["tool"])
    return rates.withColumns(
        {"time_per_sample": F.round("time_per_sample", 6), "samples_per_sec": F.round("samples_per_sec", 6)}
    )


@query
def throughput_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.throughput_epochs(fx.batch_log(spark, sf_dir))
    return rates.withColumns(
        {"time_per_sample": F.round("time_per_sample", 6), "samples_per_sec": F.round("samples_per_sec", 6)}
    )


@query
def assemble_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts.assemble_rows(fx.row_ids(spark, sf_dir), fx.x_coo(spark, sf_dir))
    ends = rows.withColumns(
        {
            "first_var": F.get("indices", F.lit(0)).cast("bigint"),
            "last_var": F.get("indices", F.size("indices") - 1).cast("bigint"),
            "weighted": _weighted(F.col("indices"), F.col("values")),
        }
    )
    return _row_sums(ends, "row_id", "first_var", "last_var", "weighted")


# --- orders ----------------------------------------------------------------


@query
def batch_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.batch_sequential(fx.row_labels(spark, sf_dir).select("row_id", "cell_line"), BATCH)


@query
def global_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.global_permutation(
        fx.row_labels(spark, sf_dir).select("row_id", "cell_line"), BATCH, drop_last=False
    )


@query
def sorted_within_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sorted_within_batch(
        ordering.global_permutation(fx.row_ids(spark, sf_dir), BATCH, drop_last=False)
    )


@query
def block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.block_shuffle(fx.row_ids(spark, sf_dir), BATCH, drop_last=False)


@query
def chunk_window_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.chunk_window_shuffle(fx.row_ids(spark, sf_dir), BATCH, drop_last=False)


@query
def row_group_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.row_group_shuffle(fx.row_ids(spark, sf_dir), BATCH)


@query
def row_group_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.row_group_scan(spark, fx.layout_stores(spark, sf_dir)["parquet_chunk"])
    return rows.select(
        "row_id", "group_id", "pos", F.round(F.col("g0").cast("double"), 6).alias("g0"), F.col("code").cast("int")
    )


@query
def part_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.part_shuffle(fx.row_ids(spark, sf_dir))


@query
def stream_chunk_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = slicing.obs_semi_join(fx.obs(spark, sf_dir), fx.datasets_of(spark, sf_dir, REGION))
    return ordering.stream_chunk_shuffle(cells.select("row_id"), chunk_size=10_000)


@query
def batch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.timed_events(spark, sf_dir).select("tool", "event_id", "ts")
    start = log.agg(F.min("ts")).scalar()
    return metrics.batch_intervals(log, "tool", "event_id", "ts", start).select("tool", "event_id", "interval_us")


@query
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.row_labels(spark, sf_dir).select("row_id", F.nullif("cell_states", F.lit("P")).alias("cell_states"))
    return layouts.label_codes(rows, "cell_states").withColumn("label_code", F.col("label_code").cast("int"))


@query
def shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.row_ids(spark, sf_dir).withColumn(
        "shard", scans.shard_of(F.col("row_id"), fx.SHARD_ROWS)
    )
    manifest = registry.shard_manifest(
        rows, collection_key=fx.COLLECTION, description="orders", key_prefix="orders", root=""
    )
    return scans.shard_offsets(manifest).select("shard_ord", "n_observations", "first_row")


# --- budgets and epochs ----------------------------------------------------


@query
def row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.row_ids(spark, sf_dir)
    plan = ordering.global_permutation(ids, BATCH, drop_last=False)
    return batches.row_budget(plan, 10_000, ids.agg(F.count(F.lit(1))).scalar(), BATCH)


@query
def batch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = ordering.global_permutation(fx.row_ids(spark, sf_dir), BATCH, drop_last=False)
    return batches.batch_budget(plan, 10_000, BATCH)


@query
def drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.row_ids(spark, sf_dir)
    plan = ordering.batch_sequential(ids, BATCH)
    return batches.drop_last(plan, ids.agg(F.count(F.lit(1))).scalar(), BATCH)


@query
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.global_permutation(fx.row_ids(spark, sf_dir), 1024, epochs=5)


# --- scalar functions, layouts, callbacks ----------------------------------


@query
def largest_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", scalars.largest_divisor(F.col("p_partkey"), F.col("p_size").cast("bigint")).alias("divisor")
    )


@query
def effective_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a collection of as many rows as units were ordered of it."""
    units = fx.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("n_collection")
    )
    part = fx.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("preload_nchunks"))
    config = units.join(part, F.col("l_partkey") == F.col("p_partkey"))
    size = scalars.effective_batch(
        F.lit(48), F.col("n_collection"), chunk_size=F.lit(10), preload_nchunks=F.col("preload_nchunks")
    )
    return config.select("p_partkey", "n_collection", size.alias("batch_size"))


@query
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_var = fx.table(spark, sf_dir, "nation").count()
    rows = layouts.assemble_rows(fx.row_ids(spark, sf_dir), fx.x_nation(spark, sf_dir))
    dense = layouts.densify(rows, n_var)
    x = F.col("x")
    return dense.select(
        "row_id",
        F.size(x).cast("bigint").alias("n_values"),
        F.size(F.filter(x, lambda v: v != 0)).cast("bigint").alias("nnz"),
        F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total"),
        _weighted(F.sequence(F.lit(0), F.size(x) - 1), x).alias("weighted"),
    )


@query
def wide_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = fx.x_dense(spark, sf_dir)
    names = [f"g{i}" for i in range(fx.n_values(dense))]
    wide = layouts.wide_project(dense, names, "code", keep=["row_id"])
    return wide.select("row_id", *[F.col(n).cast("double").alias(n) for n in names], F.col("code").cast("int"))


@query
def batch_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.stored_rows(spark, sf_dir).select("row_id", "indices", "values")
    plan = batches.shuffled_batches(rows, BATCH)

    def summarise(batch: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate(batch["values"].to_numpy()).astype(np.float64)
        return pd.DataFrame(
            {
                "batch_id": batch["batch_id"].iloc[:1],
                "n_rows": len(batch),
                "nnz": len(values),
                "total": values.sum(),
                "first_row": batch["row_id"].iloc[:1],
            }
        )

    return batches.batch_callback(
        plan,
        summarise,
        "batch_id bigint, n_rows bigint, nnz bigint, total double, first_row bigint",
        keys=["run", "batch_id"],
    )


@query
def chunk_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    def peak(chunk: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(chunk["x"].to_numpy()) if len(chunk) else np.zeros((0, 1))
        return pd.DataFrame({"row_id": chunk["row_id"], "n_positive": (x > 0).sum(axis=1), "largest": x.max(axis=1)})

    return batches.chunk_callback(
        fx.x_dense(spark, sf_dir).select("row_id", "x"), peak, "row_id bigint, n_positive bigint, largest double"
    )


# --- row sets, indexed reads and keyed orders ------------------------------------


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.obs_semi_join(fx.obs(spark, sf_dir), fx.datasets_of(spark, sf_dir, REGION))


def _entries(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        "row_id", *keep, F.col("var_id").cast("bigint").alias("var_id"), F.col("value").cast("double").alias("value")
    )


@query
def axis_query_row_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-matrix with rows tested where entries are read."""
    found = rowsets.axis_query(_chosen(spark, sf_dir), fx.stored_entries(spark, sf_dir), LAST_VAR)
    return _entries(found, "cell_line")


@query
def obs_semi_join_row_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of the chosen datasets."""
    rows = rowsets.keep_rows(fx.stored_rows(spark, sf_dir), rowsets.row_bitmaps(_chosen(spark, sf_dir)))
    return _row_sums(rows, "row_id", "shard", "cell_line")


@query
def row_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each status, of two of them together and in all, from bitmaps."""
    labels = fx.row_labels(spark, sf_dir)
    sets = {status: rowsets.row_bitmaps(labels.filter(F.col("cell_states") == status)) for status in ("F", "O", "P")}
    sets["F or O"] = rowsets.union_of([sets["F"], sets["O"]])
    sets["all"] = rowsets.union_of([sets["F or O"], sets["P"]])
    named = [bitmaps.withColumn("name", F.lit(name)) for name, bitmaps in sets.items()]
    stacked = named[0]
    for one in named[1:]:
        stacked = stacked.unionByName(one)
    return rowsets.sizes(stacked, "name")


@query
def row_gather_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sparse list in a given order, by the row groups that hold them."""
    urgent = _chosen(spark, sf_dir).filter(F.col("cell_line") == "1-URGENT").select("row_id")
    indices = ordering.global_order(urgent).withColumnRenamed("ord", "pos")
    index = group_index.index_groups(spark, fx.sharded_store(spark, sf_dir).root, ["row_id"])
    return _row_sums(group_index.gather(index, indices, schemas.X_ROW), "pos", "row_id")


@query
def head_slice_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows and variables from the tiles that meet them."""
    table = tiles.tile_table(spark, fx.tile_store(spark, sf_dir))
    return _entries(tiles.read_box(table, (0, 255), (0, 499)))


@query
def coord_range_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of rows and of variables from the tiles that meet it."""
    table = tiles.tile_table(spark, fx.tile_store(spark, sf_dir))
    return _entries(tiles.read_box(table, (2_000, 5_999), (100, LAST_VAR)))


@query
def gene_subset_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the listed variables from the store by variable."""
    index = tiles.column_index(spark, fx.column_store(spark, sf_dir))
    return _entries(tiles.gene_subset(index, fx.var(spark, sf_dir), fx.gene_list(spark, sf_dir)))


@query
def variable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.variable_counts(spark, fx.column_store(spark, sf_dir)).select(
        F.col("var_id").cast("bigint").alias("var_id"), "n_entries", "n_segments"
    )


@query
def keyed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.row_labels(spark, sf_dir).select("row_id", "cell_line")
    return keyed_order.keyed_permutation(labels, BATCH, labels.count(), drop_last=False)


@query
def keyed_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.row_ids(spark, sf_dir)
    return keyed_order.keyed_permutation(ids, 1024, ids.count(), epochs=3)


@query
def loading_run_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of the second half of a run hold, without the first half."""
    store = fx.sharded_store(spark, sf_dir)
    n_rows = registry.collection_total(store.manifest, fx.COLLECTION, -1).first().n_samples
    index = group_index.index_groups(spark, store.root, ["row_id"])
    resumed = loading.resumed_batches(spark, index, schemas.X_ROW, n_rows, BATCH, first_batch=n_rows // BATCH // 2)
    rows = _row_sums(resumed, "batch_id", "row_id", "pos")
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("nnz").alias("nnz"),
        F.sum("total").alias("total"),
        F.sum(F.col("row_id") * F.col("pos")).alias("order_sum"),
    )


@query
def concat_two_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores whose shards have the same folder names, as one matrix."""
    store = fx.sharded_store(spark, sf_dir)
    path = workdir.fresh_path(spark, "second")
    reshard.reshard_shuffled(fx.stored_rows(spark, sf_dir).drop("shard"), path, shard_rows=fx.SHARD_ROWS)
    n_shards = store.manifest.filter(F.col("collection_key") == fx.COLLECTION).count()
    second = registry.shard_manifest(
        spark.read.parquet(path), collection_key=fx.COLLECTION, description="shuffled", key_prefix="second", root=path
    )
    both = store.manifest.unionByName(second.withColumn("shard_ord", F.col("shard_ord") + n_shards))
    return _row_sums(scans.concat_scan(spark, both, fx.COLLECTION, store.schema), "row_id", "shard", "cell_line")


@query
def growing_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled store after two more appends and a compaction, in the order of a full shuffle."""
    rows = fx.stored_rows(spark, sf_dir)
    store = growing.GrowingStore(spark, workdir.fresh_path(spark, "growing"), digits=1)
    first, last = rows.agg(F.min("shard"), F.max("shard")).first()
    for own in (F.col("shard") == first, (F.col("shard") > first) & (F.col("shard") < last), (F.col("shard") == last) & (last > first)):
        store.append(rows.filter(own).drop("shard"))
    store.compact(max_runs=2)
    return _row_sums(store.ordered(), "ord", "row_id", "cell_line")


@query
def sized_part_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of equal bytes of the sparse rows."""
    rows = fx.stored_rows(spark, sf_dir)
    sized = rows.select("row_id", ordering.sparse_row_bytes(F.size("indices")).alias("bytes"))
    return ordering.sized_part_shuffle(sized, part_bytes=PART_BYTES).drop("bytes")


@query
def shard_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the variables that each shard has entries of, in the order of their ids."""
    seen = fx.stored_rows(spark, sf_dir).select("shard", F.explode("indices").alias("var_id")).distinct()
    named = grouped_positions(seen, ["shard"], "var_id").join(fx.var(spark, sf_dir), "var_id")
    digests = scans.sequence_digests(named.withColumnRenamed("ord", "var_ord"))
    return digests.select("shard", "n_var", F.col("digest").cast("string").alias("digest"))
