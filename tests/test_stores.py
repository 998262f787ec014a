"""Layouts, writers, scans and the manifest, read back from what was written."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import schemas, workdir
from rowloom.operators import layouts, reshard, slicing
from rowloom.plans import fixtures as fx
from rowloom.sources import registry, scans


@pytest.fixture()
def matrix(spark):
    """40 rows x 9 variables; row 0 and 7 are empty."""
    rng = np.random.default_rng(3)
    entries = [
        (r, v, float(rng.integers(1, 50)))
        for r in range(40)
        for v in sorted(rng.choice(9, rng.integers(1, 6), replace=False).tolist())
        if r not in (0, 7)
    ]
    obs = spark.createDataFrame([(r, "abc"[r % 3]) for r in range(40)], "row_id bigint, cell_line string")
    coo = spark.createDataFrame(entries, "row_id bigint, var_id int, value float").repartition(4)
    var = spark.createDataFrame([(v, f"g{v}") for v in range(9)], "var_id int, var_name string")
    return obs, var, coo, entries


def entries_of(df):
    return sorted((r.row_id, r.var_id, r.value) for r in df.select("row_id", "var_id", "value").collect())


def dense_of(entries, n_rows=40, n_var=9):
    x = np.zeros((n_rows, n_var), dtype="float32")
    for r, v, value in entries:
        x[r, v] = value
    return x


def groups_on_disk(path):
    """Row ids of every row group, per file."""
    files = []
    for name in sorted(glob.glob(f"{path}/**/*.parquet", recursive=True)):
        f = pq.ParquetFile(name)
        files.append([f.read_row_group(g, columns=["row_id"])["row_id"].to_pylist() for g in range(f.num_row_groups)])
    return sorted(files)


def test_layouts_round_trip(spark, matrix):
    obs, _, coo, entries = matrix
    rows = layouts.assemble_rows(obs, coo)
    assert rows.count() == 40
    empty = {r.row_id for r in rows.collect() if r.indices == [] and r["values"] == []}
    assert empty == {0, 7}
    assert all(r.indices == sorted(r.indices) for r in rows.collect())
    assert entries_of(layouts.explode_rows(rows)) == sorted(entries)

    dense = layouts.densify(rows, 9)
    want = dense_of(entries)
    for r in dense.collect():
        assert np.array_equal(np.array(r.x, dtype="float32"), want[r.row_id])
    assert entries_of(layouts.sparsify(dense)) == sorted(entries)

    names = [f"g{v}" for v in range(9)]
    wide = layouts.wide_project(dense.join(obs, "row_id"), names, "cell_line", keep=["row_id"])
    split = scans.wide_scan_split(wide.drop("row_id"))
    got = sorted((tuple(r.x), r.label) for r in split.collect())
    assert got == sorted((tuple(map(float, want[r])), "abc"[r % 3]) for r in range(40))


def test_duplicate_entries_are_summed(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 2, 4.0), (1, 3, 1.0)], "row_id bigint, var_id int, value float")
    assert entries_of(layouts.sum_duplicates(df)) == [(1, 2, 7.0), (1, 3, 1.0)]


def test_densify_slices_by_cells(spark, matrix, monkeypatch):
    obs, _, coo, entries = matrix
    monkeypatch.setattr(layouts, "DENSE_BATCH_CELLS", 20)
    want = dense_of(entries)
    for r in layouts.densify(layouts.assemble_rows(obs, coo).join(obs, "row_id"), 9).collect():
        assert np.array_equal(np.array(r.x, dtype="float32"), want[r.row_id])
        assert r.cell_line == "abc"[r.row_id % 3]


def test_densify_refuses_indices_beyond_the_axis(spark, matrix):
    obs, _, coo, _ = matrix
    with pytest.raises(Exception, match="outside 0..3"):
        layouts.densify(layouts.assemble_rows(obs, coo), 4).collect()


def test_exact_chunks(spark):
    path = workdir.fresh_path(spark, "dense_exact")
    x = spark.range(500).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("float")).alias("x"))
    layouts.write_dense_chunked(x.repartition(7), path, batch=32, batches_per_file=4)
    files = groups_on_disk(path)
    assert [len(g) for f in files for g in f] == [32] * 15 + [20]
    assert [i for f in files for g in f for i in g] == list(range(500))
    assert [sum(map(len, f)) for f in files] == [128, 128, 128, 116]


def test_two_level_chunks_and_their_labels(spark):
    path = workdir.fresh_path(spark, "dense_two_level")
    x = spark.range(500).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    labels = x.select("row_id", (F.col("row_id") % 5 - 1).alias("code"))
    layouts.write_two_level_chunks(x, labels, path, label_outer=200, label_inner=50, chunks_per_file=1)
    files = groups_on_disk(path)
    assert [[len(g) for g in f] for f in files] == [[32] * 4] * 3 + [[32, 32, 32, 20]]
    assert [[len(g) for g in f] for f in groups_on_disk(layouts.label_path(path))] == [[50] * 4, [50] * 4, [50] * 2]
    stored = scans.read_with_labels(spark, path)
    assert dict(stored.dtypes) == {"row_id": "bigint", "x": "array<float>", "code": "tinyint"}
    assert sorted((r.row_id, r.code) for r in stored.collect()) == [(i, i % 5 - 1) for i in range(500)]
    report = layouts.row_groups(spark, path, key="row_id")
    assert sorted((r.first_key, r.n_rows) for r in report.collect()) == [
        (i, min(32, 128 - i % 128, 500 - i)) for f in files for g in f for i in g[:1]
    ]


def test_wide_row_groups(spark):
    path = workdir.fresh_path(spark, "wide_groups")
    x = spark.range(100).select(
        F.col("id").alias("row_id"), F.array(F.col("id").cast("float"), F.lit(1.0)).alias("x"), F.lit("a").alias("label")
    )
    wide = layouts.wide_project(x, ["g0", "g1"], "label", keep=["row_id"])
    layouts.write_wide(wide, path, row_group=32)
    names = sorted(glob.glob(f"{path}/*.parquet"))
    footers = [pq.ParquetFile(n).metadata for n in names]
    assert sorted(f.row_group(g).num_rows for f in footers for g in range(f.num_row_groups)) == [4, 32, 32, 32]
    assert all(f.row_group(0).column(0).compression == "UNCOMPRESSED" for f in footers)
    assert pq.read_schema(names[0]).names == ["g0", "g1", "label"]
    with pytest.raises(ValueError, match="dense array layout"):
        layouts.wide_project(x, [f"g{i}" for i in range(5001)], "label")


def test_label_codes(spark):
    obs = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "row_id bigint, s string")
    coded = layouts.label_codes(obs, "s")
    assert dict(coded.dtypes)["label_code"] == "int"
    assert sorted((r.row_id, r.label_code) for r in coded.collect()) == [(1, 1), (2, -1), (3, 0), (4, 1)]


def test_too_many_categories_for_the_type_fail_and_a_wider_type_holds_them(spark):
    obs = spark.range(200).select(F.col("id").alias("row_id"), F.format_string("c%04d", "id").alias("s"))
    with pytest.raises(Exception, match="too many categories"):
        layouts.label_codes(obs, "s", "tinyint").collect()
    for code_type in ("smallint", "int"):
        coded = layouts.label_codes(obs.repartition(6), "s", code_type)
        assert dict(coded.dtypes)["label_code"] == code_type
        assert {r.row_id: r.label_code for r in coded.collect()} == {i: i for i in range(200)}
    exact = obs.filter("row_id < 128")
    assert layouts.label_codes(exact, "s", "tinyint").agg(F.max("label_code")).first()[0] == 127


def test_storage_report(spark):
    path = workdir.fresh_path(spark, "sized")
    spark.range(100).repartition(3).write.partitionBy().parquet(path)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/*.parquet")]
    report = {r.storage: (r.size, r.n_objects) for r in layouts.storage_report(spark, {"a": path, "b": path}).collect()}
    assert report == {"a": (sum(sizes) / 1024**3, len(sizes)), "b": (sum(sizes) / 1024**3, len(sizes))}


# --- shards ----------------------------------------------------------------


@pytest.fixture()
def store(spark, matrix):
    """The matrix in shards of 16 rows, registered."""
    obs, var, coo, entries = matrix
    root = workdir.fresh_path(spark, "store")
    rows = layouts.assemble_rows(obs, coo).join(obs, "row_id")
    reshard.reshard_ordered(rows, root, shard_rows=16, rows_per_file=16)
    manifest_path = workdir.fresh_path(spark, "manifest")
    stored = spark.read.parquet(root)
    registry.register_collection(
        registry.shard_manifest(stored, collection_key="m", description="d", key_prefix="k", root=root), manifest_path
    )
    schema = stored.drop("shard").schema
    return root, registry.read_manifest(spark, manifest_path), schema, manifest_path, var, entries


def test_collection_of_shards(spark, store):
    root, manifest, schema, path, _, _ = store
    listed = [(r.shard_ord, r.shard_key, r.path, r.n_observations) for r in manifest.orderBy("shard_ord").collect()]
    assert listed == [(i, f"k/shard_{i}", f"{root}/shard={i}", n) for i, n in enumerate([16, 16, 8])]
    for n, want in ((1, 16), (2, 32), (99, 40), (-1, 40)):
        assert registry.collection_scan(spark, manifest, "m", schema, n).count() == want
        assert registry.collection_total(manifest, "m", n).first().n_samples == want
    assert registry.collection_total(manifest, "m", 2).first().n_shards == 2
    with pytest.raises(LookupError):
        registry.collection_scan(spark, manifest, "other", schema)
    registry.register_first_shard(spark, path, "m", "m_mini", "first")
    again = registry.read_manifest(spark, path)
    assert registry.collection_scan(spark, again, "m_mini", schema, -1).count() == 16
    offsets = {r.shard_ord: r.first_row for r in scans.shard_offsets(manifest).collect()}
    assert offsets == {0: 0, 1: 16, 2: 32}


def test_concat_numbers_rows_across_shards(spark, store):
    root, manifest, schema, *_ = store
    whole = scans.concat_scan(spark, manifest, "m", schema)
    labels = {r.row_id: r.cell_line for r in whole.select("row_id", "cell_line").collect()}
    assert labels == {i: "abc"[i % 3] for i in range(40)}
    assert scans.concat_scan(spark, manifest, "m", schema, 2).agg(F.max("row_id")).first()[0] == 31
    wrong = manifest.withColumn("n_observations", F.col("n_observations") + (F.col("shard_ord") == 1).cast("int"))
    with pytest.raises(ValueError, match="manifest in shard=1: 16 stored, 17 registered"):
        scans.concat_scan(spark, wrong, "m", schema)
    empty = workdir.fresh_path(spark, "other") + "/shard=3"
    spark.range(0).select(F.col("id").alias("row_id")).write.parquet(empty)
    gone = manifest.union(
        manifest.filter("shard_ord = 2").withColumns({"shard_ord": F.lit(3), "path": F.lit(empty)})
    )
    with pytest.raises(ValueError, match="manifest in shard=3: 0 stored, 8 registered"):
        scans.concat_scan(spark, gone, "m", schema)


def test_numbered_shards(spark, store):
    root, _, schema, *_ = store
    assert scans.numbered_shard_scan(spark, root, 2, schema).count() == 32
    for n in (0, 49):
        with pytest.raises(ValueError, match="between 1 and 48"):
            scans.numbered_shard_scan(spark, root, n, schema)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        scans.numbered_shard_scan(spark, root, 4, schema).collect()


def test_uid_list_order_and_strictness(spark, store):
    _, manifest, *_ = store
    got = registry.uid_list_scan(spark, manifest, ["k/shard_2", "k/shard_0"]).collect()
    assert [(r.list_ord, r.shard_ord) for r in got] == [(0, 2), (1, 0)]
    with pytest.raises(Exception, match="not one shard: k/shard_9"):
        registry.uid_list_scan(spark, manifest, ["k/shard_9"]).collect()
    with pytest.raises(Exception, match="not one shard"):
        registry.uid_list_scan(spark, manifest.union(manifest), ["k/shard_0"]).collect()


def test_unique_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, key string")
    assert registry.unique_lookup(df, F.col("key") == "a").collect() == [(1, "a")]
    with pytest.raises(Exception, match="exactly one record"):
        registry.unique_lookup(df, F.col("key") == "b").collect()
    with pytest.raises(Exception, match="exactly one record"):
        registry.unique_lookup(df, F.col("key") == "z").collect()
    assert registry.unique_lookup(df, F.col("key") == "z", required=False).collect() == []
    with pytest.raises(Exception, match="exactly one record"):
        registry.unique_lookup(df, F.col("key") == "b", required=False).collect()


def test_shuffled_shards_are_exact(spark, store):
    root, manifest, schema, *_ = store
    rows = scans.concat_scan(spark, manifest, "m", schema).drop("shard")
    path = workdir.fresh_path(spark, "shuffled_exact")
    reshard.reshard_shuffled(rows, path, shard_rows=16, rows_per_file=8, chunk_rows=4)
    out = spark.read.parquet(path)
    assert sorted(r.row_id for r in out.collect()) == list(range(40))
    assert sorted(r.source_row_id for r in out.collect()) == list(range(40))
    assert all(r.shard == r.row_id // 16 for r in out.collect())
    before = {r.row_id: r for r in rows.collect()}
    for r in out.collect():
        old = before[r.source_row_id]
        assert (r.indices, r["values"], r.cell_line) == (old.indices, old["values"], old.cell_line)
    files = groups_on_disk(path)
    assert files == [[list(range(a, a + 4)), list(range(a + 4, a + 8))] for a in range(0, 40, 8)]
    with pytest.raises(ValueError, match="divide"):
        reshard.reshard_shuffled(rows, path, shard_rows=16, rows_per_file=5)


def test_dense_shards(spark, store):
    root, manifest, schema, _, _, entries = store
    rows = scans.concat_scan(spark, manifest, "m", schema).drop("shard")
    want = dense_of(entries)
    path = workdir.fresh_path(spark, "dense_shards")
    reshard.reshard_shuffled(rows, path, shard_rows=16, n_var=9)
    for r in spark.read.parquet(path).collect():
        assert np.array_equal(np.array(r.x, dtype="float32"), want[r.source_row_id])


def test_subset_rewrite_keeps_rows_numbers_and_list_order(spark, store):
    root, manifest, schema, _, var, entries = store
    genes = spark.createDataFrame([(0, "g7"), (1, "g2"), (2, "g5")], "gene_ord int, var_name string")
    path = workdir.fresh_path(spark, "subset")
    reshard.subset_rewrite(spark.read.parquet(root), var, genes, path)
    out = spark.read.parquet(path)
    assert sorted((r.row_id, r.shard) for r in out.collect()) == [(i, i // 16) for i in range(40)]
    place = {7: 0, 2: 1, 5: 2}
    want = sorted((r, place[v], value) for r, v, value in entries if v in place)
    assert entries_of(layouts.explode_rows(out)) == want
    assert all(r.indices == sorted(r.indices) for r in out.collect())
    part = glob.glob(f"{path}/shard=0/*.parquet")[0]
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "GZIP"


def test_gene_subset_is_strict(spark, matrix):
    _, var, coo, entries = matrix
    genes = spark.createDataFrame([(0, "g3"), (1, "g999999999")], "gene_ord int, var_name string")
    with pytest.raises(KeyError, match="g999999999"):
        slicing.gene_subset(coo, var, genes)
    doubled = var.withColumn("var_name", F.when(F.col("var_id") < 2, F.lit("same")).otherwise(F.col("var_name")))
    with pytest.raises(ValueError, match="not unique: same"):
        slicing.gene_subset(coo, doubled, spark.createDataFrame([(0, "same")], "gene_ord int, var_name string"))


def test_gene_lists_that_do_not_fit_the_lookup(spark, matrix, monkeypatch):
    obs, var, coo, entries = matrix
    rows = layouts.assemble_rows(obs, coo)
    repeated = spark.createDataFrame([(0, "g3"), (1, "g1"), (2, "g3")], "gene_ord int, var_name string")
    want = sorted((r, p, x) for r, v, x in entries for p in {3: (0, 2), 1: (1,)}.get(v, ()))
    assert entries_of(layouts.explode_rows(slicing.gene_subset_rows(rows, var, repeated))) == want
    once = repeated.filter("gene_ord < 2")
    short = slicing.gene_subset_rows(rows, var, once)
    monkeypatch.setattr(slicing, "MAX_BROADCAST_GENES", 1)
    long = slicing.gene_subset_rows(rows, var, once)
    assert entries_of(layouts.explode_rows(short)) == entries_of(layouts.explode_rows(long))
    assert short.count() == long.count() == 40


def test_head_slice_in_every_layout(spark, matrix):
    obs, _, coo, entries = matrix
    rows = layouts.assemble_rows(obs, coo)
    want = sorted(e for e in entries if e[0] < 10 and e[1] < 4)
    assert entries_of(slicing.head_slice(coo, 10, 4)) == want
    assert entries_of(layouts.explode_rows(slicing.head_slice(rows, 10, 4))) == want
    dense = slicing.head_slice(layouts.densify(rows, 9), 10, 4)
    assert {len(r.x) for r in dense.collect()} == {4}
    assert entries_of(layouts.sparsify(dense)) == want
    assert entries_of(slicing.head_slice(coo, None, 4)) == sorted(e for e in entries if e[1] < 4)


def test_coordinate_range_includes_its_end(spark, matrix):
    _, _, coo, entries = matrix
    assert entries_of(slicing.coord_range(coo, 4, first=2)) == sorted(e for e in entries if 2 <= e[1] <= 4)


def test_axis_query_keeps_rows_without_counts(spark, matrix):
    obs, _, coo, entries = matrix
    found = slicing.axis_query(obs, coo, 3)
    assert {r.row_id for r in found.collect()} == set(range(40))
    assert entries_of(found.filter("var_id is not null")) == sorted(e for e in entries if e[1] <= 3)


def test_concat_of_different_variables_fails(spark):
    x = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("shard"))
    lists = [(s, i, f"g{i}") for s, n in ((0, 64), (1, 63)) for i in range(n)]
    var = spark.createDataFrame(lists, "shard int, var_ord int, var_name string")
    with pytest.raises(ValueError, match="g63 at 63"):
        scans.checked_concat(x, var)
    assert scans.checked_concat(x, var.filter("var_ord < 63")).count() == 10
    swapped = var.filter("var_ord < 63").withColumn(
        "var_ord", F.when(F.col("shard") == 1, 62 - F.col("var_ord")).otherwise(F.col("var_ord"))
    )
    with pytest.raises(ValueError, match="different variables"):
        scans.checked_concat(x, swapped)


def test_concat_shards(spark):
    frames = [spark.range(a, b) for a, b in ((0, 3), (3, 5))]
    assert sorted(tuple(r) for r in scans.concat_shards(frames).collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_list_length_is_checked(spark):
    path = workdir.fresh_path(spark, "lists")
    df = spark.createDataFrame([(0, [0.0] * 64), (1, [0.0] * 63)], "row_id bigint, x array<float>")
    df.write.parquet(path)
    with pytest.raises(Exception, match="list of 64 values expected, found 63"):
        scans.list_column_scan(spark, path, 64).select("row_id").collect()
    with pytest.raises(ValueError, match="20000"):
        scans.list_column_scan(spark, path, 20_001)


def test_suffix_scan_leaves_other_files(spark):
    root = workdir.fresh_path(spark, "suffix")
    df = spark.createDataFrame([(0, [1.0])], "row_id bigint, x array<float>")
    df.write.parquet(f"{root}/a")
    df.write.parquet(f"{root}/b/c")
    df.write.json(f"{root}/d")
    assert scans.dir_suffix_scan(spark, root, ".parquet", schemas.X_DENSE).count() == 2


def test_row_table_columns(spark, store):
    root, *_ = store
    assert scans.obs_columns(spark, root, ["cell_line"]).columns == ["row_id", "cell_line"]
    assert scans.obs_columns(spark, root, ["cell_line"], include_obs=False).columns == ["row_id"]
    with pytest.raises(ValueError, match="no such row column"):
        scans.obs_columns(spark, root, ["nope"])


def test_layers(spark):
    x = spark.createDataFrame(
        [("RNA", "raw", 1), ("RNA", "data", 2), ("ATAC", "raw", 3)], "measurement string, layer string, row_id int"
    )
    assert [r.row_id for r in scans.layer_select(x).collect()] == [1]
    assert [r.row_id for r in scans.drop_layer(x).collect()] == [2]


def test_bucketed_tables_join_in_place(spark):
    left = spark.range(100).select(F.col("id").alias("row_id"), F.lit(1).alias("x"))
    right = left.select("row_id", F.lit("a").alias("label"))
    for name, df in (("bucketed_x", left), ("bucketed_obs", right)):
        layouts.save_bucketed(df, name, workdir.fresh_path(spark, name), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_x").join(spark.table("bucketed_obs"), "row_id")
        assert joined.count() == 100
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_x", "bucketed_obs"):
            spark.sql(f"drop table {name}")


# --- written once ----------------------------------------------------------


def test_half_written_store_is_written_again(spark):
    path = workdir.fresh_path(spark, "once")
    write = lambda p: spark.range(10).write.mode("overwrite").parquet(p)
    assert workdir.write_if_absent(spark, path, write, expected_rows=10)
    assert not workdir.write_if_absent(spark, path, write, expected_rows=10)
    # A store with another number of rows, and a directory without a commit marker, are not complete.
    assert workdir.write_if_absent(spark, path, write, expected_rows=11)
    os.remove(f"{path}/_SUCCESS")
    assert workdir.write_if_absent(spark, path, write, expected_rows=10)
    assert spark.read.parquet(path).count() == 10


def test_results_sheet_is_typed_and_appends(spark):
    path = workdir.fresh_path(spark, "sheet")
    row = {f.name: "1" for f in schemas.RESULTS if f.name != "timestamp"}
    df = spark.createDataFrame([{**row, "timestamp": "2024-01-02 03:04:05"}])
    registry.append_result_rows(df, path)
    registry.append_result_rows(df, path)
    sheet = registry.read_results(spark, path)
    assert sheet.count() == 2
    assert sheet.schema == schemas.RESULTS
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        registry.append_result_rows(df.withColumn("batch_size", F.lit("many")), path)


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert workdir.shared_dir(spark) == named.rstrip("/")
    assert workdir.fresh_path(spark, "a") != workdir.fresh_path(spark, "a")
    assert workdir.app_path(spark, "a") == workdir.app_path(spark, "a")


@pytest.mark.parametrize("partitions", [1, 8, 50])
@pytest.mark.parametrize("coalescing", ["true", "false"])
def test_row_ids_of_shards_of_many_files(spark, partitions, coalescing):
    """Ids read back are those stored, however rows were spread and files are named."""
    rows = spark.range(2000).select(
        F.col("id").alias("row_id"),
        F.array(F.col("id").cast("int")).alias("indices"),
        F.array(F.lit(1.0).cast("float")).alias("values"),
    )
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalescing)
    try:
        for write, place in ((reshard.reshard_shuffled, "source_row_id"), (reshard.reshard_ordered, "row_id")):
            path = workdir.fresh_path(spark, "many-files")
            write(rows.repartition(partitions), path, shard_rows=512, rows_per_file=64, chunk_rows=16)
            assert len(glob.glob(f"{path}/shard=0/*.parquet")) == 8
            stored = spark.read.parquet(path)
            manifest = registry.shard_manifest(stored, collection_key="m", description="", key_prefix="m", root=path)
            schema = T.StructType([f for f in stored.schema.fields if f.name != "shard"])
            want = {r[place]: (r.row_id, r.shard) for r in stored.collect()}
            got = scans.concat_scan(spark, manifest, "m", schema).collect()
            assert {r.indices[0]: (r.row_id, r.shard) for r in got} == want
            assert len(got) == 2000
            assert "Exchange" not in scans.concat_scan(spark, manifest, "m", schema)._jdf.queryExecution().executedPlan().toString().replace(
                "BroadcastExchange", ""
            )
        path = workdir.fresh_path(spark, "many-wide")
        wide = rows.select("row_id", F.col("row_id").cast("float").alias("g0"), F.lit(1).alias("label"))
        layouts.write_wide(wide.repartition(partitions), path, row_group=16, groups_per_file=4)
        placed = scans.row_group_scan(spark, path).collect()
        assert all(r.g0 == r.row_id and (r.group_id, r.pos) == divmod(r.row_id, 16) for r in placed) and len(placed) == 2000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_exact_files_refuse_ids_with_gaps(spark):
    x = spark.range(100).select((F.col("id") * 2).alias("row_id"), F.array(F.lit(1.0)).alias("x"), F.lit(1).alias("code"))
    with pytest.raises(ValueError, match="row ids must be 0..n-1"):
        layouts.write_dense_chunked(x, workdir.fresh_path(spark, "gaps"))


def test_index_outside_the_variables_fails(spark):
    var = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "var_id int, var_name string")
    genes = spark.createDataFrame([(0, "g1")], "gene_ord int, var_name string")
    rows = spark.createDataFrame([(0, [1, 3], [1.0, 2.0])], "row_id bigint, indices array<int>, values array<float>")
    with pytest.raises(Exception, match="variable index outside"):
        slicing.gene_subset_rows(rows, var, genes).collect()


def test_clear_removes_what_was_written(spark):
    path = workdir.fresh_path(spark, "cleared")
    spark.range(3).write.parquet(path)
    assert workdir.path_exists(spark, path) and not workdir.path_exists(spark, f"{path}-none")


def _lists(spark, lists):
    rows = [(shard, place, name) for shard, names in lists.items() for place, name in names]
    return spark.createDataFrame(rows, "shard int, var_ord int, var_name string")


def test_checked_concat_tells_lists_of_equal_length_apart_and_moves_no_line_of_each(spark, monkeypatch):
    x = spark.range(10)
    names = [(i, f"g{i}") for i in range(200)]
    twice = [*names[:199], names[0]]
    moved = []
    frame = type(x)
    distinct = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda self: moved.append(self.columns) or distinct(self))
    assert scans.checked_concat(x, _lists(spark, {0: names, 1: names[::-1], 2: [*names, names[7]]})).count() == 10
    assert not [columns for columns in moved if "shard" in columns]
    without = [line for line in names if line[0] != 64]
    for other in (twice, without, [*names, (200, "g200")], [*names[:9], (9, None), *names[10:]], [*names, (None, "g0")]):
        with pytest.raises(ValueError, match="shards have different variables"):
            scans.checked_concat(x, _lists(spark, {0: names, 1: names, 2: other}))


def test_checked_concat_of_lists_with_nulls_and_several_names_at_a_place(spark):
    odd = [(0, "a"), (0, "b"), (1, None), (None, "c"), (None, None), (-5, "d")]
    assert scans.checked_concat(spark.range(3), _lists(spark, {4: odd, 9: odd[::-1]})).count() == 3
    with pytest.raises(ValueError, match="shards have different variables"):
        scans.checked_concat(spark.range(3), _lists(spark, {4: odd, 9: odd[:5]}))
    assert scans.checked_concat(spark.range(3), _lists(spark, {}).filter("shard = 1")).count() == 3


def test_every_shard_has_the_whole_list_stored(spark, tmp_path):
    names = spark.range(0, 1_000, 1, 3).selectExpr("cast(999 - id as int) as var_ord", "concat('g', id) as var_name")
    fx.write_shard_lists(names, 70, f"file://{tmp_path}/lists")
    got = spark.read.parquet(f"file://{tmp_path}/lists")
    assert got.dtypes == [("var_ord", "int"), ("var_name", "string"), ("shard", "int")]
    want = names.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(69))))
    assert got.count() == 70_000 and got.exceptAll(want.select(got.columns)).count() == 0


def test_subset_of_a_long_axis_stays_in_its_files(spark, store, monkeypatch):
    root, _, _, _, var, entries = store
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        for names, limits in ((("g7", "g2", "g5"), {"MAX_BROADCAST_GENES": 1}), (("g7", "g2", "g7"), {}), (("g7", "g2"), {"MAX_LOOKUP_IDS": 1})):
            for name, value in limits.items():
                monkeypatch.setattr(slicing, name, value)
            genes = spark.createDataFrame(list(enumerate(names)), "gene_ord int, var_name string")
            path = workdir.fresh_path(spark, "subset_long")
            reshard.subset_rewrite(spark.read.parquet(root), var, genes, path, rows_per_file=16)
            out = spark.read.parquet(path)
            assert out.columns == spark.read.parquet(root).columns
            want = sorted((r, p, x) for r, v, x in entries for p, name in enumerate(names) if name == f"g{v}")
            assert entries_of(layouts.explode_rows(out)) == want
            assert sorted((r.row_id, r.shard) for r in out.collect()) == [(i, i // 16) for i in range(40)]
            assert all(r.indices == sorted(r.indices) for r in out.collect())
            assert len(glob.glob(f"{path}/*/*.parquet")) <= len(glob.glob(f"{root}/*/*.parquet"))
            monkeypatch.undo()
    finally:
        spark.conf.unset(setting)


def test_long_axis_with_gaps_and_null_rows(spark, monkeypatch):
    monkeypatch.setattr(slicing, "MAX_BROADCAST_GENES", 1)
    var = spark.createDataFrame([(3, "a"), (70_000, "b"), (200_000, "c")], "var_id int, var_name string")
    genes = spark.createDataFrame([(0, "c"), (1, "a")], "gene_ord int, var_name string")
    kind = "row_id bigint, indices array<int>, values array<float>, cell_line string"
    rows = [(0, [3, 70_000, 200_000], [1.0, 2.0, 3.0], "x"), (1, [], [], None), (2, None, None, "y"), (3, [200_000, 3, 3], [1.0, 5.0, 4.0], "z")]
    got = slicing.gene_subset_rows(spark.createDataFrame(rows, kind), var, genes)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.row_id, r.indices, r["values"], r.cell_line) for r in got.collect()) == [
        (0, [0, 1], [3.0, 1.0], "x"),
        (1, [], [], None),
        (2, None, None, "y"),
        (3, [0, 1, 1], [1.0, 4.0, 5.0], "z"),
    ]
    for bad in ([3, 4], [-1], [200_001], [None]):
        outside = spark.createDataFrame([(0, bad, [1.0] * len(bad), "x")], kind)
        with pytest.raises(Exception, match="variable index outside"):
            slicing.gene_subset_rows(outside, var, genes).collect()


def test_listing_of_stores_uses_few_tasks_and_leaves_the_setting(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with workdir.few_listing_tasks(spark):
        assert int(spark.conf.get(name)) == max(32, 4 * spark.sparkContext.defaultParallelism)
    assert spark.conf.get(name) == before
