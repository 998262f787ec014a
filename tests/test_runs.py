"""End-to-end jobs: loading runs, preparation of collections, the layout study."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rowloom import workdir
from rowloom.operators import layouts, metrics, ordering
from rowloom.plans import fixtures, layout_study, loading, preparation
from rowloom.sources import registry, scans


@pytest.fixture(scope="module")
def store(spark, sf_dir):
    return fixtures.sharded_store(spark, sf_dir)


def run_of(spark, store, method, **options):
    options = {"n_datasets": -1, "n_samples": -1, **options}
    return loading.loading_run(spark, store.manifest, fixtures.COLLECTION, store.schema, method, **options)


@pytest.mark.parametrize("method", ["permutation", "block", "chunk_window"])
def test_loading_run_gives_whole_batches_of_distinct_rows(spark, store, method):
    run = run_of(spark, store, method, batch_size=64)
    rows = run.batches.select("batch_id", "pos", "row_id", "cell_line").collect()
    assert len(rows) == run.n_batches * 64 == 1500 // 64 * 64
    assert sorted((r.batch_id, r.pos) for r in rows) == [(b, p) for b in range(run.n_batches) for p in range(64)]
    assert len({r.row_id for r in rows}) == len(rows)
    assert run.n_collection == 1500 and run.n_samples == 1500


def test_run_sizes(spark, store):
    assert run_of(spark, store, "permutation").batch_size == 150
    # 150 does not divide a window of 256 x 8 rows.
    assert run_of(spark, store, "chunk_window").batch_size == 128
    short = run_of(spark, store, "block", batch_size=64, n_samples=200)
    assert short.n_batches == 3 and short.batches.count() == 192
    bare = run_of(spark, store, "permutation", include_obs=False)
    assert "cell_line" not in bare.batches.columns and "indices" in bare.batches.columns
    assert run_of(spark, store, "block", n_datasets=1).n_datasets == 1


def test_run_refuses_unknown_names(spark, store):
    with pytest.raises(ValueError, match="method must be"):
        run_of(spark, store, "other")
    with pytest.raises(LookupError):
        loading.loading_run(spark, store.manifest, "nothing", store.schema, "block")


def test_recorded_run_is_in_the_sheet(spark, store):
    path = workdir.fresh_path(spark, "sheet")
    run = run_of(spark, store, "chunk_window")
    loading.record_run(spark, run, path, run_id="r1", user="u")
    sheet = registry.read_results(spark, path).collect()
    assert len(sheet) == 1
    row = sheet[0]
    assert (row.tool, row.batch_size, row.n_samples_collection) == ("chunk_window", 128, 1500)
    assert row.n_samples_loaded == 1500 // 128 * 128 and row.n_samples_requested == 1500
    assert row.n_samples_per_sec > 0


def test_preparation_keeps_complete_stores(spark, sf_dir, store):
    out = workdir.fresh_path(spark, "prepared")
    keys = [r.shard_key for r in store.manifest.collect()]

    def prepare():
        return preparation.prepare_collections(
            spark,
            store.manifest,
            keys,
            store.schema,
            fixtures.var(spark, sf_dir),
            fixtures.gene_list(spark, sf_dir),
            out,
            name="p",
            shard_rows=512,
            rows_per_file=256,
            relayout_chunk=64,
        )

    first = sorted(map(tuple, prepare().collect()))
    files = {name: set(spark.read.parquet(f"{out}/{name}").inputFiles()) for name in ("p_sharded", "p_chunked")}
    assert sorted(map(tuple, prepare().collect())) == first
    assert files == {name: set(spark.read.parquet(f"{out}/{name}").inputFiles()) for name in files}
    counts = {}
    for key, _, shard, _, _, n in first:
        counts.setdefault(key, []).append((shard, n))
    whole = [(0, 512), (1, 512), (2, 476)]
    assert {k: sorted(v) for k, v in counts.items()} == {
        "p_sharded": whole,
        "p_sharded_subset": whole,
        "p_chunked": whole,
        "p_chunked_mini": whole[:1],
    }


def test_row_groups_of_any_size(spark):
    path = workdir.fresh_path(spark, "uneven")
    for size in (7, 10):
        rows = spark.range(25).select(F.col("id").cast("double").alias("g0")).coalesce(1)
        rows.write.mode("append").option(layouts.ROW_GROUP_ROWS, size).parquet(path)
    scan = scans.row_group_scan(spark, path)
    got = scan.collect()
    assert sorted(r.row_id for r in got) == list(range(50))
    sizes = {}
    for r in got:
        sizes.setdefault(r.group_id, []).append(r.pos)
        assert r.g0 == r.row_id % 25
    assert sorted(sizes) == list(range(7))
    assert sorted(map(len, sizes.values())) == [4, 5, 7, 7, 7, 10, 10]
    assert all(sorted(p) == list(range(len(p))) for p in sizes.values())

    order = sorted(range(7), key=lambda g: (hashlib.md5(f"42g:{g}".encode()).hexdigest(), g))
    shuffled = ordering.group_shuffle(scan, "group_id")
    assert "group_id" not in shuffled.columns
    group_of = {r.row_id: r.group_id for r in got}
    assert all(r.batch_id == order.index(group_of[r.row_id]) for r in shuffled.collect())


def test_layout_passes_hold_every_row_in_every_pass(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(metrics, "LAYOUTS", ["soma_sp", "parquet_chunk", "arrow", "zarr_dense"])
    paths = fixtures.layout_stores(spark, sf_dir)
    labels = fixtures.x_dense(spark, sf_dir).select("row_id", "code")
    batches = layout_study.layout_passes(spark, paths, labels, "code", epochs=2)
    passes = batches.groupBy("name", "epoch").agg(*(F.sum(c).alias(c) for c in ("n_rows", "label_sum", "value_sum"))).collect()
    names = ["arrow", "parquet_chunk", "parquet_chunk_rand", "soma_sp", "soma_sp_rand", "zarr_dense", "zarr_dense_rand"]
    assert sorted((p.name, p.epoch) for p in passes) == [(n, e) for n in names for e in range(2)]
    assert {p.n_rows for p in passes} == {500} and len({(p.label_sum, p.value_sum) for p in passes}) == 1


def test_a_budget_keeps_later_runs_out_of_the_exchange(spark, store):
    for method in ("permutation", "block", "chunk_window"):
        whole = {(r.batch_id, r.pos): r.row_id for r in run_of(spark, store, method, batch_size=64).batches.collect()}
        short = run_of(spark, store, method, batch_size=64, n_samples=200, drop_last=False)
        rows = {(r.batch_id, r.pos): r.row_id for r in short.batches.collect()}
        assert len(rows) == 200 and short.n_left_out == 0 and short.n_batches == 4
        assert rows.items() <= whole.items()
        text = short.batches._jdf.queryExecution().executedPlan().toString()
        assert text.index("Exchange hashpartitioning") < text.index("_run_start#", text.index("Exchange hashpartitioning"))
        filtered = text[text.index("Exchange hashpartitioning") :]
        assert "_run_start" in filtered.split("BroadcastExchange")[0] and "< 200" in filtered


def test_epochs_of_a_run_hold_all_rows_in_other_orders(spark, store):
    run = run_of(spark, store, "chunk_window", epochs=2, drop_last=False)
    rows = run.batches.select("epoch", "batch_id", "pos", "row_id").collect()
    orders = [[r.row_id for r in sorted(rows, key=lambda r: (r.batch_id, r.pos)) if r.epoch == e] for e in range(2)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(1500)) and orders[0] != orders[1]


def test_container_of_a_method(spark, store):
    with pytest.raises(LookupError, match="orders_zarr"):
        run_of_name = lambda method: loading.loading_run(
            spark, store.manifest, "orders", store.schema, method, containers=loading.CONTAINERS
        )
        run_of_name("chunk_window")


def test_layouts_that_cannot_be_read_at_random(spark, sf_dir):
    paths = fixtures.layout_stores(spark, sf_dir)
    labels = fixtures.x_dense(spark, sf_dir).select("row_id", "code")
    with pytest.raises(ValueError, match="random access"):
        layout_study.layout_batches(spark, "arrow", paths["arrow"], labels, "code", random=True)


def test_batches_of_layouts(spark, sf_dir):
    paths = fixtures.layout_stores(spark, sf_dir)
    labels = fixtures.x_dense(spark, sf_dir).select("row_id", "code")
    for name in ("zarr_dense_chunk", "soma_sp", "parquet_chunk", "arrow_chunk"):
        for random in (False, True):
            if random and name.startswith("arrow"):
                continue
            batches = layout_study.layout_batches(spark, name, paths[name], labels, "code", random=random)
            sizes = sorted(r["count"] for r in batches.groupBy("batch_id").count().collect())
            assert sizes == [116, 128, 128, 128], name


def test_study_of_the_first_rows_and_variables(spark, sf_dir, store):
    root = workdir.fresh_path(spark, "study")
    rows = fixtures.stored_rows(spark, sf_dir)
    layout_study.write_study(rows, rows, "cell_line", root, nrows=256, ncols=20)
    paths = layout_study.layout_paths(root)
    kept = {(r.row_id, i, v) for r in rows.collect() for i, v in zip(r.indices, r["values"]) if r.row_id < 256 and i < 20}
    entries = spark.read.parquet(paths["soma_sp"])
    assert {(r.row_id, r.var_id, r.value) for r in entries.collect()} == kept
    assert spark.read.parquet(paths["h5py_sp"]).count() == 256
    wide = spark.read.parquet(paths["parquet"])
    assert wide.columns == [f"g{i}" for i in range(20)] + ["code"]
    total = wide.select(sum(F.col(f"g{i}") for i in range(20)).alias("t")).agg(F.sum("t")).first()[0]
    assert total == sum(v for _, _, v in kept)
    assert spark.read.parquet(paths["zarr_dense"]).agg(F.max(F.size("x"))).first()[0] == 20
    report = layouts.storage_report(spark, paths).collect()
    assert len(report) == 13 and all(r.size > 0 and r.n_objects > 0 for r in report)
