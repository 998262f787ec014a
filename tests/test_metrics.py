"""Scalar rules and run metrics against plain Python."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom import workdir
from rowloom.functions import scalars
from rowloom.operators import batches, metrics


def divisor(value, bound):
    return next((d for d in range(min(value, bound), 0, -1) if value % d == 0), 1)


def batch(size, n, chunk, preload):
    if 10 * size > n:
        size = max(1, n // 10)
    window = chunk * preload
    return divisor(window, size) if window % size else size


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 300)), min_size=1, max_size=60))
def test_largest_divisor(spark, pairs):
    df = spark.createDataFrame(pairs, "v bigint, u bigint")
    got = df.select("v", "u", scalars.largest_divisor(F.col("v"), F.col("u")).alias("d")).collect()
    assert [r.d for r in got] == [divisor(r.v, r.u) for r in got]


CONFIG = [(256, 8, 4096, 10**6), (256, 64, 4096, 10**6), (256, 64, 3000, 10**6), (10, 10, 33, 10**6)]


def test_effective_batch(spark):
    rows = CONFIG + [(256, 8, 4096, n) for n in (0, 1, 9, 10, 99, 5000, 40_960, 40_959)]
    df = spark.createDataFrame(rows, "c int, k int, b int, n bigint")
    size = scalars.effective_batch(F.col("b"), F.col("n"), F.col("c"), F.col("k"))
    assert [r[0] for r in df.select(size).collect()] == [batch(b, n, c, k) for c, k, b, n in rows]
    assert [r[0] for r in df.limit(4).select(size).collect()] == [2048, 4096, 2048, 25]
    plain = scalars.effective_batch(F.col("b"), F.col("n"))
    assert [r[0] for r in df.limit(4).select(plain).collect()] == [4096, 4096, 3000, 33]


def test_names(spark):
    df = spark.createDataFrame([("shard_12.parquet",), ("a_b_3",), ("x/shard=7",)], "n string")
    assert [r[0] for r in df.select(scalars.shard_number(F.col("n"))).collect()] == [12, 3, 7]
    assert scalars.collection_format_key("c", "parquet") == "c_parquet"
    assert scalars.part_rows(100_000_000, 20_000) == 1250


LOG = [
    (tool, epoch, i, 1024 if i < 9 else 100, round(0.1 * (i + 1) + epoch, 2))
    for tool in ("a", "b")
    for epoch in range(2)
    for i in range(10)
]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(LOG, "tool string, epoch int, batch_idx bigint, n_rows int, seconds double")


def test_throughput_counts_what_it_sums(log):
    for skip, samples, chosen in (
        (False, None, range(9)),
        (True, None, range(1, 9)),
        (False, 3 * 1024 + 5, range(3)),
        (True, 3 * 1024 + 5, range(1, 4)),
    ):
        rates = metrics.throughput(
            log, ["tool", "epoch"], batch_size=1024, n_samples=samples, skip_first=skip
        ).collect()
        assert len(rates) == 4
        for r in rates:
            seconds = sum(s for t, e, i, n, s in LOG if (t, e) == (r.tool, r.epoch) and i in chosen)
            assert r.n_batches == len(chosen) and r.n_rows == 1024 * len(chosen)
            assert r.samples_per_sec == pytest.approx(r.n_rows / seconds)
            assert r.time_per_sample == pytest.approx(1e6 * seconds / r.n_rows)


def test_batches_of_any_size_count(spark, log):
    for skip in (False, True):
        rates = metrics.throughput(log, ["tool", "epoch"], skip_first=skip).collect()
        assert {(r.n_batches, r.n_rows) for r in rates} == {(10 - skip, 1024 * (9 - skip) + 100)}
    other = spark.createDataFrame([("a", 0, i, 2048, 0.5) for i in range(5)], log.schema)
    assert [r.n_rows for r in metrics.throughput(other, ["tool"]).collect()] == [5 * 2048]
    assert [r.n_rows for r in metrics.throughput_epochs(other).collect()] == [4 * 2048]
    assert metrics.nested_results(other).count() == 1
    with pytest.raises(ValueError, match="needs the batch size"):
        metrics.throughput(log, ["tool"], n_samples=10)


def test_runs_of_no_time(spark):
    log = spark.createDataFrame([("a", 0, 1024, 0.0)], "tool string, batch_idx bigint, n_rows int, seconds double")
    assert metrics.throughput(log, ["tool"]).first().samples_per_sec is None


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_intervals_across_ranges(spark, width):
    base = dt.datetime(2024, 3, 30, 23, 59, 59, 999_000)
    rows = [("hot", i, base + dt.timedelta(hours=i, microseconds=i * i)) for i in range(0, 60, 2)]
    rows += [("cold", i, base + dt.timedelta(seconds=i)) for i in (7, 41)] + [(None, 3, base)]
    frame = spark.createDataFrame(rows, "run string, idx bigint, ts timestamp_ntz").repartition(4)
    start = base - dt.timedelta(milliseconds=5)
    got = metrics.batch_intervals(frame, "run", "idx", "ts", F.lit(start).cast("timestamp_ntz"), width=width)
    want = []
    for run in ("hot", "cold", None):
        previous = start
        for r, i, ts in rows:
            if r == run:
                want.append((run or "", i, (ts - previous) // dt.timedelta(microseconds=1)))
                previous = ts
    assert sorted((r.run or "", r.idx, r.interval_us) for r in got.collect()) == sorted(want)


def test_nested_results_lines_merge_to_one_document(spark, log):
    path = workdir.fresh_path(spark, "nested")
    metrics.write_nested_results(log, path, batch_size=1024, segment=4)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    parts = {}
    for line in lines:
        ((tool, epochs),) = line.items()
        ((epoch, body),) = epochs.items()
        assert len(body["batch_times"]) <= 4
        parts.setdefault((tool, epoch), {})[body["segment"]] = body
    assert set(parts) == {(t, f"epoch_{e}") for t in "ab" for e in range(2)}
    for (tool, epoch), segments in parts.items():
        times = [s for k in sorted(segments) for s in segments[k]["batch_times"]]
        want = [s for t, e, i, n, s in LOG if t == tool and epoch == f"epoch_{e}" and 0 < i < 9]
        assert times == want
        assert segments[0]["samples_per_sec"] == pytest.approx(8 * 1024 / sum(want))
    assert metrics.read_nested_results(spark, path).count() == 4 * 8


def test_loop_log_appends(spark):
    path = workdir.fresh_path(spark, "loops")
    for epoch in range(2):
        rows = spark.createDataFrame([("a_rand", epoch, 0.5 + epoch)], "name string, epoch int, seconds double")
        metrics.append_loop_log(rows, path)
    assert sorted(tuple(r) for r in metrics.read_loop_log(spark, path).collect()) == [("a_rand", 0, 0.5), ("a_rand", 1, 1.5)]
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["a_rand\t0\t0.5", "a_rand\t1\t1.5"]


def test_run_matrix(spark):
    shards = spark.createDataFrame([(0, 256), (1, 129)], "shard_ord int, n_observations bigint")
    runs = metrics.run_matrix(shards).collect()
    assert len(runs) == 2 * 23
    first = {r.name: r for r in runs if r.shard_ord == 0}
    assert len([n for n in first if n.endswith("_rand")]) == 10
    assert {"polars", "arrow", "arrow_chunk"} == {n for n in first if f"{n}_rand" not in first and not n.endswith("_rand")}
    assert first["soma_sp"].sparse and first["soma_sp"].kind == "soma"
    assert {r.n_batches for r in runs if r.shard_ord == 1} == {2}


def test_callbacks_and_gather(spark):
    x = spark.createDataFrame(
        [(i, list(range(i % 3)), [1.0] * (i % 3)) for i in range(20)],
        "row_id bigint, indices array<int>, values array<float>",
    )
    indices = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 0)], "pos bigint, row_id bigint")
    got = batches.row_gather(indices, x).orderBy("pos").collect()
    assert [(r.row_id, r.indices) for r in got] == [(5, [0, 1]), (2, [0, 1]), (5, [0, 1]), (0, [])]
    with pytest.raises(Exception, match="no row 99"):
        batches.row_gather(spark.createDataFrame([(0, 99)], "pos bigint, row_id bigint"), x).collect()

    plan = batches.shuffled_batches(x, 6, batches_per_run=2)
    seen = batches.batch_callback(
        plan,
        lambda b: b[["batch_id"]].iloc[:1].assign(n=len(b), ordered=bool((b["pos"] == range(len(b))).all())),
        "batch_id bigint, n bigint, ordered boolean",
        keys=["run", "batch_id"],
    )
    assert sorted(tuple(r) for r in seen.collect()) == [(0, 6, True), (1, 6, True), (2, 6, True), (3, 2, True)]

    doubled = batches.chunk_callback(x.select("row_id"), lambda c: c * 2, "row_id bigint")
    assert sorted(r.row_id for r in doubled.collect()) == [2 * i for i in range(20)]

    obs = x.select("row_id", F.lit("a").alias("label"))
    plan = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "batch_id bigint, pos bigint, row_id bigint")
    rows = batches.materialise(plan, x, obs, ["label"]).collect()
    assert sorted((r.pos, r.row_id, r.label) for r in rows) == [(0, 3, "a"), (1, 1, "a")]
