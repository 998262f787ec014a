"""Batch orders against a plain Python reading of their definition."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.operators import batches, ordering
from rowloom.operators.ordinals import dense_positions, grouped_positions


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def permuted(ids, seed="42"):
    return sorted(ids, key=lambda r: (md5(f"{seed}:{r}"), r))


def chunk_order(ids, chunk, window, seed="42"):
    chunks = sorted({r // chunk for r in ids}, key=lambda c: (md5(f"{seed}c:{c}"), c))
    place = {c: i // window for i, c in enumerate(chunks)}
    return sorted(ids, key=lambda r: (place[r // chunk], md5(f"{seed}r:{r}"), r))


def block_order(ids, block, fetch, seed="42"):
    blocks = sorted(ids, key=lambda r: (md5(f"{seed}b:{r // block}"), r))
    fetch_of = {r: i // fetch for i, r in enumerate(blocks)}
    return sorted(ids, key=lambda r: (fetch_of[r], md5(f"{seed}r:{r}"), r))


def cut(order, size, drop_last=False):
    last = len(order) // size
    return sorted(
        (i // size, i % size, r) for i, r in enumerate(order) if not (drop_last and i // size >= last)
    )


def collected(plan, *columns):
    return sorted(tuple(r) for r in plan.select(*(columns or ("batch_id", "pos", "row_id"))).collect())


def ids_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "row_id bigint").repartition(3)


SIZES = [(1, 4), (9, 4), (100, 16), (1000, 33), (1003, 1024)]


@pytest.mark.parametrize("n,size", SIZES)
@pytest.mark.parametrize("drop_last", [True, False])
def test_permutation(spark, n, size, drop_last):
    plan = ordering.global_permutation(ids_frame(spark, range(n)), size, drop_last=drop_last)
    assert collected(plan) == cut(permuted(range(n)), size, drop_last)


def test_orders_keep_rows_when_ids_have_gaps(spark):
    ids = [3 * i * i for i in range(300)]
    frame = ids_frame(spark, ids)
    assert collected(ordering.global_permutation(frame, 16, drop_last=False)) == cut(permuted(ids), 16)
    plan = ordering.chunk_window_shuffle(frame, 16, chunk_size=50, preload_nchunks=3, drop_last=False)
    assert collected(plan) == cut(chunk_order(ids, 50, 3), 16)
    plan = ordering.block_shuffle(frame, 16, drop_last=False)
    assert collected(plan) == cut(block_order(ids, 4, 16 * 16), 16)


@pytest.mark.parametrize("n,size", SIZES)
def test_block_shuffle(spark, n, size):
    plan = ordering.block_shuffle(ids_frame(spark, range(n)), size, block_size=7, fetch_factor=2, drop_last=False)
    assert collected(plan) == cut(block_order(range(n), 7, size * 2), size)


@pytest.mark.parametrize("n,size", SIZES)
def test_chunk_window_shuffle(spark, n, size):
    plan = ordering.chunk_window_shuffle(
        ids_frame(spark, range(n)), size, chunk_size=10, preload_nchunks=4, drop_last=False
    )
    assert collected(plan) == cut(chunk_order(range(n), 10, 4), size)


def test_part_shuffle_shuffles_one_part_at_a_time(spark):
    plan = ordering.part_shuffle(ids_frame(spark, range(1000)), 64, part_bytes=400_000, n_values=1000)
    assert collected(plan) == cut(chunk_order(range(1000), 100, 1), 64, drop_last=True)


def test_row_group_is_a_batch_in_file_order(spark):
    plan = ordering.row_group_shuffle(ids_frame(spark, range(70)), 16)
    groups = sorted(range(5), key=lambda g: (md5(f"42g:{g}"), g))
    want = sorted((groups.index(r // 16), r % 16, r) for r in range(70))
    assert collected(plan) == want


def test_stream_chunks_use_positions_of_the_filtered_rows(spark):
    ids = list(range(5, 4000, 7))
    position = {r: i for i, r in enumerate(ids)}
    back = {i: r for r, i in position.items()}
    order = [back[p] for p in chunk_order(range(len(ids)), 100, 1)]
    plan = ordering.stream_chunk_shuffle(ids_frame(spark, ids), 32, chunk_size=100)
    assert collected(plan) == cut(order, 32)


@pytest.mark.parametrize(
    "planner", [ordering.global_permutation, ordering.block_shuffle, ordering.chunk_window_shuffle]
)
def test_each_epoch_holds_every_row_once_in_its_own_order(spark, planner):
    n, size = 500, 32
    plan = planner(ids_frame(spark, range(n)), size, epochs=3, drop_last=False)
    rows = [tuple(r) for r in plan.select("epoch", "batch_id", "pos", "row_id").collect()]
    orders = []
    for epoch in range(3):
        mine = sorted(r[1:] for r in rows if r[0] == epoch)
        assert sorted(r[2] for r in mine) == list(range(n))
        sizes = Counter(r[0] for r in mine)
        assert [sizes[b] for b in sorted(sizes)] == [size] * (n // size) + [n % size]
        orders.append([r[2] for r in mine])
    assert orders[0] != orders[1] != orders[2] != orders[0]


def test_epoch_seed(spark):
    plan = ordering.global_permutation(ids_frame(spark, range(200)), 32, epochs=2, drop_last=False)
    for epoch in range(2):
        assert collected(plan.filter(F.col("epoch") == epoch)) == cut(permuted(range(200), f"42:{epoch}"), 32)


@pytest.mark.parametrize(
    "planner",
    [
        ordering.global_permutation,
        ordering.block_shuffle,
        ordering.chunk_window_shuffle,
        ordering.stream_chunk_shuffle,
        batches.shuffled_batches,
    ],
)
def test_plan_does_not_depend_on_partitions(spark, planner):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "8", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            seen.append(collected(planner(ids_frame(spark, range(777)), 32)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_number_of_buckets_does_not_change_the_order(spark, digits):
    plan = ordering.global_permutation(ids_frame(spark, range(777)), 32, drop_last=False, digits=digits)
    assert collected(plan) == cut(permuted(range(777)), 32)


@pytest.mark.parametrize("n,run", [(1, 5), (40, 40), (41, 40), (1000, 7), (1000, 256), (5000, 64)])
@pytest.mark.parametrize("digits", [1, 3])
def test_runs_follow_the_permutation(spark, n, run, digits):
    rows = ids_frame(spark, range(n)).withColumn("payload", F.col("row_id") * 10)
    placed = ordering.permutation_in_runs(rows, run, digits=digits)
    want = sorted((i // run, i, r, r * 10) for i, r in enumerate(permuted(range(n))))
    assert collected(placed, "run", "ord", "row_id", "payload") == want


@pytest.mark.parametrize("n", [1, 37, 1000, 1001])
@pytest.mark.parametrize("digits", [1, 3])
def test_blocks_in_runs_follow_the_block_order(spark, n, digits):
    placed = ordering.blocks_in_runs(ids_frame(spark, range(n)), 16, block_size=5, fetch_factor=3, digits=digits)
    want = sorted((i // 48, i, r) for i, r in enumerate(block_order(range(n), 5, 48)))
    assert collected(placed, "run", "ord", "row_id") == want


@pytest.mark.parametrize("n", [1, 37, 1000, 1003])
@pytest.mark.parametrize("digits", [1, 3])
def test_chunk_windows_in_runs_follow_the_chunk_order(spark, n, digits):
    placed = ordering.chunk_windows_in_runs(
        ids_frame(spark, range(n)), chunk_size=10, preload_nchunks=3, windows_per_run=4, digits=digits
    )
    want = sorted((i, r) for i, r in enumerate(chunk_order(range(n), 10, 3)))
    assert collected(placed, "ord", "row_id") == want


def test_runs_of_rows_with_gaps(spark):
    ids = [3 * i * i for i in range(300)]
    frame = ids_frame(spark, ids)
    placed = ordering.chunk_windows_in_runs(frame, chunk_size=50, preload_nchunks=3, windows_per_run=2)
    assert collected(placed, "ord", "row_id") == list(enumerate(chunk_order(ids, 50, 3)))
    assert collected(ordering.permutation_in_runs(frame, 32), "ord", "row_id") == list(enumerate(permuted(ids)))


def test_runs_of_epochs(spark):
    frame = ids_frame(spark, range(300))
    seeds = [f"42:{e}" for e in range(2)]
    for placed, order in (
        (ordering.permutation_in_runs(frame, 32, epochs=2), lambda s: permuted(range(300), s)),
        (ordering.blocks_in_runs(frame, 8, epochs=2), lambda s: block_order(range(300), 4, 128, s)),
        (
            ordering.chunk_windows_in_runs(frame, chunk_size=20, preload_nchunks=2, windows_per_run=2, epochs=2),
            lambda s: chunk_order(range(300), 20, 2, s),
        ),
    ):
        want = sorted((e, i, r) for e, s in enumerate(seeds) for i, r in enumerate(order(s)))
        assert collected(placed, "epoch", "ord", "row_id") == want


def test_sorted_within_batch(spark):
    plan = ordering.global_permutation(ids_frame(spark, range(100)), 16, epochs=2)
    read = ordering.sorted_within_batch(plan)
    members = lambda df: sorted(tuple(r) for r in df.select("epoch", "batch_id", "row_id").collect())
    assert members(read) == members(plan)
    for key, rows in _grouped(read).items():
        assert [r for _, r in sorted(rows)] == sorted(r for _, r in rows), key


def _grouped(plan):
    groups = {}
    for r in plan.collect():
        groups.setdefault((r.epoch, r.batch_id), []).append((r.pos, r.row_id))
    return groups


def test_sequential_and_budgets(spark):
    frame = ids_frame(spark, range(100))
    assert collected(ordering.batch_sequential(frame, 32)) == cut(range(100), 32)
    assert collected(ordering.batch_sequential(frame, 32, drop_last=True)) == cut(range(100), 32, True)
    plan = ordering.global_permutation(frame, 32, drop_last=False)
    whole = cut(permuted(range(100)), 32)
    total = F.lit(100).cast("bigint")
    assert collected(batches.row_budget(plan, -1, total, 32)) == whole
    assert collected(batches.row_budget(plan, 1000, total, 32)) == whole
    assert collected(batches.row_budget(plan, 40, total, 32)) == [r for r in whole if r[0] * 32 + r[1] < 40]
    assert collected(batches.batch_budget(plan, 70, 32)) == [r for r in whole if r[0] < 2]
    assert collected(batches.drop_last(plan, total, 32)) == cut(permuted(range(100)), 32, True)


def test_payload_travels_with_its_row(spark):
    rows = ids_frame(spark, range(300)).withColumn("label", F.concat(F.lit("l"), F.col("row_id")))
    for planner in (ordering.global_permutation, ordering.block_shuffle, ordering.chunk_window_shuffle):
        for r in planner(rows, 32).collect():
            assert r.label == f"l{r.row_id}"


def test_positions_in_groups_of_any_size(spark):
    # One group holds two thirds of the rows and spans many key ranges; null is a group.
    rows = [("hot", i) for i in range(0, 2000, 2)] + [("cold", i) for i in range(1, 600, 2)]
    rows += [(None, 5000 + i) for i in range(200)]
    frame = spark.createDataFrame(rows, "tool string, id bigint").repartition(5)
    got = sorted((r.tool or "", r.id, r.ord) for r in grouped_positions(frame, ["tool"], "id", width=64).collect())
    want = []
    for tool in {t for t, _ in rows}:
        want += [(tool or "", i, n) for n, i in enumerate(sorted(i for t, i in rows if t == tool))]
    assert got == sorted(want)


def test_dense_positions_of_negative_and_far_keys(spark):
    ids = [-70_000, -1, 0, 5, 65_535, 65_536, 10**12]
    got = sorted((r.ord, r.row_id) for r in dense_positions(ids_frame(spark, ids)).collect())
    assert got == list(enumerate(ids))
