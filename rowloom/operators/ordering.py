"""Batch plans: each row of a matrix gets ``(batch_id, pos)`` under a seeded order.

``rows`` needs a ``row_id`` column and may carry payload, which travels with the
row in the same exchange.  Orders come from md5 of seed and key, so a plan does
not depend on partition counts and a recomputed task gives the same rows.
``drop_last`` leaves out the final short batch.  With ``epochs`` the plan holds
that many passes, each with its own order, told apart by ``epoch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scalars import part_rows, seed_text, seeded_hex
from rowloom.operators.ordinals import MAX_BROADCAST_OFFSETS, dense_positions, hex_bucket, with_ordinal
from rowloom.workdir import settle


def with_epochs(rows: DataFrame, epochs: int | None) -> DataFrame:
    """The rows once per epoch (a local explode, no join)."""
    if epochs is None:
        return rows
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def _div(value: Column, size: int) -> Column:
    return F.call_function("div", value, F.lit(size).cast("bigint"))


def _digits(digits: int | None, n_rows: int | None) -> int:
    """Hex digits of the md5 bucket: 4,096 buckets, or 65,536 above a billion rows."""
    if digits is not None:
        return digits
    return 4 if n_rows is not None and n_rows > 1_000_000_000 else 3


def _epoch_columns(epochs: int | None) -> list[str]:
    return [] if epochs is None else ["epoch"]


def _seed(seed: int | str, epochs: int | None) -> Column:
    return seed_text(seed, None if epochs is None else F.col("epoch"))


def _cut(
    ordered: DataFrame, rows: DataFrame, batch_size: int, drop_last: bool, n_rows: int | None
) -> DataFrame:
    """Turn the global position ``ord`` into ``(batch_id, pos)``."""
    plan = ordered.withColumn("batch_id", _div(F.col("ord"), batch_size)).withColumn(
        "pos", F.col("ord") % F.lit(batch_size).cast("bigint")
    )
    if drop_last:
        total = F.lit(n_rows).cast("bigint") if n_rows is not None else rows.agg(F.count(F.lit(1))).scalar()
        plan = plan.filter(F.col("batch_id") < _div(total, batch_size))
    return plan.drop("ord")


def batch_sequential(
    rows: DataFrame, batch_size: int, *, drop_last: bool = False, n_rows: int | None = None
) -> DataFrame:
    """Consecutive runs of ``batch_size`` rows; ``row_id`` is the position. No shuffle."""
    return _cut(rows.withColumn("ord", F.col("row_id")), rows, batch_size, drop_last, n_rows)


def _with_key(rows: DataFrame, hex_key: Column, digits: int) -> DataFrame:
    return rows.withColumn("_key", hex_key).withColumn("_part", hex_bucket(F.col("_key"), digits))


def _placed(rows: DataFrame, hex_key: Column, epochs: int | None, digits: int) -> DataFrame:
    """Rows with their key, its bucket and their place ``ord`` in (key, row_id) order."""
    return with_ordinal(
        _with_key(with_epochs(rows, epochs), hex_key, digits),
        order_by=["_key", "row_id"],
        bucket=F.col("_part"),
        groups=_epoch_columns(epochs),
        max_offsets=16**digits * (epochs or 1),
    )


def global_order(
    rows: DataFrame,
    *,
    seed: int | str = 42,
    epochs: int | None = None,
    digits: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """Add ``ord``, the place of each row in a seeded permutation of all rows.

    ``digits`` sets the number of md5 buckets: 3 (4,096) up to about a billion
    rows, 4 (65,536) above.
    """
    digits = _digits(digits, n_rows)
    key = seeded_hex(_seed(seed, epochs), "", F.col("row_id"))
    return _placed(rows, key, epochs, digits).drop("_key", "_part")


def global_permutation(
    rows: DataFrame,
    batch_size: int,
    *,
    seed: int | str = 42,
    epochs: int | None = None,
    drop_last: bool = True,
    n_rows: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """A seeded permutation of all rows, cut into batches."""
    ordered = global_order(rows, seed=seed, epochs=epochs, digits=_digits(digits, n_rows))
    return _cut(ordered, rows, batch_size, drop_last, n_rows)


def sorted_within_batch(plan: DataFrame) -> DataFrame:
    """Same batches, rows of each read in ascending ``row_id``."""
    epoch = [c for c in plan.columns if c == "epoch"]
    inside = Window.partitionBy(*epoch, "batch_id").orderBy("row_id")
    return plan.withColumn("pos", (F.row_number().over(inside) - 1).cast("bigint"))


def block_shuffle(
    rows: DataFrame,
    batch_size: int,
    *,
    block_size: int = 4,
    fetch_factor: int = 16,
    seed: int | str = 42,
    epochs: int | None = None,
    drop_last: bool = True,
    n_rows: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Shuffle blocks of consecutive rows, then the rows inside each fetch.

    A fetch is ``batch_size * fetch_factor`` rows in block order.  Fetches are
    full except the last, so the position inside the fetch is all that is left
    to compute: two exchanges, on block bucket and on fetch.
    """
    fetch_rows = batch_size * fetch_factor
    digits = _digits(digits, n_rows)
    epoch = _epoch_columns(epochs)
    key = seeded_hex(_seed(seed, epochs), "b", _div(F.col("row_id"), block_size))
    placed = _placed(rows, key, epochs, digits).drop("_key", "_part")
    fetched = placed.withColumn("_fetch", _div(F.col("ord"), fetch_rows)).withColumn(
        "_key", seeded_hex(_seed(seed, epochs), "r", F.col("row_id"))
    )
    inside = Window.partitionBy(*epoch, "_fetch").orderBy("_key", "row_id")
    ordered = fetched.withColumn("ord", F.col("_fetch") * fetch_rows + F.row_number().over(inside) - 1)
    return _cut(ordered.drop("_fetch", "_key"), rows, batch_size, drop_last, n_rows)


def _chunk_places(
    rows: DataFrame, chunk: Column, tag: str, seed: int | str, epochs: int | None, digits: int
) -> DataFrame:
    """Seeded place ``ord`` of each chunk and the number of rows ``start`` before it.

    Works on one row per chunk; the counts are combined on the map side.
    """
    chunks = rows.groupBy(chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_size"))
    keyed = _with_key(with_epochs(chunks, epochs), seeded_hex(_seed(seed, epochs), tag, F.col("_chunk")), digits)
    return with_ordinal(
        keyed,
        order_by=["_key", "_chunk"],
        bucket=F.col("_part"),
        groups=_epoch_columns(epochs),
        weight="_size",
        max_offsets=16**digits * (epochs or 1),
    ).drop("_size")


def chunk_window_shuffle(
    rows: DataFrame,
    batch_size: int,
    *,
    chunk_size: int = 256,
    preload_nchunks: int = 8,
    seed: int | str = 42,
    epochs: int | None = None,
    drop_last: bool = True,
    n_rows: int | None = None,
    digits: int | None = None,
    key: str = "row_id",
    chunk: str | None = None,
) -> DataFrame:
    """Random chunks of consecutive rows, shuffled inside windows of chunks.

    ``key`` is the position that is cut into chunks, unless a column ``chunk`` names them.  A window holds at most
    ``chunk_size * preload_nchunks`` rows, which is also the most one window
    group brings to a task.  The short last chunk may land in any window, so
    positions continue from counted window starts.
    """
    epoch = _epoch_columns(epochs)
    digits = _digits(digits, n_rows)
    chunk_id = _div(F.col(key), chunk_size) if chunk is None else F.col(chunk)
    places = _chunk_places(rows, chunk_id, "c", seed, epochs, digits)
    windows = places.withColumn("_window", _div(F.col("ord"), preload_nchunks)).drop("ord", "_key", "_part")
    windows = windows.withColumn(
        "_first", F.min("start").over(Window.partitionBy(*epoch, "_window"))
    ).drop("start")
    placed = (
        rows.withColumn("_chunk", chunk_id)
        .join(windows, "_chunk")
        .withColumn("_key", seeded_hex(_seed(seed, epochs), "r", F.col(key)))
    )
    inside = Window.partitionBy(*epoch, "_window").orderBy("_key", key)
    ordered = placed.withColumn("ord", F.col("_first") + F.row_number().over(inside) - 1)
    return _cut(ordered.drop("_chunk", "_window", "_first", "_key"), rows, batch_size, drop_last, n_rows)


def part_shuffle(
    rows: DataFrame,
    batch_size: int = 1024,
    *,
    part_bytes: int = 100_000_000,
    n_values: int = 20_000,
    seed: int | str = 42,
    epochs: int | None = None,
    drop_last: bool = True,
    n_rows: int | None = None,
) -> DataFrame:
    """Shuffle one part at a time; a part is the rows of ``part_bytes`` float32 values."""
    return chunk_window_shuffle(
        rows,
        batch_size,
        chunk_size=part_rows(part_bytes, n_values),
        preload_nchunks=1,
        seed=seed,
        epochs=epochs,
        drop_last=drop_last,
        n_rows=n_rows,
    )


def sparse_row_bytes(n_entries: Column) -> Column:
    """Size of a sparse row: its id, and an index and a value of 4 bytes for each entry."""
    return n_entries.cast("bigint") * 8 + 8


def sized_parts(rows: DataFrame, part_bytes: int, size: str = "bytes") -> DataFrame:
    """Add ``part``: rows in ``row_id`` order are cut where the running sum of ``size`` passes ``part_bytes``.

    A part has ``part_bytes`` within its longest row on either side. A row that is no shorter
    than that is a part of its own, numbered below 0, and does not count for the others. The
    sum runs inside ranges of ids, one exchange; ids may be sparse.
    """
    is_long = F.col(size) >= part_bytes
    weighed = rows.withColumn("_counted", F.when(is_long, F.lit(0)).otherwise(F.col(size)).cast("bigint"))
    summed = with_ordinal(weighed, order_by=["row_id"], bucket=_div(F.col("row_id"), 65_536), weight="_counted")
    part = F.when(is_long, -F.col("row_id") - 1).otherwise(_div(F.col("start"), part_bytes))
    return summed.withColumn("part", part.cast("bigint")).drop("_counted", "ord", "start")


def sized_part_shuffle(
    rows: DataFrame,
    batch_size: int = 1024,
    *,
    part_bytes: int = 100_000_000,
    size: str = "bytes",
    seed: int | str = 42,
    epochs: int | None = None,
    drop_last: bool = True,
    n_rows: int | None = None,
) -> DataFrame:
    """``part_shuffle`` of rows whose ``size`` differs: parts of nearly equal bytes, not of equal rows.

    The parts are written once and read three times below. Pass ids, not payload.
    """
    parts = settle(sized_parts(rows, part_bytes, size), "sized-parts")
    return chunk_window_shuffle(
        parts,
        batch_size,
        preload_nchunks=1,
        seed=seed,
        epochs=epochs,
        drop_last=drop_last,
        n_rows=n_rows,
        chunk="part",
    ).drop("part")


def stream_chunk_shuffle(
    rows: DataFrame,
    batch_size: int = 1024,
    *,
    chunk_size: int = 10_000,
    seed: int | str = 42,
    epochs: int | None = None,
    drop_last: bool = False,
    n_rows: int | None = None,
) -> DataFrame:
    """Shuffle a filtered sub-matrix chunk by chunk; its rows are renumbered first.

    The renumbered rows are written once and read three times below, so the
    filter that made them does not run again. Pass ids, not payload.
    """
    dense = dense_positions(rows).withColumnRenamed("ord", "_position")
    return chunk_window_shuffle(
        dense,
        batch_size,
        chunk_size=chunk_size,
        preload_nchunks=1,
        seed=seed,
        epochs=epochs,
        drop_last=drop_last,
        n_rows=n_rows,
        key="_position",
    ).drop("_position")


def group_shuffle(
    rows: DataFrame, group: str, *, seed: int | str = 42, epochs: int | None = None, digits: int | None = None
) -> DataFrame:
    """Groups of rows in random order: ``batch_id`` is the place of the row's group."""
    places = _chunk_places(rows, F.col(group), "g", seed, epochs, _digits(digits, None)).drop("start", "_key", "_part")
    return (
        rows.join(places, F.col(group) == F.col("_chunk")).drop("_chunk", group).withColumnRenamed("ord", "batch_id")
    )


def row_group_shuffle(
    rows: DataFrame,
    group_rows: int,
    *,
    seed: int | str = 42,
    epochs: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Row groups of equal size in random order; each is one batch, read in file order."""
    grouped = rows.withColumns(
        {
            "_group": _div(F.col("row_id"), group_rows),
            "pos": F.col("row_id") % F.lit(group_rows).cast("bigint"),
        }
    )
    return group_shuffle(grouped, "_group", seed=seed, epochs=epochs, digits=digits)


# --- wide rows -------------------------------------------------------------
#
# The orders above number ids. To bring counts along, rows are sent straight to
# a run of consecutive places: the key of the first row (or chunk) of each run is
# known from ids alone, and comparing with it tells every row its run where it is
# read. The payload is exchanged once and whole runs arrive in one task.


def _into_runs(rows: DataFrame, firsts: DataFrame, tie: str, n_runs: int, epochs: int | None, digits: int) -> DataFrame:
    """Add ``run`` and ``_run_start`` to keyed rows.

    ``firsts`` holds placed rows or chunks with ``_run``, the first place in it
    ``_run_start`` and ``_is_first``. Each md5 bucket has the run that is open when
    it begins and the runs that begin in it.
    """
    epoch = _epoch_columns(epochs)
    place = F.struct("_run", "_run_start")
    mark = F.struct("_key", F.col(tie).alias("_tie"), "_run", "_run_start")
    marks = F.sort_array(F.collect_list(F.when(F.col("_is_first"), mark)))
    parts = firsts.groupBy(*epoch, "_part").agg(F.min_by(place, "ord").alias("_open"), marks.alias("_marks"))
    # Nearly all buckets have one mark at most, which two comparisons settle; only others are searched.
    parts = parts.select(
        *epoch,
        "_part",
        "_open",
        F.get("_marks", F.lit(0)).alias("_first"),
        F.when(F.size("_marks") > 1, F.col("_marks")).alias("_more"),
    )
    if max(n_runs, 16**digits * (epochs or 1)) <= MAX_BROADCAST_OFFSETS:
        parts = F.broadcast(parts)
    here = F.struct(F.col("_key"), F.col(tie).alias("_tie"))
    passed = F.filter("_more", lambda m: F.struct(m["_key"], m["_tie"]) <= here)
    first = F.col("_first")
    ahead = first.isNull() | (F.col("_key") < first["_key"]) | ((F.col("_key") == first["_key"]) & (F.col(tie) < first["_tie"]))

    def found(name: str) -> Column:
        later = F.when(F.col("_more").isNull(), first[name]).otherwise(F.element_at(passed, -1)[name])
        return F.when(ahead, F.col("_open")[name]).otherwise(later)

    return (
        rows.join(parts, [*epoch, "_part"], "left")
        .withColumns({"run": found("_run"), "_run_start": found("_run_start")})
        .drop("_open", "_first", "_more", "_part")
    )


def _row_runs(
    rows: DataFrame, hex_key: Column, run_rows: int, epochs: int | None, digits: int | None, n_rows: int | None
) -> DataFrame:
    """Keyed rows sent to runs of ``run_rows`` places in (key, row_id) order."""
    total = rows.count() if n_rows is None else n_rows
    digits = _digits(digits, total)
    firsts = _placed(rows.select("row_id"), hex_key, epochs, digits).withColumns(
        {"_run": _div(F.col("ord"), run_rows), "_is_first": F.col("ord") % run_rows == 0}
    )
    firsts = firsts.withColumn("_run_start", F.col("_run") * run_rows)
    keyed = _with_key(with_epochs(rows, epochs), hex_key, digits)
    return _into_runs(keyed, firsts, "row_id", -(-total // run_rows) * (epochs or 1), epochs, digits)


def _within(rows: DataFrame, limit: int | None) -> DataFrame:
    """Without the runs that begin at place ``limit`` or later; known where a row is read."""
    return rows if limit is None else rows.filter(F.col("_run_start") < limit)


def _ordered_in_runs(rows: DataFrame, order_by: list[str], epochs: int | None) -> DataFrame:
    inside = Window.partitionBy(*_epoch_columns(epochs), "run").orderBy(*order_by)
    return rows.withColumn("ord", (F.col("_run_start") + F.row_number().over(inside) - 1).cast("bigint"))


def permutation_in_runs(
    rows: DataFrame,
    run_rows: int,
    *,
    seed: int | str = 42,
    epochs: int | None = None,
    digits: int | None = None,
    n_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``global_order`` of wide rows: ``ord``, and ``run`` which is ``ord div run_rows``.

    With ``limit`` runs that begin at a later place stay behind: they are not
    exchanged. Grouping by ``run`` and anything inside it, such as batches of a divisor of
    ``run_rows``, needs no further exchange.
    """
    key = seeded_hex(_seed(seed, epochs), "", F.col("row_id"))
    sent = _within(_row_runs(rows, key, run_rows, epochs, digits, n_rows), limit)
    return _ordered_in_runs(sent, ["_key", "row_id"], epochs).drop("_key", "_run_start")


def blocks_in_runs(
    rows: DataFrame,
    batch_size: int,
    *,
    block_size: int = 4,
    fetch_factor: int = 16,
    seed: int | str = 42,
    epochs: int | None = None,
    digits: int | None = None,
    n_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The order of ``block_shuffle`` for wide rows; a ``run`` is a fetch, of whole batches."""
    key = seeded_hex(_seed(seed, epochs), "b", _div(F.col("row_id"), block_size))
    sent = _within(_row_runs(rows, key, batch_size * fetch_factor, epochs, digits, n_rows), limit)
    inner = sent.withColumn("_key", seeded_hex(_seed(seed, epochs), "r", F.col("row_id")))
    return _ordered_in_runs(inner, ["_key", "row_id"], epochs).drop("_key", "_run_start")


def chunk_windows_in_runs(
    rows: DataFrame,
    *,
    chunk_size: int = 256,
    preload_nchunks: int = 8,
    windows_per_run: int = 32,
    seed: int | str = 42,
    epochs: int | None = None,
    digits: int | None = None,
    n_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The order of ``chunk_window_shuffle`` for wide rows; a ``run`` is some windows.

    Only chunks are numbered ahead, no ids are shuffled. A short chunk moves
    batches against windows, so a batch may lie in two runs: group by ``batch_id``.
    ``n_rows``, of ids 0..n-1, saves a pass over the ids.
    """
    epoch = _epoch_columns(epochs)
    chunks_per_run = preload_nchunks * windows_per_run
    chunk = _div(F.col("row_id"), chunk_size)
    if n_rows is None:  # ids may have gaps: no more chunks than rows, nor than the id range holds
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
        n_rows, n_chunks = size.n, min(size.n, (size.hi - size.lo) // chunk_size + 2) if size.n else 0
    else:
        n_chunks = -(-n_rows // chunk_size)
    digits = _digits(digits, n_rows)
    places = _chunk_places(rows, chunk, "c", seed, epochs, digits).withColumns(
        {"_run": _div(F.col("ord"), chunks_per_run), "_is_first": F.col("ord") % chunks_per_run == 0}
    )
    firsts = places.withColumn("_run_start", F.min("start").over(Window.partitionBy(*epoch, "_run")))
    chunked = with_epochs(rows, epochs).withColumn("_chunk", chunk)
    keyed = _with_key(chunked, seeded_hex(_seed(seed, epochs), "c", F.col("_chunk")), digits)
    n_runs = -(-n_chunks // chunks_per_run) * (epochs or 1)
    sent = _within(_into_runs(keyed, firsts, "_chunk", n_runs, epochs, digits), limit)
    nth_chunk = F.dense_rank().over(Window.partitionBy(*epoch, "run").orderBy("_key", "_chunk")) - 1
    inner = sent.withColumn("_window", _div(nth_chunk.cast("bigint"), preload_nchunks)).withColumn(
        "_key", seeded_hex(_seed(seed, epochs), "r", F.col("row_id"))
    )
    return _ordered_in_runs(inner, ["_window", "_key", "row_id"], epochs).drop(
        "_key", "_run_start", "_chunk", "_window"
    )
