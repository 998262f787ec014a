"""A loading run on a collection: resolve, size the batches, order, load, record."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import schemas
from rowloom.functions.scalars import budget, collection_format_key, effective_batch
from rowloom.operators import batches, keyed_order, ordering
from rowloom.sources import group_index, registry

# Rows of one exchange unit: at most this many, fewer so that small collections
# still spread over some hundred units.
MAX_RUN_ROWS = 65_536
MIN_RUNS = 256


def _per_run(n_rows: int, unit_rows: int) -> int:
    """Batches or windows of ``unit_rows`` rows in one exchange unit."""
    return max(1, min(MAX_RUN_ROWS, n_rows // MIN_RUNS) // unit_rows)


# The container that each method reads a collection from.
CONTAINERS = {"chunk_window": "zarr", "permutation": "h5ad", "block": "h5ad"}


@dataclass
class LoadingRun:
    """Batches of a run and the numbers they were sized with."""

    method: str
    collection_key: str
    n_datasets: int
    batches: DataFrame
    batch_size: int
    chunk_size: int
    n_samples: int
    n_left_out: int
    n_collection: int
    epochs: int | None = None

    @property
    def n_batches(self) -> int:
        """Batches of an epoch."""
        return -(-(self.n_samples - self.n_left_out) // self.batch_size)


def loading_run(
    spark: SparkSession,
    manifest: DataFrame,
    collection_key: str,
    schema: T.StructType,
    method: str,
    *,
    n_datasets: int = -1,
    chunk_size: int = 256,
    preload_nchunks: int = 8,
    block_size: int = 4,
    fetch_factor: int = 16,
    batch_size: int = 4096,
    n_samples: int = -1,
    epochs: int | None = None,
    drop_last: bool = True,
    include_obs: bool = True,
    seed: int | str = 42,
    containers: dict[str, str] | None = None,
) -> LoadingRun:
    """Seeded batches of the first ``n_datasets`` shards of a collection, -1 for all.

    ``method`` is ``chunk_window``, ``permutation`` or ``block``. At most
    ``n_samples`` rows are loaded per epoch, -1 for all; rows of later runs are
    left out where they are read. With ``drop_last`` the rows of the last short
    batch, ``n_left_out``, stay out too. With ``epochs`` the batches hold so many
    passes, told apart by ``epoch``, each in its own order. Where a collection is
    kept in several containers, ``containers`` names that of each method and
    ``collection_key`` is the name without it. The stored columns other than the
    matrix are labels and come along when ``include_obs``.
    """
    if containers is not None:
        collection_key = collection_format_key(collection_key, containers[method])
    total = registry.collection_total(manifest, collection_key, n_datasets)
    windows = (F.lit(chunk_size), F.lit(preload_nchunks)) if method == "chunk_window" else ()
    sized = total.select(
        "n_samples",
        "n_shards",
        effective_batch(F.lit(batch_size), F.col("n_samples"), *windows).alias("batch_size"),
        budget(n_samples, F.col("n_samples")).alias("budget"),
    ).first()
    if sized.n_samples == 0:
        raise LookupError(f"no rows in collection {collection_key!r}")

    rows = registry.collection_scan(spark, manifest, collection_key, schema, n_datasets).drop("shard")
    if not include_obs:
        rows = rows.select(*[c for c in schemas.X_ROW.fieldNames() if c in rows.columns])
    size = sized.batch_size
    limit = sized.budget // size * size if drop_last else sized.budget
    shared = {"seed": seed, "epochs": epochs, "n_rows": sized.n_samples, "limit": limit}
    if method == "permutation":
        ordered = ordering.permutation_in_runs(rows, size * _per_run(sized.n_samples, size), **shared)
    elif method == "block":
        ordered = ordering.blocks_in_runs(rows, size, block_size=block_size, fetch_factor=fetch_factor, **shared)
    elif method == "chunk_window":
        ordered = ordering.chunk_windows_in_runs(
            rows,
            chunk_size=chunk_size,
            preload_nchunks=preload_nchunks,
            windows_per_run=_per_run(sized.n_samples, chunk_size * preload_nchunks),
            **shared,
        )
    else:
        raise ValueError(f"method must be chunk_window, permutation or block, not {method!r}")
    loaded = batches.in_batches(ordered.filter(F.col("ord") < limit), size).drop("run")
    return LoadingRun(
        method=method,
        collection_key=collection_key,
        n_datasets=sized.n_shards,
        batches=loaded,
        batch_size=size,
        chunk_size=chunk_size,
        n_samples=sized.budget,
        n_left_out=sized.budget - limit,
        n_collection=sized.n_samples,
        epochs=epochs,
    )


def resumed_batches(
    spark: SparkSession,
    index: DataFrame,
    schema: T.StructType,
    n_rows: int,
    batch_size: int,
    *,
    first_batch: int = 0,
    n_batches: int | None = None,
    seed: int | str = 42,
    drop_last: bool = True,
) -> DataFrame:
    """Batches ``first_batch`` and on of the keyed permutation of a store, with their rows.

    ``index`` is that of ``group_index.index_groups`` by ``row_id``. The batches before are not
    made again: the rows of the places from there on come from a formula, and
    only row groups that hold one of them are read.
    """
    plan = keyed_order.keyed_batches(
        spark, n_rows, batch_size, first_batch=first_batch, n_batches=n_batches, seed=seed, drop_last=drop_last
    )
    return group_index.gather(index, plan, schema)


def record_run(
    spark: SparkSession, run: LoadingRun, results_path: str, *, run_id: str, user: str, compute_spec: str = "unknown"
) -> DataFrame:
    """Load every batch of a run, keep nothing, and append its rate to the results sheet.

    The rows are those of the batches loaded, counted by the loading job itself.
    """
    loaded = F.count(F.lit(1)).alias("n")
    # The hash makes the job read every value of every row, as a training step would.
    every_value = F.sum(F.xxhash64(*run.batches.columns).cast("decimal(38,0)")).alias("h")
    started = time.perf_counter()
    counted = run.batches.agg(loaded, every_value).first().n
    seconds = time.perf_counter() - started
    # The fields of the results sheet, in its order.
    row = (
        run.method,
        run.collection_key,
        run.n_datasets,
        counted / seconds,
        run.n_samples * (run.epochs or 1),
        counted,
        run.n_collection,
        spark.sparkContext.defaultParallelism,
        run.batch_size,
        run.chunk_size,
        compute_spec,
        run_id,
        dt.datetime.now(),
        user,
    )
    record = spark.createDataFrame([row], schemas.RESULTS)
    registry.append_result_rows(record, results_path)
    return record
