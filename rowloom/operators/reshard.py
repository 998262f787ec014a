"""Re-layout of whole collections into numbered shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.layouts import ROW_GROUP_ROWS, densify, in_order, row_count
from rowloom.operators.ordering import permutation_in_runs
from rowloom.operators.slicing import gene_subset_rows


def _file_rows(shard_rows: int, rows_per_file: int) -> int:
    """Rows of a file; files do not cross shards."""
    run = min(rows_per_file, shard_rows)
    if shard_rows % run:
        raise ValueError("rows_per_file must divide shard_rows")
    return run


def _write_shards(
    rows: DataFrame,
    path: str,
    chunk_rows: int | None,
    compression: str,
    n_var: int | None = None,
    file_rows: int | None = None,
) -> None:
    """Write ``shard=<i>`` directories, rows of a file in ascending ``row_id``."""
    stored = rows if n_var is None else densify(rows, n_var)
    writer = stored.sortWithinPartitions("shard", "row_id").write.mode("overwrite").partitionBy("shard").option("compression", compression)
    if chunk_rows is not None:
        writer = writer.option(ROW_GROUP_ROWS, chunk_rows)
    if file_rows is not None:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.parquet(path)


def _shard(shard_rows: int):
    return F.call_function("div", F.col("row_id"), F.lit(shard_rows).cast("bigint")).cast("int")


def reshard_shuffled(
    rows: DataFrame,
    path: str,
    *,
    shard_rows: int = 2**21,
    chunk_rows: int = 2048,
    rows_per_file: int = 2**16,
    seed: int | str = 42,
    n_var: int | None = None,
    compression: str = "zstd",
    digits: int | None = None,
) -> None:
    """Globally shuffled shards of ``shard_rows`` rows.

    ``row_id`` of the new store is the place in the permutation; the old one is
    kept as ``source_row_id``. The payload is exchanged once, in runs of
    ``rows_per_file`` rows, and each run is one file: all files and chunks are
    full but the last, and write parallelism is the number of files, not of
    shards. Runs are spread over tasks by hash, so file names do not follow
    ``row_id``; readers go by the stored ids. With ``n_var`` rows are made dense
    after the exchange.
    """
    run_rows = _file_rows(shard_rows, rows_per_file)
    placed = permutation_in_runs(rows, run_rows, seed=seed, digits=digits).drop("run")
    renamed = placed.withColumnsRenamed({"row_id": "source_row_id", "ord": "row_id"})
    sharded = renamed.withColumn("shard", _shard(shard_rows))
    _write_shards(sharded, path, chunk_rows, compression, n_var, run_rows)


def reshard_ordered(
    rows: DataFrame,
    path: str,
    *,
    shard_rows: int = 2**21,
    chunk_rows: int = 32_768,
    n_var: int | None = None,
    compression: str = "lz4_raw",
    rows_per_file: int = 2**16,
    n_rows: int | None = None,
) -> None:
    """Shards of ``shard_rows`` rows in the order of ``row_id``, which must be 0..n-1.

    The payload is exchanged once, on runs of ``rows_per_file`` rows, each one
    file; names of files follow ``row_id`` and chunks are full but the last.
    ``n_rows`` saves a pass over the ids.
    """
    file_rows = _file_rows(shard_rows, rows_per_file)
    sharded = rows.withColumn("shard", _shard(shard_rows))
    sharded = in_order(sharded, file_rows, row_count(rows) if n_rows is None else n_rows)
    _write_shards(sharded, path, chunk_rows, compression, n_var, file_rows)


def subset_rewrite(
    store: DataFrame,
    var: DataFrame,
    gene_list: DataFrame,
    path: str,
    compression: str = "gzip",
    rows_per_file: int = 2**16,
) -> None:
    """Every shard with only the listed variables, under the same number.

    All shards in one job and, for a list that fits a lookup array, no exchange.
    Otherwise runs of ``rows_per_file`` rows are sent to one task, so that
    not every task has rows of every shard to write.
    """
    run = F.call_function("div", F.col("row_id"), F.lit(rows_per_file).cast("bigint"))
    _write_shards(gene_subset_rows(store, var, gene_list, [F.col("shard"), run]), path, None, compression)
