"""The layout study: write every layout and pass over each in its batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import layouts, metrics, ordering, slicing
from rowloom.sources import scans
from rowloom.workdir import settle

# Rows of a chunk in the chunked layouts.
CHUNK_ROWS = 128
# Layouts read by row group: rows have no id of their own, a row group is a batch.
ROW_GROUP_KINDS = ["parquet"]
# Layouts read in file order only.
FILE_ORDER_KINDS = ["arrow", "polars"]


def write_study(
    x_row: DataFrame, obs: DataFrame, label: str, root: str, *, nrows: int | None = None, ncols: int | None = None
) -> None:
    """Write a matrix, or its first rows and variables, in every layout.

    Rows are those of ``x_row`` with ids 0..n-1. Label codes join the sparse rows, before these
    are made dense; the dense form is made once and written from there.
    """
    if ncols is None:
        ncols = x_row.agg(F.max(F.array_max("indices"))).first()[0] + 1
    codes = layouts.label_codes(obs.select("row_id", label), label, "tinyint", name="code").select("row_id", "code")
    part = slicing.head_slice(x_row.select("row_id", "indices", "values"), nrows, ncols)
    part = settle(part.join(codes, "row_id"), "study_rows")
    dense = settle(layouts.densify(part, ncols), "study_dense")
    write_layouts(part, dense, "code", ncols, root)


def write_layouts(x_row: DataFrame, x_dense: DataFrame, label: str, n_var: int, root: str) -> None:
    """Write one matrix in every layout of the study under ``root``.

    ``x_dense`` carries the integer column ``label``. Several layout names stand
    for one store, which is written once.
    """
    names = [f"g{i}" for i in range(n_var)]
    codes = x_dense.select("row_id", F.col(label).alias("code"))
    wide = layouts.wide_project(x_dense, names, label, keep=["row_id"])
    layouts.write_sparse(x_row, f"{root}/sparse")
    layouts.write_dense(x_dense, f"{root}/dense")
    layouts.write_dense_chunked(x_dense, f"{root}/dense_chunk", batch=CHUNK_ROWS)
    layouts.write_two_level_chunks(x_dense, codes, f"{root}/sharded_dense_chunk", outer=CHUNK_ROWS, inner=32)
    layouts.write_wide(wide, f"{root}/wide")
    layouts.write_wide(wide, f"{root}/wide_chunk", row_group=CHUNK_ROWS)


def layout_paths(root: str) -> dict[str, str]:
    """Where ``write_layouts`` puts each layout."""
    return {
        "h5py_sp": f"{root}/sparse/row",
        "soma_sp": f"{root}/sparse/coo",
        "h5py_dense": f"{root}/dense",
        "zarr_sp": f"{root}/sparse/row",
        "zarr_dense": f"{root}/dense",
        "zarr_dense_chunk": f"{root}/dense_chunk",
        "parquet": f"{root}/wide",
        "polars": f"{root}/wide",
        "parquet_chunk": f"{root}/wide_chunk",
        "arrow": f"{root}/wide",
        "arrow_chunk": f"{root}/wide_chunk",
        "zarrV3tensorstore_dense_chunk": f"{root}/sharded_dense_chunk",
        "zarrV2tensorstore_dense_chunk": f"{root}/dense_chunk",
    }


def layout_batches(
    spark: SparkSession,
    name: str,
    path: str,
    obs: DataFrame,
    label: str,
    *,
    random: bool,
    batch_size: int = 128,
    seed: int | str = 42,
    epochs: int | None = None,
) -> DataFrame:
    """Batches of one layout with labels, under the read order of its kind.

    Row-keyed layouts take their labels from ``obs`` by ``row_id`` and keep the
    short last batch. Wide layouts hold features and label; their batches are row
    groups, or runs of rows in file order.
    """
    kind = name.split("_")[0]
    if kind in FILE_ORDER_KINDS or kind in ROW_GROUP_KINDS:
        rows = scans.row_group_scan(spark, path)
        if kind in FILE_ORDER_KINDS:
            if random:
                raise ValueError(f"{kind} does not support random access")
            return ordering.batch_sequential(ordering.with_epochs(rows.drop("group_id", "pos"), epochs), batch_size)
        if random:
            return ordering.group_shuffle(rows, "group_id", seed=seed, epochs=epochs)
        return ordering.with_epochs(rows.withColumnRenamed("group_id", "batch_id"), epochs)

    stored = spark.read.parquet(path)
    if "var_id" in stored.columns:
        stored = layouts.assemble_rows(obs, stored)
    payload = [c for c in ("indices", "values", "x") if c in stored.columns]
    rows = obs.select("row_id", label)
    plan = (
        ordering.global_permutation(rows, batch_size, seed=seed, epochs=epochs, drop_last=False)
        if random
        else ordering.batch_sequential(ordering.with_epochs(rows, epochs), batch_size)
    )
    return plan.join(stored.select("row_id", *payload), "row_id")


def _values(rows: DataFrame, label: str) -> Column:
    """Sum of the values of a row in whole millionths, the same in any layout and order."""

    def whole(v: Column) -> Column:
        return F.round(v.cast("double") * 1e6).cast("bigint")

    for name in ("x", "values"):
        if name in rows.columns:
            return F.aggregate(F.transform(name, whole), F.lit(0).cast("bigint"), lambda s, v: s + v)
    features = [c for c in rows.columns if c not in ("row_id", "batch_id", "pos", "epoch", label)]
    return reduce(lambda s, c: s + whole(F.col(c)), features, F.lit(0).cast("bigint"))


def layout_passes(
    spark: SparkSession, paths: dict[str, str], obs: DataFrame, label: str, *, epochs: int = 4, batch_size: int = 128
) -> DataFrame:
    """``epochs`` passes over every supported (layout, order): what each batch holds.

    One DataFrame over all runs, one line per run, epoch and batch, with its rows
    and the sums of its labels and values.
    """
    passes = []
    for layout, random in metrics.supported_runs():
        loaded = layout_batches(
            spark, layout, paths[layout], obs, label, random=random, batch_size=batch_size, epochs=epochs
        )
        passes.append(
            loaded.groupBy(F.lit(layout + "_rand" * random).alias("name"), "epoch", "batch_id").agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.sum(label).alias("label_sum"),
                F.sum(_values(loaded, label)).alias("value_sum"),
            )
        )
    return reduce(DataFrame.unionByName, passes)
