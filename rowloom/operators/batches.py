"""From a batch plan to batches: payload, labels, budgets and user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.scalars import budget, ensure
from rowloom.operators.ordering import permutation_in_runs


def x_label_join(x: DataFrame, obs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows of X with labels of the same ``row_id``."""
    return x.join(obs.select("row_id", *labels), "row_id")


def row_gather(indices: DataFrame, x_row: DataFrame) -> DataFrame:
    """Rows of X at a list of ``(pos, row_id)``; empty rows are rows, absent ids fail.

    An id may be listed more than once.
    """
    found = indices.join(x_row, "row_id", "left")
    return found.filter(
        ensure(F.col("indices").isNotNull(), F.concat(F.lit("no row "), F.col("row_id").cast("string")))
    )


def materialise(plan: DataFrame, x_row: DataFrame, obs: DataFrame | None = None, labels: Sequence[str] = ()) -> DataFrame:
    """Plan rows with their counts and, when ``obs`` is given, labels.

    The payload moves once, on ``row_id``; stores bucketed by it do not move.
    """
    rows = plan.join(x_row, "row_id")
    return rows if obs is None else x_label_join(rows, obs, labels)


def in_batches(ordered: DataFrame, batch_size: int) -> DataFrame:
    """Cut rows with a global position ``ord`` into ``(batch_id, pos)``."""
    size = F.lit(batch_size).cast("bigint")
    return ordered.withColumns(
        {"batch_id": F.call_function("div", F.col("ord"), size), "pos": F.col("ord") % size}
    ).drop("ord")


def shuffled_batches(
    x_row: DataFrame,
    batch_size: int,
    *,
    batches_per_run: int = 64,
    seed: int | str = 42,
    epochs: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Rows of X, with any labels they carry, as seeded random batches.

    Same batches as ``global_permutation`` without ``drop_last``, for wide rows:
    these move once, and all rows of a batch and its ``run`` end in one task.
    Group by ``run`` and ``batch_id`` to use that.
    """
    run_rows = batch_size * batches_per_run
    return in_batches(permutation_in_runs(x_row, run_rows, seed=seed, epochs=epochs, digits=digits), batch_size)


def row_budget(plan: DataFrame, n_samples: int, n_collection: Column, batch_size: int) -> DataFrame:
    """The first ``n_samples`` rows of a plan in plan order; all of them for -1."""
    place = F.col("batch_id") * F.lit(batch_size).cast("bigint") + F.col("pos")
    return plan.filter(place < budget(n_samples, n_collection))


def batch_budget(plan: DataFrame, n_samples: int, batch_size: int) -> DataFrame:
    """The first ``n_samples // batch_size`` batches."""
    return plan.filter(F.col("batch_id") < n_samples // batch_size)


def drop_last(plan: DataFrame, n_rows: Column, batch_size: int) -> DataFrame:
    """Leave out the final batch when it is short."""
    return plan.filter(F.col("batch_id") < F.call_function("div", n_rows, F.lit(batch_size).cast("bigint")))


def batch_callback(
    rows: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    keys: Sequence[str] = ("batch_id",),
) -> DataFrame:
    """Apply a user function to each batch, its rows in batch order.

    A group is one batch, so its size is the batch size.
    """

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        return function(batch.sort_values("pos", ignore_index=True))

    return rows.groupBy(*keys).applyInPandas(call, schema)


def chunk_callback(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Apply a user function to each chunk as it is scanned; the result stays distributed."""

    def call(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            yield function(chunk)

    return df.mapInPandas(call, schema)
