"""The sub-matrix query: rows of one collection, first variables, seeded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.ordering import global_permutation
from rowloom.operators.slicing import coord_range, obs_semi_join
from rowloom.workdir import settle


def batch_summary(
    obs: DataFrame,
    datasets: DataFrame,
    x_coo: DataFrame,
    *,
    last_var: int,
    batch_size: int = 128,
    seed: int | str = 42,
    label: str = "cell_line",
) -> DataFrame:
    """Rows, entries, counts and labels of each batch of a sub-matrix.

    The chosen row ids are written once, as numbering them takes two passes and
    the filter may be a large join. Entries are reduced to one line per row before they meet the plan, so the
    join is one to one and rows without counts remain.
    """
    cells = settle(obs_semi_join(obs, datasets).select("row_id", label), "cells")
    plan = global_permutation(cells, batch_size, seed=seed, drop_last=False)
    per_row = coord_range(x_coo, last_var).groupBy("row_id").agg(
        F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("total")
    )
    return (
        plan.join(per_row, "row_id", "left")
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("nnz"), F.lit(0)).cast("bigint").alias("nnz"),
            F.coalesce(F.sum("total"), F.lit(0.0)).alias("total_count"),
            F.count_distinct(label).alias("n_labels"),
        )
    )
