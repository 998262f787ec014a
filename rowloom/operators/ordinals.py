"""Global row numbers without a one-task sort.

``row_number() OVER (ORDER BY k)`` sends every row to one task.  Here rows are
numbered inside order-preserving buckets of ``k`` and shifted by the number of
rows in earlier buckets.  Only the per-bucket counts meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.workdir import settle

# Above this many rows the offsets are not hinted for broadcast and Spark picks the join.
MAX_BROADCAST_OFFSETS = 1_000_000


def hex_bucket(hex_key: Column, digits: int = 3) -> Column:
    """First hex digits of a key; at most ``16 ** digits`` even, ordered buckets."""
    return F.substring(hex_key, 1, digits)


def with_ordinal(
    rows: DataFrame,
    *,
    order_by: Sequence[str],
    bucket: Column,
    groups: Sequence[str] = (),
    weight: str | None = None,
    max_offsets: int | None = None,
) -> DataFrame:
    """Add ``ord``: the 0-based position of each row in ``order_by``, per group.

    ``bucket`` must not decrease along ``order_by``.  With ``weight`` the sum of
    that column over all earlier rows is added as ``start``.  ``max_offsets`` is
    the caller's proven bound on groups x buckets; within the limit above the
    offsets are broadcast.

    One exchange of the rows, on (groups, bucket): join and window share it. A
    group of any size is split over its buckets; null groups are one group.
    """
    groups = list(groups)
    # Strings that are never null, so that the join needs no null-safe keys of its own.
    names = [f"_k_{g}" for g in groups]
    keys = [
        F.when(F.col(g).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(g).cast("string"))).alias(name)
        for g, name in zip(groups, names)
    ]
    keyed = rows.select("*", *keys, bucket.alias("_bucket"))

    measures = [F.count(F.lit(1)).alias("_n")]
    if weight:
        measures.append(F.sum(weight).alias("_w"))
    per_bucket = keyed.groupBy(*names, "_bucket").agg(*measures)
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *names,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
        *([F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_weight_before")] if weight else []),
    )
    if max_offsets is not None and max_offsets <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)

    inside = Window.partitionBy(*names, "_bucket").orderBy(*order_by)
    ord_ = F.col("_rows_before") + F.row_number().over(inside) - 1
    columns = [*[F.col(c) for c in rows.columns], ord_.cast("bigint").alias("ord")]
    if weight:
        before = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        columns.append((F.col("_weight_before") + F.coalesce(before, F.lit(0))).cast("bigint").alias("start"))
    # Every bucket has an offset; a left join spares the null filter on the rows.
    return keyed.join(offsets, [*names, "_bucket"], "left").select(*columns)


def grouped_positions(rows: DataFrame, groups: Sequence[str], key: str, width: int = 65_536) -> DataFrame:
    """Number the rows of each group 0.. in integer key order, as ``ord``.

    Buckets are key ranges of ``width``, so one task never holds more than
    ``width`` rows of a group with distinct keys.
    """
    return with_ordinal(
        rows, order_by=[key], bucket=F.floor(F.col(key) / width).cast("bigint"), groups=groups
    )


def dense_positions(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Number the rows of a filtered matrix 0..n-1 in key order, as ``ord``.

    Rows are sorted in key ranges, one per task, and written with their task and
    place in it; only the counts of tasks are summed in one. Keys may be sparse.
    """
    sorted_ = rows.repartitionByRange(key).sortWithinPartitions(key)
    placed = settle(sorted_.withColumn("_place", F.monotonically_increasing_id()), "positions")
    task, index = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    numbered = placed.withColumn("_task", task).join(F.broadcast(first), "_task")  # one line per task
    return numbered.select(*[F.col(c) for c in rows.columns], (F.col("_first") + index).alias("ord"))
