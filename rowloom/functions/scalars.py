"""Column expressions: seeded keys, batch size rules, names and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ensure(condition: Column, message: str | Column) -> Column:
    """A filter predicate that is true, or fails the job with ``message``."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def seed_text(seed: int | str, epoch: Column | None = None) -> Column:
    """The seed as text; each epoch draws its own order from ``seed:epoch``."""
    if epoch is None:
        return F.lit(str(seed))
    return F.concat(F.lit(f"{seed}:"), epoch.cast("string"))


def seeded_hex(seed: Column, tag: str, key: Column) -> Column:
    """md5 of ``<seed><tag>:<key>``: the same order in any engine, run or retry."""
    return F.md5(F.concat(seed, F.lit(f"{tag}:"), key.cast("string")))


def largest_divisor(value: Column, upper_bound: Column) -> Column:
    """Largest divisor of ``value`` that is at most ``upper_bound``; 1 if none."""
    top = F.least(value, upper_bound).cast("bigint")
    root = F.floor(F.sqrt(F.greatest(value, F.lit(1)).cast("double"))).cast("bigint") + 1
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), root), lambda d: value % d == 0)
    large = F.transform(small, lambda d: F.call_function("div", value, d))
    found = F.filter(F.concat(small, large), lambda d: d <= top)
    return F.when(top >= 1, F.array_max(found)).otherwise(F.lit(1)).cast("bigint")


def effective_batch(
    batch_size: Column,
    n_collection: Column,
    chunk_size: Column | None = None,
    preload_nchunks: Column | None = None,
) -> Column:
    """Batch size actually used: at least ten batches, whole batches per window.

    The window rule applies to chunk-window loading only, so it is used when the
    chunk columns are given.
    """
    tenth = F.greatest(F.lit(1).cast("bigint"), F.floor(n_collection / 10).cast("bigint"))
    size = F.when(batch_size.cast("bigint") * 10 > n_collection, tenth).otherwise(batch_size.cast("bigint"))
    if chunk_size is None or preload_nchunks is None:
        return size
    window = chunk_size.cast("bigint") * preload_nchunks.cast("bigint")
    return F.when(window % size != 0, largest_divisor(window, size)).otherwise(size)


def budget(n_samples: int, n_collection: Column) -> Column:
    """Rows to load: all of them for -1, else at most ``n_samples``."""
    if n_samples == -1:
        return n_collection
    return F.least(F.lit(n_samples).cast("bigint"), n_collection)


def shard_number(name: Column) -> Column:
    """Number of a shard named ``shard_7.parquet``, ``x_7`` or ``shard=7``."""
    return F.regexp_extract(name, r"[_=]([0-9]+)(?:\.[A-Za-z0-9]+)?$", 1).cast("int")


def collection_format_key(name: str, suffix: str) -> str:
    """Collections are stored once per container, as ``<name>_<container>``."""
    return f"{name}_{suffix}"


def gigabytes(n_bytes: Column) -> Column:
    return n_bytes / F.lit(float(1024**3))


def part_rows(part_bytes: int, n_values: int, value_bytes: int = 4) -> int:
    """Rows of ``n_values`` fixed-width values that fit a part of ``part_bytes``."""
    return max(1, part_bytes // (n_values * value_bytes))
