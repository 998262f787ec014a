"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.workdir import fresh_path, remove

# What parts words: space and the controls 9 to 13, as ``bytes.split`` does.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is an empty one."""
    return [b"" if value is None else value for value in column.cast(pa.large_binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return ["" if value is None else value for value in column.to_pylist()]


def groups_of(items: Iterable, sizes: Iterable[int], limit: int) -> Iterator[list]:
    """Runs of ``items`` of at most ``limit`` in all, one item at least."""
    run: list = []
    total = 0
    for item, size in zip(items, sizes):
        if run and total + size > limit:
            yield run
            run, total = [], 0
        run.append(item)
        total += size
    if run:
        yield run


def key_column(column: Column, prefix: str = "=") -> Column:
    """A string that is never null and differs for null and any value: joins by plain equality."""
    return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(F.lit(prefix), column.cast("string")))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True when crc32 of the id as text leaves ``fold``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == fold


def write_table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back; later passes read the files."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``write_table`` whose tables go when the block ends; what outlives them is written elsewhere by then."""
    paths: list[str] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        paths.append(path)
        df.write.option("compression", "snappy").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        for path in paths:
            remove(spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, not at some later garbage collection of the driver.

    For queries that are built, and run once each, inside; Spark before 4.1 does not know the setting and keeps the files.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
