"""Where written tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one on ``local`` only.

    On a cluster it must be a folder that the driver and all executors share: a
    store, or a ``file:`` path on a mount that all of them have.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or "-cluster" in spark.conf.get("spark.master", ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="rowloom-")
    return _LOCAL_DIRS[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rowloom/{spark.conf.get('spark.app.id')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else writes to."""
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def app_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that this application reuses."""
    return f"{_app_dir(spark)}/{name}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder.

    Call it when the results that read from there have been consumed, at the end
    of an application or between its jobs.
    """
    from pyarrow import fs

    path = _app_dir(spark)
    store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if store.get_file_info(name).type == fs.FileType.Directory:
        store.delete_dir(name)


def remove(spark: SparkSession, path: str) -> None:
    """Remove one table that this application has written and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders of stores read inside are listed by a few tasks a core; otherwise Spark starts a task for each folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; lists it and reads nothing."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def is_complete(spark: SparkSession, path: str, expected_rows: int | None = None) -> bool:
    """True when a Parquet write to ``path`` committed and holds the rows it should.

    A directory alone does not count as done: a job that died half way leaves one.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return False
    if expected_rows is None:
        return True
    with few_listing_tasks(spark):
        stored = spark.read.parquet(path)
    return stored.count() == expected_rows


def write_if_absent(
    spark: SparkSession,
    path: str,
    write: Callable[[str], object],
    expected_rows: int | None = None,
) -> bool:
    """Run ``write(path)`` unless a complete store is there; True when it ran."""
    if is_complete(spark, path, expected_rows):
        return False
    write(path)
    return True


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts its lineage.

    For narrow intermediate results that several passes read. Lost executors do
    not take the table with them.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
