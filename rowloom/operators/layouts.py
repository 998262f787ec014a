"""Layouts of X: coordinate, sparse row, dense array and wide columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import schemas
from rowloom.functions.scalars import ensure, gigabytes
from rowloom.workdir import settle

# Longest fixed-length list a dense store may hold.
MAX_LIST_VALUES = 20_000
# Wide tables cost one column per variable at planning time.
MAX_WIDE_COLUMNS = 5_000
# Dense cells per Arrow batch handed back to Spark (16 MiB of float32).
DENSE_BATCH_CELLS = 4_194_304
# Largest category code per stored integer type.
# Tasks that one category is spread over where the categories are not broadcast.
CODE_SALTS = 16
MAX_CODE = {"tinyint": 127, "smallint": 32_767}

ROW_GROUP_ROWS = "parquet.block.row.count.limit"
# Rows of a row group of wide tables, unless given.
WIDE_ROW_GROUP = 65_536
# Tasks of an exact write; above so many files a task writes several, in order.
MAX_WRITE_TASKS = 65_536
# Category codes are broadcast up to this many categories.
MAX_BROADCAST_CODES = 1_000_000


# --- conversions -----------------------------------------------------------


def sum_duplicates(entries: DataFrame) -> DataFrame:
    """One entry per (row_id, var_id); partial sums are taken before the exchange."""
    return entries.groupBy("row_id", "var_id").agg(F.sum(F.col("value").cast("double")).alias("value"))


def assemble_rows(obs: DataFrame, x_coo: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Coordinate form to sparse rows; rows of ``obs`` without counts become ``[] / []``.

    ``x_coo`` holds one entry per (row, variable), so a group is never longer
    than the variable axis, however many raw records a row has. Columns of
    ``obs`` in ``keep`` come along.
    """
    entry = F.struct(F.col("var_id").cast("int").alias("i"), F.col("value").cast("float").alias("v"))
    packed = x_coo.groupBy("row_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    no_entries = F.array().cast("array<struct<i:int,v:float>>")
    return (
        obs.select("row_id", *keep)
        .join(packed, "row_id", "left")
        .withColumn("_e", F.coalesce("_e", no_entries))
        .select("row_id", F.col("_e.i").alias("indices"), F.col("_e.v").alias("values"), *keep)
    )


def explode_rows(x_row: DataFrame) -> DataFrame:
    """Sparse rows to coordinate form; empty rows leave no entry."""
    entry = F.explode(F.arrays_zip("indices", "values")).alias("_e")
    return x_row.select("row_id", entry).select(
        "row_id", F.col("_e.indices").alias("var_id"), F.col("_e.values").alias("value")
    )


def densify(x_row: DataFrame, n_var: int) -> DataFrame:
    """Sparse rows to dense float32 arrays of length ``n_var``, zeros filled in.

    Other columns are kept, ``indices`` and ``values`` give way to ``x``. One
    numpy buffer per slice of an Arrow batch; a slice is limited by cells, so
    memory does not depend on the number of variables.
    """
    kept = [f for f in x_row.schema.fields if f.name not in ("indices", "values")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("x", T.ArrayType(T.FloatType()))])
    step = max(1, DENSE_BATCH_CELLS // n_var)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                indices = part.column("indices")
                lengths = np.diff(indices.offsets.to_numpy())
                columns = indices.flatten().to_numpy()
                if len(columns) and (columns.min() < 0 or columns.max() >= n_var):
                    raise ValueError(f"variable index outside 0..{n_var - 1}")
                dense = np.zeros((part.num_rows, n_var), dtype=np.float32)
                dense[np.repeat(np.arange(part.num_rows), lengths), columns] = (
                    part.column("values").flatten().to_numpy()
                )
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * n_var
                x = pa.ListArray.from_arrays(pa.array(ends), pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], x], names=[*names, "x"])

    return x_row.select(*names, "indices", "values").mapInArrow(fill, schema)


def sparsify(x_dense: DataFrame) -> DataFrame:
    """Dense arrays to coordinate form; zeros are not stored."""
    return (
        x_dense.select("row_id", F.posexplode("x").alias("var_id", "value")).filter(F.col("value") != 0)
    )


def wide_project(x_dense: DataFrame, var_names: list[str], label: str, keep: list[str] | None = None) -> DataFrame:
    """One float column per variable, label last."""
    if len(var_names) > MAX_WIDE_COLUMNS:
        raise ValueError(f"{len(var_names)} columns; use the dense array layout above {MAX_WIDE_COLUMNS}")
    genes = [F.col("x")[i].cast("float").alias(name) for i, name in enumerate(var_names)]
    return x_dense.select(*(keep or []), *genes, F.col(label))


def label_codes(
    obs: DataFrame, label: str, code_type: str = "int", name: str = "label_code"
) -> DataFrame:
    """Add integer codes of a category column: categories sorted, null is -1.

    Codes above what ``code_type`` holds fail the job. The small types also bound
    the categories table, which is read up to one past the bound and broadcast.
    For ``int`` the categories are sorted into a table and numbered by their place
    in its files, so any number of them works; they are broadcast up to a million and
    joined by category and salt above.
    """
    values = obs.select(F.col(label).alias("_category")).filter(F.col("_category").isNotNull()).distinct()
    if code_type in MAX_CODE:
        bound = MAX_CODE[code_type]
        rank = F.dense_rank().over(Window.orderBy("_category")) - 1
        codes = values.limit(bound + 2).select("_category", rank.alias("_code"))
        codes = codes.filter(ensure(F.col("_code") <= bound, f"too many categories for {code_type} codes"))
        codes = F.broadcast(codes)
    else:
        stored = settle(values.orderBy("_category"), "categories")
        codes = _places_in_files(stored, "_code")
        if stored.count() <= MAX_BROADCAST_CODES:
            codes = F.broadcast(codes)
        else:
            # A frequent category, and null, is spread over several tasks.
            salt = F.pmod(F.xxhash64(*obs.columns), F.lit(CODE_SALTS)).cast("int")
            salted = codes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(CODE_SALTS - 1))))
            coded = obs.withColumn("_own_salt", salt).join(
                salted, (F.col(label) == F.col("_category")) & (F.col("_own_salt") == F.col("_salt")), "left"
            )
            return _coded(coded, obs, code_type, name)
    return _coded(obs.join(codes, F.col(label) == F.col("_category"), "left"), obs, code_type, name)


def _coded(coded: DataFrame, obs: DataFrame, code_type: str, name: str) -> DataFrame:
    return coded.select(
        *[F.col(c) for c in obs.columns], F.coalesce("_code", F.lit(-1)).cast(code_type).alias(name)
    )


def _places_in_files(stored: DataFrame, name: str) -> DataFrame:
    """Rows of a Parquet table numbered from 0 in the order of its files and rows."""
    scan = stored.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index")
    )
    earlier = Window.orderBy(*file_order("_from_file")).rowsBetween(Window.unboundedPreceding, -1)
    files = scan.groupBy(F.col("_file").alias("_from_file")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = files.select("_from_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    numbered = scan.join(offsets, F.col("_file") == F.col("_from_file"))
    return numbered.select(*[F.col(c) for c in stored.columns], (F.col("_first") + F.col("_index")).alias(name))


def file_order(name: str) -> list[Column]:
    """Order of written files: number of the task, count in the task, name."""
    return [
        F.regexp_extract(name, r"part-(\d+)[^/]*$", 1).try_cast("bigint"),
        F.regexp_extract(name, r"\.c(\d+)\.[^/]*$", 1).try_cast("bigint"),
        F.col(name),
    ]


# --- writers ---------------------------------------------------------------


def row_count(df: DataFrame) -> int:
    """Rows of a table whose ``row_id`` must be 0..n-1; other ids fail. Reads that column only."""
    total = F.sum(F.col("row_id").cast("decimal(38,0)"))
    seen = df.agg(
        F.count("row_id").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), total.alias("total")
    ).first()
    if seen.n and (seen.lo, seen.hi, int(seen.total)) != (0, seen.n - 1, seen.n * (seen.n - 1) // 2):
        raise ValueError(f"row ids must be 0..n-1 for exact files: {seen.n} rows with ids from {seen.lo} to {seen.hi}")
    return seen.n


def in_order(df: DataFrame, rows_per_file: int, n_rows: int) -> DataFrame:
    """Rows laid out so that files, in the order of their names, hold full runs of ``row_id``.

    A task takes consecutive runs and tasks follow each other, so the number of a
    file's task and its count in the task give the place of its rows. All runs
    are full but the last; cutting files at ``rows_per_file`` records cuts them
    at run boundaries. A task has one run up to ``MAX_WRITE_TASKS`` runs.
    """
    runs = max(1, -(-n_rows // rows_per_file))
    runs_per_task = -(-runs // MAX_WRITE_TASKS)
    task = F.expr(f"cast(row_id div {rows_per_file * runs_per_task} as int)")
    return df.repartitionById(-(-runs // runs_per_task), task).sortWithinPartitions("row_id")


def _in_files_of(df: DataFrame, rows_per_file: int) -> DataFrame:
    return in_order(df, rows_per_file, row_count(df))


def write_sparse(x_row: DataFrame, path: str, compression: str = "zstd") -> None:
    """Both sparse forms, ``<path>/row`` and ``<path>/coo``, sorted within partitions."""
    rows = schemas.conform(x_row, schemas.X_ROW).sortWithinPartitions("row_id")
    rows.write.mode("overwrite").option("compression", compression).parquet(f"{path}/row")
    stored = x_row.sparkSession.read.schema(schemas.X_ROW).parquet(f"{path}/row")
    entries = schemas.conform(explode_rows(stored), schemas.X_COO).sortWithinPartitions("row_id", "var_id")
    entries.write.mode("overwrite").option("compression", compression).parquet(f"{path}/coo")


def write_dense(x_dense: DataFrame, path: str, compression: str = "zstd") -> None:
    """Dense arrays with default row groups."""
    schemas.conform(x_dense, schemas.X_DENSE).write.mode("overwrite").option("compression", compression).parquet(
        path
    )


def write_dense_chunked(
    x_dense: DataFrame, path: str, batch: int = 128, batches_per_file: int = 64, compression: str = "zstd"
) -> None:
    """Dense arrays and labels in row groups of exactly ``batch`` rows."""
    rows_per_file = batch * batches_per_file
    (
        _in_files_of(x_dense, rows_per_file)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option(ROW_GROUP_ROWS, batch)
        .option("compression", compression)
        .parquet(path)
    )


def write_two_level_chunks(
    x_dense: DataFrame,
    labels: DataFrame,
    path: str,
    *,
    outer: int = 128,
    inner: int = 32,
    label_outer: int = 10_000,
    label_inner: int = 1_000,
    chunks_per_file: int = 512,
    compression: str = "zstd",
) -> None:
    """Files of whole ``outer`` chunks holding row groups of ``inner`` rows; float32 and int8.

    The label store is a separate table beside the dense one, see ``label_path``.
    """
    for df, schema, target, file_rows, group_rows in (
        (x_dense, schemas.X_DENSE, path, outer, inner),
        (labels, schemas.LABELS, label_path(path), label_outer, label_inner),
    ):
        (
            _in_files_of(schemas.conform(df, schema), file_rows * chunks_per_file)
            .write.mode("overwrite")
            .option("maxRecordsPerFile", file_rows * chunks_per_file)
            .option(ROW_GROUP_ROWS, group_rows)
            .option("compression", compression)
            .parquet(target)
        )


def save_bucketed(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """Table bucketed and sorted by ``row_id``: tables with equal buckets join in place."""
    writer = df.write.mode("overwrite").bucketBy(buckets, "row_id").sortBy("row_id")
    writer.option("path", path).format("parquet").saveAsTable(name)


def label_path(dense_path: str) -> str:
    """Where the labels of a dense store are."""
    if "dense" not in dense_path:
        raise ValueError("a dense store has 'dense' in its path")
    return dense_path.replace("dense", "labels")


def write_wide(
    x_wide: DataFrame, path: str, row_group: int = WIDE_ROW_GROUP, groups_per_file: int = 64
) -> None:
    """Wide Parquet, uncompressed, in row groups of exactly ``row_group`` rows.

    ``row_id`` orders the rows and is not stored: a wide row is its features and
    its label, and its place is that of its file and its row in it.
    """
    rows_per_file = row_group * groups_per_file
    (
        _in_files_of(x_wide, rows_per_file)
        .drop("row_id")
        .write.mode("overwrite")
        .option("compression", "uncompressed")
        .option("maxRecordsPerFile", rows_per_file)
        .option(ROW_GROUP_ROWS, row_group)
        .parquet(path)
    )


# --- reports ---------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def storage_report(spark: SparkSession, layouts: dict[str, str]) -> DataFrame:
    """Size in GB (1024^3) and number of files of each named layout.

    Reads file listings only. Names may share a path; each path is sized once.
    """
    names_of: dict[str, list[str]] = {}
    for name, path in layouts.items():
        names_of.setdefault(path, []).append(name)
    report = None
    for path, names in names_of.items():
        sized = _files(spark, path).agg(
            gigabytes(F.coalesce(F.sum("length"), F.lit(0))).alias("size"), F.count(F.lit(1)).alias("n_objects")
        )
        named = sized.select(F.explode(F.array(*map(F.lit, names))).alias("storage"), "size", "n_objects")
        report = named if report is None else report.unionByName(named)
    return report


def row_groups(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """One row per Parquet row group, from the footers; data pages are not read.

    With ``key`` the least key of the group is added as ``first_key``.
    """

    def read_footers(frames):
        import pandas as pd
        from pyarrow import fs, parquet

        for frame in frames:
            found = []
            for uri in frame["path"]:
                if uri.startswith("file:"):
                    filesystem, name = fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
                else:
                    filesystem, name = fs.FileSystem.from_uri(uri)
                footer = parquet.read_metadata(name, filesystem=filesystem)
                at = footer.schema.to_arrow_schema().names.index(key) if key else None
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    least = group.column(at).statistics.min if key else None
                    found.append((uri, g, group.num_rows, least))
            yield pd.DataFrame(found, columns=["path", "row_group", "n_rows", "first_key"])

    files = _files(spark, path).select("path").filter(F.col("path").endswith(".parquet"))
    return files.mapInPandas(read_footers, "path string, row_group int, n_rows bigint, first_key bigint")


def dense_length_check(x: Column, n_var: int) -> Column:
    """Predicate that fails the job on a dense row of the wrong length."""
    if n_var > MAX_LIST_VALUES:
        raise ValueError(f"a list holds at most {MAX_LIST_VALUES} values")
    return ensure(
        F.coalesce(F.array_size(x), F.lit(-1)) == n_var,
        F.concat(F.lit(f"list of {n_var} values expected, found "), F.array_size(x).cast("string")),
    )
