"""Scans over sharded Parquet stores.

A store keeps one directory per shard, ``shard=<i>``, under its root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import schemas
from rowloom.operators.layouts import MAX_LIST_VALUES, dense_length_check, file_order, label_path, row_groups
from rowloom.sources.registry import collection
from rowloom.workdir import few_listing_tasks, settle

# A collection has at most this many numbered shards, unless the caller says otherwise.
MAX_NUMBERED_SHARDS = 48
# The per-file offsets are broadcast up to this many files.
MAX_BROADCAST_FILES = 100_000
# A variable list is broadcast up to this length.
MAX_BROADCAST_VARIABLES = 2_000_000
# Of shards with other variables, so many are read again for the error.
MAX_NAMED_SHARDS = 16


def dir_suffix_scan(spark: SparkSession, path: str, suffix: str, schema: T.StructType) -> DataFrame:
    """All Parquet files of a directory tree whose names end with ``suffix``."""
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .parquet(path)
    )


def numbered_shard_scan(
    spark: SparkSession, root: str, n: int, schema: T.StructType, max_shards: int = MAX_NUMBERED_SHARDS
) -> DataFrame:
    """Shards 0..n-1 of a store, with their number in ``shard``; a missing one fails."""
    if not 0 < n <= max_shards:
        raise ValueError(f"number of shards must be between 1 and {max_shards}, not {n}")
    paths = [f"{root}/shard={i}" for i in range(n)]
    return spark.read.schema(_sharded(schema)).option("basePath", root).parquet(*paths)


def _sharded(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())])


def shard_offsets(manifest: DataFrame) -> DataFrame:
    """First global row of each shard; the manifest has one row per shard."""
    earlier = (
        Window.partitionBy("collection_key").orderBy("shard_ord").rowsBetween(Window.unboundedPreceding, -1)
    )
    return manifest.withColumn("first_row", F.coalesce(F.sum("n_observations").over(earlier), F.lit(0)))


def concat_scan(
    spark: SparkSession,
    manifest: DataFrame,
    collection_key: str,
    schema: T.StructType,
    n_datasets: int = -1,
) -> DataFrame:
    """The first shards of a collection as one matrix, see ``concat_listed``."""
    return concat_listed(spark, collection(manifest, collection_key, n_datasets), schema)


def _distinct_ends(paths: list[str]) -> tuple[list[str], int]:
    """The last folders of each path, as many as it takes to tell all paths apart, and their number."""
    parts = [path.rstrip("/").split("/") for path in paths]
    for depth in range(1, max(map(len, parts)) + 1):
        ends = ["/".join(part[-depth:]) for part in parts]
        if len(set(ends)) == len(ends) and all(len(part) > depth for part in parts):
            return ends, depth
    raise ValueError("a shard is listed twice")


def concat_listed(spark: SparkSession, shards: DataFrame, schema: T.StructType) -> DataFrame:
    """Shards as one matrix: ``row_id`` counts on from shard to shard in ``shard_ord``.

    Shards may lie anywhere: folders of the same name are told apart by those above them.

    No row moves. A shard that stores ``row_id`` is read by it: its ids must be
    consecutive, and are shifted to its place; the order of its files does not
    matter and the plan has one line per shard to join. In a store without ids
    the place of a row is that of its file, in the order of the tasks that wrote
    them, and its index in it. A shard whose row count is not the registered one is an error.
    """
    listed = shards.orderBy("shard_ord").select("shard_ord", "path", "n_observations").collect()
    if not listed:
        raise LookupError("no shards to read")
    paths = [r.path for r in listed]
    names, depth = _distinct_ends(paths)
    known = "row_id" in spark.read.parquet(paths[0]).columns
    fields = [f for f in schema.fields if f.name != "row_id"]
    own = [f.name for f in fields]
    ids = [T.StructField("row_id", T.LongType())] if known else []
    with few_listing_tasks(spark):
        stored = spark.read.schema(T.StructType([*ids, *fields])).parquet(*paths)
    file = F.col("_metadata.file_path")
    scan = stored.select(
        "*",
        F.substring_index(F.substring_index(file, "/", -1 - depth), "/", depth).alias("_dir"),
        *([] if known else [file.alias("_file"), F.col("_metadata.row_index").alias("_index")]),
    )
    if known:
        counted = scan.groupBy("_dir").agg(
            F.count("row_id").alias("n"),
            F.min("row_id").alias("lo"),
            F.max("row_id").alias("hi"),
            F.sum(F.col("row_id").cast("decimal(38,0)")).alias("total"),
        )
    else:
        files = settle(scan.groupBy("_dir", "_file").agg(F.count(F.lit(1)).alias("_n")), "files")
        counted = files.groupBy("_dir").agg(F.sum("_n").alias("n"))
    found = {r._dir: r for r in counted.collect()}  # one line per shard, like the path list
    first, places = 0, []
    for name, shard in zip(names, listed):
        n = found[name].n if name in found else 0
        if n != shard.n_observations:
            raise ValueError(
                f"row count differs from the manifest in {name}: {n} stored, {shard.n_observations} registered"
            )
        low = 0
        if known and n:
            seen = found[name]
            if seen.hi - seen.lo + 1 != n or int(seen.total) * 2 != n * (seen.lo + seen.hi):
                raise ValueError(f"row ids are not consecutive in {name}: {n} rows from {seen.lo} to {seen.hi}")
            low = seen.lo
        places.append((name, shard.shard_ord, first - low))
        first += n
    offsets = spark.createDataFrame(places, "_dir string, shard int, _shift bigint")
    if len(places) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    if known:
        placed = scan.join(offsets, "_dir").withColumn("row_id", F.col("row_id") + F.col("_shift"))
        return placed.select("row_id", *own, "shard")
    earlier = Window.partitionBy("_dir").orderBy(*file_order("_file")).rowsBetween(Window.unboundedPreceding, -1)
    by_file = files.join(offsets, "_dir").select(
        "_file", "shard", (F.col("_shift") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_first")
    )
    if len(stored.inputFiles()) <= MAX_BROADCAST_FILES:
        by_file = F.broadcast(by_file)
    numbered = scan.join(by_file, "_file").withColumn("row_id", F.col("_first") + F.col("_index"))
    return numbered.select("row_id", *own, "shard")


def concat_shards(frames: list[DataFrame]) -> DataFrame:
    """Bag union of separately loaded shards, numbered in list order."""
    numbered = [df.withColumn("shard", F.lit(i)) for i, df in enumerate(frames)]
    return reduce(DataFrame.unionByName, numbered)


def checked_concat(x: DataFrame, var: DataFrame) -> DataFrame:
    """The shards of ``x`` as one, after asserting equal ordered variable lists.

    ``var(shard, var_ord, var_name)`` holds each shard's list. Lists are equal
    when every (position, name) occurs in every shard. Each line is compared with
    the list of one shard where it is read, and a bit a place tells which
    were met: no list is ever collected, and what is exchanged is one line for
    ``64`` places of a shard. Shards that are not equal by this, and lists with nulls or
    several names at a place, are counted by pair.
    """
    lists = var.select("shard", "var_ord", "var_name")
    any_line = lists.filter(F.col("shard").isNotNull()).head(1)
    if not any_line:
        doubtful = lists
    else:
        shard = any_line[0].shard
        unlike = _shards_unlike(lists, shard)
        if unlike is not None and not unlike:
            return x
        if unlike is None or None in unlike:
            doubtful = lists
        else:
            doubtful = lists.filter(F.col("shard").isin(shard, *unlike[:MAX_NAMED_SHARDS]))
    n_shards = doubtful.agg(F.count_distinct("shard")).first()[0]
    differing = doubtful.distinct().groupBy("var_ord", "var_name").count().filter(F.col("count") != n_shards)
    first = differing.head(1)
    if first:
        raise ValueError(f"shards have different variables, e.g. {first[0].var_name} at {first[0].var_ord}")
    return x


def _shards_unlike(lists: DataFrame, shard) -> list | None:
    """The shards whose list is not that of ``shard``; None where that list has nulls or several names at a place."""
    own = lists.filter(F.col("shard") == shard).select("var_ord", F.col("var_name").alias("_own")).distinct()
    own = settle(own, "variable-list")
    seen = own.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("var_ord").alias("places"), F.count("_own").alias("names")
    ).first()
    if not seen.n == seen.places == seen.names:
        return None
    if seen.n <= MAX_BROADCAST_VARIABLES:
        own = F.broadcast(own)
    hit = F.coalesce(F.col("var_name") == F.col("_own"), F.lit(False))
    bit = F.expr("shiftleft(1L, cast(var_ord & 63 as int))")
    met = lists.join(own, "var_ord", "left").groupBy("shard", F.shiftright("var_ord", 6).alias("_block"))
    met = met.agg(F.bit_or(F.when(hit, bit).otherwise(F.lit(0).cast("bigint"))).alias("_bits"), F.max(~hit).alias("_other"))
    by_shard = met.groupBy("shard").agg(F.sum(F.bit_count("_bits")).alias("n"), F.max("_other").alias("other"))
    return [r.shard for r in by_shard.filter((F.col("n") != seen.n) | F.col("other")).collect()]  # one line per shard


def sequence_digests(var: DataFrame, *, segment: int = 1_024, by_segment: bool = False) -> DataFrame:
    """One line per shard for its ordered variable list: ``n_var`` and ``digest``; or one per segment of it.

    The digest is the sum of a hash of (place, name) over the list. So it tells
    the order, and digests of segments or of parts made apart add up to that of the list.
    """
    hashed = F.conv(F.substring(F.md5(F.concat(F.col("var_ord").cast("string"), F.lit(":"), "var_name")), 1, 15), 16, 10)
    keys = [F.col("shard")]
    if by_segment:
        keys.append(F.call_function("div", F.col("var_ord").cast("bigint"), F.lit(segment).cast("bigint")).alias("segment"))
    return var.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_var"), F.sum(hashed.cast("decimal(38,0)")).alias("digest"))


def first_difference(var: DataFrame, segment: int = 1_024) -> tuple | None:
    """``(shard, place, name, expected)`` of the first place where a list differs from that of the first shard.

    None when all lists are equal. Shards are compared by one line each; only the first
    segment in which the first differing shard departs is read by name.
    """
    lines = sequence_digests(var)
    base = var.agg(F.min("shard")).first()[0]
    if base is None:
        return None
    own = lines.filter(F.col("shard") == base).first()
    differs = (F.col("n_var") != own.n_var) | (F.col("digest") != F.lit(own.digest))
    shard = lines.filter(differs).agg(F.min("shard")).first()[0]
    if shard is None:
        return None
    pair = var.filter(F.col("shard").isin(base, shard))
    parts = sequence_digests(pair, segment=segment, by_segment=True).groupBy("segment")
    parts = parts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_var", "digest").alias("kinds"))
    at = parts.filter((F.col("n") < 2) | (F.col("kinds") > 1)).agg(F.min("segment")).first()[0]
    inside = pair.filter(F.col("var_ord").between(at * segment, (at + 1) * segment - 1))
    names = inside.groupBy("var_ord").agg(
        F.max(F.when(F.col("shard") == shard, F.col("var_name"))).alias("name"),
        F.max(F.when(F.col("shard") == base, F.col("var_name"))).alias("expected"),
    )
    line = names.filter(~F.col("name").eqNullSafe(F.col("expected"))).orderBy("var_ord").first()
    return shard, line.var_ord, line.name, line.expected


def digest_checked_concat(x: DataFrame, var: DataFrame) -> DataFrame:
    """``checked_concat`` by one digest per shard; the error names the first difference."""
    found = first_difference(var)
    if found is not None:
        shard, place, name, expected = found
        raise ValueError(f"shards have different variables: {name} instead of {expected} at {place} of shard {shard}")
    return x


def obs_columns(spark: SparkSession, path: str, columns: list[str], include_obs: bool = True) -> DataFrame:
    """Chosen columns of the row table; only the ids when ``include_obs`` is off."""
    wanted = columns if include_obs else []
    fields = [f for f in schemas.OBS.fields if f.name == "row_id" or f.name in wanted]
    unknown = set(wanted) - {f.name for f in schemas.OBS.fields}
    if unknown:
        raise ValueError(f"no such row column: {sorted(unknown)}")
    return spark.read.schema(T.StructType(fields)).parquet(path).select(*[f.name for f in fields])


def layer_select(x: DataFrame, measurement: str = "RNA", layer: str = "raw") -> DataFrame:
    """One measurement and layer of a store partitioned by both."""
    return x.filter((F.col("measurement") == measurement) & (F.col("layer") == layer)).drop("measurement", "layer")


def drop_layer(x: DataFrame, layer: str = "raw") -> DataFrame:
    """The store without one layer."""
    return x.filter(F.col("layer") != layer)


def read_with_labels(spark: SparkSession, dense_path: str) -> DataFrame:
    """A dense store joined with the label store that belongs to it."""
    x = spark.read.schema(schemas.X_DENSE).parquet(dense_path)
    labels = spark.read.schema(schemas.LABELS).parquet(label_path(dense_path))
    return x.join(labels, "row_id")


def wide_scan_split(wide: DataFrame) -> DataFrame:
    """Features (all columns but the last) as one array, the last column as ``label``."""
    *genes, label = wide.columns
    return wide.select(F.array(*genes).alias("x"), F.col(label).alias("label"))


def row_group_scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet directory with their place, row groups of any size.

    Adds ``row_id`` (position in the order of files, see ``file_order``), ``group_id`` (row group in the
    same order) and ``pos`` (position in the row group) before the stored
    columns. Places come from the footers; rows are numbered where they are read.
    """
    by_file = Window.partitionBy("_name").orderBy("row_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        row_groups(spark, path)
        .withColumn("_name", F.regexp_extract("path", "([^/]+)$", 1))
        .withColumn("_start", F.coalesce(F.sum("n_rows").over(by_file), F.lit(0)))
    )
    files = groups.groupBy("_name").agg(
        F.sort_array(F.collect_list("_start")).alias("_starts"), F.sum("n_rows").alias("_rows")
    )
    earlier = Window.orderBy(*file_order("_name")).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(
        "_name",
        "_starts",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first_row"),
        F.coalesce(F.sum(F.size("_starts").cast("bigint")).over(earlier), F.lit(0)).alias("_first_group"),
    )
    stored = spark.read.parquet(path)
    if len(stored.inputFiles()) <= MAX_BROADCAST_FILES:
        files = F.broadcast(files)
    scan = stored.select(
        "*",
        F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("_name"),
        F.col("_metadata.row_index").alias("_index"),
    )
    index = F.col("_index")
    placed = scan.join(files, "_name").withColumn(
        "_nth", F.size(F.filter("_starts", lambda start: start <= index))
    )
    return placed.select(
        (F.col("_first_row") + index).alias("row_id"),
        (F.col("_first_group") + F.col("_nth") - 1).alias("group_id"),
        (index - F.element_at("_starts", F.col("_nth"))).alias("pos"),
        *stored.columns,
    )


def list_column_scan(spark: SparkSession, path: str, n_var: int) -> DataFrame:
    """Dense rows from a list column; a row of another length fails the job."""
    if n_var > MAX_LIST_VALUES:
        raise ValueError(f"a list holds at most {MAX_LIST_VALUES} values")
    return spark.read.schema(schemas.X_DENSE).parquet(path).filter(dense_length_check(F.col("x"), n_var))


def gene_list_scan(spark: SparkSession, path: str) -> DataFrame:
    """The wanted variables with their place in the list."""
    return spark.read.schema(schemas.GENE_LIST).parquet(path)


def shard_of(row_id: Column, shard_rows: int) -> Column:
    return F.call_function("div", row_id, F.lit(shard_rows).cast("bigint")).cast("int")
