"""Collections of shards and the results sheet, kept as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import schemas
from rowloom.functions.scalars import ensure
from rowloom.workdir import few_listing_tasks


def unique_lookup(df: DataFrame, condition: Column, required: bool = True) -> DataFrame:
    """The one record that meets ``condition``.

    Two matches fail the job; so does none, unless ``required`` is off. At most
    two rows leave the scan.
    """
    found = df.filter(condition).limit(2)
    record = F.struct(*[F.col(c) for c in df.columns])
    checked = found.agg(F.count(F.lit(1)).alias("_n"), F.first(record).alias("_r"))
    several = F.concat(F.lit("exactly one record expected, found at least "), F.col("_n").cast("string"))
    # One predicate: a second filter on the count would let the optimizer fold the check away.
    one = F.when(F.col("_n") == 1, F.lit(True))
    if not required:
        one = one.when(F.col("_n") == 0, F.lit(False))
    checked = checked.filter(one.otherwise(F.raise_error(several).cast("boolean")))
    return checked.select("_r.*")


def shard_manifest(
    rows: DataFrame,
    *,
    collection_key: str,
    description: str,
    key_prefix: str,
    root: str,
    shard: str = "shard",
) -> DataFrame:
    """Manifest rows of a store: one per shard, ordered by shard number, with counts."""
    counts = rows.groupBy(F.col(shard).cast("int").alias("shard_ord")).agg(
        F.count(F.lit(1)).alias("n_observations")
    )
    number = F.col("shard_ord").cast("string")
    manifest = counts.select(
        F.lit(collection_key).alias("collection_key"),
        F.lit(description).alias("description"),
        "shard_ord",
        F.concat(F.lit(f"{key_prefix}/shard_"), number).alias("shard_key"),
        F.concat(F.lit(f"{root}/shard="), number).alias("path"),
        "n_observations",
    )
    return schemas.conform(manifest, schemas.MANIFEST)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).parquet(path)


def register_collection(manifest_rows: DataFrame, manifest_path: str) -> None:
    """Append the shards of a collection to the manifest."""
    schemas.conform(manifest_rows, schemas.MANIFEST).coalesce(1).write.mode("append").parquet(manifest_path)


def register_first_shard(
    spark: SparkSession, manifest_path: str, collection_key: str, new_key: str, description: str
) -> None:
    """Register a small collection made of the first shard of another."""
    first = read_manifest(spark, manifest_path).filter(
        (F.col("collection_key") == collection_key) & (F.col("shard_ord") == 0)
    )
    register_collection(
        first.withColumn("collection_key", F.lit(new_key)).withColumn("description", F.lit(description)),
        manifest_path,
    )


def collection(manifest: DataFrame, collection_key: str, n_datasets: int = -1) -> DataFrame:
    """Manifest rows of the first ``n_datasets`` shards; -1 takes all."""
    chosen = manifest.filter(F.col("collection_key") == collection_key)
    return chosen if n_datasets == -1 else chosen.filter(F.col("shard_ord") < n_datasets)


def collection_scan(
    spark: SparkSession,
    manifest: DataFrame,
    collection_key: str,
    schema: T.StructType,
    n_datasets: int = -1,
) -> DataFrame:
    """Rows of the first shards of a collection, read from their registered paths.

    The path list is one entry per shard and is all the driver sees. An unknown
    key fails.
    """
    shards = collection(manifest, collection_key, n_datasets).orderBy("shard_ord").select("path").collect()
    if not shards:
        raise LookupError(f"no collection {collection_key!r}")
    paths = [s.path for s in shards]
    root = paths[0].rsplit("/", 1)[0]
    sharded = T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())])
    with few_listing_tasks(spark):
        return spark.read.schema(sharded).option("basePath", root).parquet(*paths)


def collection_total(manifest: DataFrame, collection_key: str, n_datasets: int = -1) -> DataFrame:
    """Rows and shards of a collection, from the manifest alone."""
    return collection(manifest, collection_key, n_datasets).agg(
        F.coalesce(F.sum("n_observations"), F.lit(0)).alias("n_samples"), F.count(F.lit(1)).alias("n_shards")
    )


def uid_list_scan(spark: SparkSession, manifest: DataFrame, shard_keys: list[str]) -> DataFrame:
    """The manifest rows of an explicit list of shards, with their place in the list.

    Every key must be registered once. The list is typed in by a caller, so it is
    small; the manifest has one row per shard.
    """
    wanted = spark.createDataFrame(list(enumerate(shard_keys)), "list_ord int, shard_key string")
    found = manifest.groupBy("shard_key").agg(F.count(F.lit(1)).alias("_n"))
    checked = wanted.join(found, "shard_key", "left")
    checked = checked.filter(
        ensure(F.col("_n").eqNullSafe(F.lit(1)), F.concat(F.lit("not one shard: "), F.col("shard_key")))
    )
    return checked.drop("_n").join(manifest, "shard_key").orderBy("list_ord")


def append_result_rows(rows: DataFrame, path: str) -> None:
    """Append typed rows to the results sheet, creating it when absent."""
    schemas.conform(rows, schemas.RESULTS).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).parquet(path)
