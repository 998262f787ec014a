"""From source shards to registered collections: shuffle, subset, re-layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import workdir
from rowloom.operators import reshard
from rowloom.sources import registry, scans


def _stored(spark: SparkSession, root: str) -> DataFrame:
    with workdir.few_listing_tasks(spark):
        return spark.read.parquet(root)


def _register(spark: SparkSession, root: str, manifest_path: str, key: str, description: str, prefix: str) -> None:
    """Register a written store unless its shards are in the manifest already."""
    if workdir.is_complete(spark, manifest_path):
        known = registry.read_manifest(spark, manifest_path).filter(F.col("collection_key") == key)
        if known.limit(1).count():
            return
    rows = registry.shard_manifest(
        _stored(spark, root), collection_key=key, description=description, key_prefix=prefix, root=root
    )
    registry.register_collection(rows, manifest_path)


def prepare_collections(
    spark: SparkSession,
    source: DataFrame,
    shard_keys: list[str],
    schema: T.StructType,
    var: DataFrame,
    gene_list: DataFrame,
    out: str,
    *,
    name: str,
    shard_rows: int = 2**21,
    shuffle_chunk: int = 2048,
    relayout_chunk: int = 32_768,
    rows_per_file: int = 2**16,
    seed: int | str = 42,
) -> DataFrame:
    """Shuffled, gene-subset and re-laid-out collections of a list of source shards.

    ``source`` is the manifest the shards are registered in; they are joined in
    list order. Each store is written once: a complete one is kept, a half
    written one is written again. Returns the new manifest.
    """
    listed = registry.uid_list_scan(spark, source, shard_keys)
    chosen = listed.select(
        F.lit(name).alias("collection_key"), "description", F.col("list_ord").alias("shard_ord"), "shard_key", "path",
        "n_observations",
    )
    n_rows = listed.agg(F.sum("n_observations")).first()[0]
    manifest_path = f"{out}/manifest"

    def shuffle(path: str) -> None:
        rows = scans.concat_listed(spark, chosen, schema).drop("shard")
        reshard.reshard_shuffled(
            rows, path, shard_rows=shard_rows, chunk_rows=shuffle_chunk, rows_per_file=rows_per_file, seed=seed
        )

    shuffled = f"{out}/{name}_sharded"
    workdir.write_if_absent(spark, shuffled, shuffle, n_rows)
    _register(spark, shuffled, manifest_path, f"{name}_sharded", "shuffled and sharded", f"{name}_sharded")

    def subset(path: str) -> None:
        run_rows = min(rows_per_file, shard_rows)
        reshard.subset_rewrite(_stored(spark, shuffled), var, gene_list, path, rows_per_file=run_rows)

    subset_root = f"{out}/{name}_sharded_subset"
    workdir.write_if_absent(spark, subset_root, subset, n_rows)
    _register(
        spark, subset_root, manifest_path, f"{name}_sharded_subset", "shuffled, listed variables", f"{name}_subset"
    )

    def relayout(path: str) -> None:
        reshard.reshard_ordered(
            _stored(spark, shuffled).drop("shard"),
            path,
            shard_rows=shard_rows,
            chunk_rows=relayout_chunk,
            rows_per_file=rows_per_file,
            n_rows=n_rows,
        )

    chunked = f"{out}/{name}_chunked"
    workdir.write_if_absent(spark, chunked, relayout, n_rows)
    _register(spark, chunked, manifest_path, f"{name}_chunked", "shuffled, chunked", f"{name}_chunked")
    mini = f"{name}_chunked_mini"
    manifest = registry.read_manifest(spark, manifest_path)
    if not manifest.filter(F.col("collection_key") == mini).limit(1).count():
        registry.register_first_shard(spark, manifest_path, f"{name}_chunked", mini, "first shard of the chunked store")
    return registry.read_manifest(spark, manifest_path)
