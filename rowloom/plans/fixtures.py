"""Matrices, row tables and logs derived from the given tables."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import schemas, workdir
from rowloom.functions.scalars import collection_format_key
from rowloom.operators import layouts, reshard, tiles
from rowloom.operators.ordinals import grouped_positions, hex_bucket, with_ordinal
from rowloom.plans import layout_study
from rowloom.sources import group_index, registry

COLLECTION = collection_format_key("orders", "parquet")
# Rows of a shard, of its files and of their row groups: fixed, so that their number grows with the rows.
SHARD_ROWS = 4096
FILE_ROWS = 4096
GROUP_ROWS = 1024
# Entries of a row group of tiles and of a line of the store by variable: small, so that there are several.
TILE_ENTRIES = 8_192
COLUMN_ENTRIES = 4_096
# Variable lists that one task copies.
SHARDS_PER_TASK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row table without its dataset: one order is one row."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("cell_line"),
        F.col("o_orderstatus").alias("cell_states"),
    )


def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_labels(spark, sf_dir).select("row_id")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row table; the dataset of a row is the nation of its customer."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("cell_line"),
        F.col("o_orderstatus").alias("cell_states"),
        F.col("c_nationkey").alias("dataset_id"),
    )


def var(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("int").alias("var_id"),
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("var_name"),
    )


def x_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by order and part, repeated pairs summed.

    The part key keeps its type, so that ranges of ``var_id`` reach the scan.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        F.col("l_partkey").alias("var_id"),
        F.col("l_quantity").alias("value"),
    )
    return layouts.sum_duplicates(lines)


def x_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by order and nation of the supplier: a matrix of fixed width."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    entries = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("row_id"), F.col("s_nationkey").alias("var_id"), F.col("l_quantity").alias("value")
    )
    return layouts.sum_duplicates(entries)


def x_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rows with their label code."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<float>").alias("x"),
        F.col("label").cast("tinyint").alias("code"),
    )


def n_values(x: DataFrame) -> int:
    """Length of the dense rows."""
    return x.agg(F.max(F.array_size("x"))).first()[0]


def gene_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the variables of two types, in an order that is not theirs."""
    part = table(spark, sf_dir, "part").filter(F.col("p_type").isin("ECONOMY", "SMALL"))
    named = part.select(
        F.col("p_partkey"),
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("var_name"),
        F.md5(F.col("p_partkey").cast("string")).alias("_hex"),
    )
    placed = with_ordinal(
        named, order_by=["_hex", "p_partkey"], bucket=hex_bucket(F.col("_hex")), max_offsets=16**3
    )
    return schemas.conform(placed.withColumnRenamed("ord", "gene_ord"), schemas.GENE_LIST)


def datasets_of(spark: SparkSession, sf_dir: str, collection_id: str) -> DataFrame:
    """Ids of the datasets of one collection: the nations of a region."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region").filter(F.col("r_name") == collection_id)
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("dataset_id")
    )


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loaded batches, before they are numbered; their size differs by tool."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("event_type").alias("tool"),
        F.expr("user_id % 5").cast("int").alias("epoch"),
        (F.length("event_type") % 3 * 512 + 1024).cast("int").alias("n_rows"),
        F.col("value").alias("seconds"),
        F.col("ts"),
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches numbered from 0 in each tool and epoch."""
    numbered = grouped_positions(timed_events(spark, sf_dir), ["tool", "epoch"], "event_id")
    return schemas.conform(numbered.withColumnRenamed("ord", "batch_idx"), schemas.BATCH_LOG)


def write_shard_lists(names: DataFrame, n_shards: int, path: str) -> None:
    """A variable list of its own for each of ``n_shards`` shards, ``shard=<i>`` under ``path``, all of the rows of ``names``.

    The rows are written once, by place, and the files copied to every shard: writing a
    line per shard and variable would sort them all by shard.
    """
    spark = names.sparkSession
    once = f"{path}-once"
    # Neighbouring names differ little, and so take little room.
    writer = names.sortWithinPartitions("var_ord").write.option("compression", "zstd")
    writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(once)
    files = [f.path for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(once).select("path").collect()]

    def copy(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                folder = f"{path}/shard={shard}"
                store, top = group_index.file_system(folder)
                store.create_dir(top)
                for file in files:
                    source, name = group_index.file_system(file)
                    last = name.rsplit("/", 1)[1]
                    # A whole file or none, however often a task is tried.
                    part = f"{top}/.{uuid.uuid4().hex}"
                    with source.open_input_stream(name) as there, store.open_output_stream(part) as here:
                        while block := there.read(1 << 22):
                            here.write(block)
                    store.move(part, f"{top}/{last}")
            yield batch.slice(0, 0)

    spark.range(0, n_shards, 1, max(1, -(-n_shards // SHARDS_PER_TASK))).mapInArrow(copy, "id bigint").count()


# --- stores written once per application -----------------------------------


def store_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a store derived from these very tables is kept."""
    sources = [f"{sf_dir}/{source}.parquet" for source in ("orders", "lineitem", "part", "embeddings")]
    files = spark.read.format("binaryFile").load(sources).select("path", "modificationTime", "length").collect()
    stamps = [sf_dir, *sorted(f"{f.path}:{f.modificationTime}:{f.length}" for f in files)]
    return workdir.app_path(spark, f"{name}-{hashlib.md5('|'.join(stamps).encode()).hexdigest()[:12]}")


@dataclass
class Store:
    root: str
    manifest: DataFrame
    schema: object


STORE_SCHEMA = schemas.T.StructType(
    [
        *schemas.X_ROW.fields,
        schemas.T.StructField("cell_line", schemas.T.StringType()),
        schemas.T.StructField("cell_states", schemas.T.StringType()),
    ]
)


def sharded_store(spark: SparkSession, sf_dir: str) -> Store:
    """The order matrix as sparse rows with labels, in numbered shards of several files."""
    root = store_path(spark, sf_dir, "orders-store")

    def write(path: str) -> None:
        rows = layouts.assemble_rows(
            row_labels(spark, sf_dir), x_coo(spark, sf_dir), keep=["cell_line", "cell_states"]
        )
        reshard.reshard_ordered(
            schemas.conform(rows, STORE_SCHEMA),
            path,
            shard_rows=SHARD_ROWS,
            rows_per_file=FILE_ROWS,
            chunk_rows=GROUP_ROWS,
            n_rows=layouts.row_count(row_ids(spark, sf_dir)),
            compression="zstd",
        )

    workdir.write_if_absent(spark, root, write)
    manifest_path = f"{root}-manifest"

    def register(path: str) -> None:
        with workdir.few_listing_tasks(spark):
            stored = spark.read.parquet(root)
        registry.register_collection(
            registry.shard_manifest(
                stored, collection_key=COLLECTION, description="orders by part", key_prefix="orders", root=root
            ),
            path,
        )

    workdir.write_if_absent(spark, manifest_path, register)
    return Store(root, registry.read_manifest(spark, manifest_path), STORE_SCHEMA)


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the sharded store."""
    store = sharded_store(spark, sf_dir)
    return registry.collection_scan(spark, store.manifest, COLLECTION, store.schema, -1)


def layout_stores(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The dense matrix written in every layout of the study, by layout name."""
    root = store_path(spark, sf_dir, "layouts")
    # Written last, so it marks the whole set as complete.
    last = layout_study.layout_paths(root)["parquet_chunk"]
    if not workdir.is_complete(spark, last):
        dense = x_dense(spark, sf_dir)
        rows = layouts.assemble_rows(dense, layouts.sparsify(dense))
        layout_study.write_layouts(rows, dense, "code", n_values(dense), root)
    return layout_study.layout_paths(root)


def coordinate_store(spark: SparkSession, sf_dir: str) -> str:
    """The order matrix as stored entries in row order."""
    root = store_path(spark, sf_dir, "coordinates")
    # The second form is written last.
    if not workdir.is_complete(spark, f"{root}/coo"):
        layouts.write_sparse(stored_rows(spark, sf_dir), root)
    return f"{root}/coo"


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.X_COO).parquet(coordinate_store(spark, sf_dir))


def tile_store(spark: SparkSession, sf_dir: str) -> str:
    """The stored entries in tiles of rows and variables."""
    path = store_path(spark, sf_dir, "tiles")

    def write(to: str) -> None:
        tiles.write_tiles(
            stored_entries(spark, sf_dir), to, tile_rows=1024, tile_vars=64, group_entries=TILE_ENTRIES, groups_per_file=4
        )

    workdir.write_if_absent(spark, path, write)
    return path


def column_store(spark: SparkSession, sf_dir: str) -> str:
    """The stored entries by variable."""
    path = store_path(spark, sf_dir, "by-variable")
    if not workdir.is_complete(spark, f"{path}/counts"):
        tiles.write_columns(stored_entries(spark, sf_dir), path, segment=COLUMN_ENTRIES)
    return path
