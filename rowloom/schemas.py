"""Explicit schema of every table; nothing is inferred on read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("cell_line", T.StringType()),
        T.StructField("cell_states", T.StringType()),
        T.StructField("dataset_id", T.IntegerType()),
    ]
)

VAR = T.StructType(
    [
        T.StructField("var_id", T.IntegerType()),
        T.StructField("var_name", T.StringType()),
    ]
)

X_COO = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("var_id", T.IntegerType()),
        T.StructField("value", T.FloatType()),
    ]
)

X_ROW = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.FloatType())),
    ]
)

X_DENSE = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("x", T.ArrayType(T.FloatType())),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("code", T.ByteType()),
    ]
)

GENE_LIST = T.StructType(
    [
        T.StructField("gene_ord", T.IntegerType()),
        T.StructField("var_name", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("collection_key", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("shard_ord", T.IntegerType()),
        T.StructField("shard_key", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_observations", T.LongType()),
    ]
)

# The 13 typed fields of the results sheet, in sheet order. The sample counts
# are BIGINT so that collections above 2**31 rows fit.
RESULTS = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("n_datasets", T.IntegerType()),
        T.StructField("n_samples_per_sec", T.DoubleType()),
        T.StructField("n_samples_requested", T.LongType()),
        T.StructField("n_samples_loaded", T.LongType()),
        T.StructField("n_samples_collection", T.LongType()),
        T.StructField("num_workers", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("compute_spec", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("user", T.StringType()),
    ]
)

LOOP_LOG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)

BATCH_LOG = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("batch_idx", T.LongType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to exactly the fields of ``schema``, cast to its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
