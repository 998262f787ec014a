"""Loading runs: throughput from a batch log, run lists, TSV and JSON results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom import schemas
from rowloom.workdir import settle

# The layouts of the study. The kind is the text before the first
# underscore; a layout is sparse when its name contains "sp".
LAYOUTS = [
    "h5py_sp",
    "soma_sp",
    "h5py_dense",
    "zarr_sp",
    "zarr_dense",
    "zarr_dense_chunk",
    "parquet",
    "polars",
    "parquet_chunk",
    "arrow",
    "arrow_chunk",
    "zarrV3tensorstore_dense_chunk",
    "zarrV2tensorstore_dense_chunk",
]
# Kinds that cannot be read in random order, not as sparse, or only as sparse.
NO_RANDOM = ["arrow", "polars"]
NO_SPARSE = ["arrow", "parquet", "polars", "zarrV3tensorstore", "zarrV2tensorstore"]
ONLY_SPARSE = ["soma"]

# Exact sums of seconds, whatever the order of partial sums.
_SECONDS = "decimal(18,6)"


def throughput(
    log: DataFrame,
    by: Sequence[str],
    *,
    batch_size: int | None = None,
    n_samples: int | None = None,
    skip_first: bool = False,
) -> DataFrame:
    """Samples per second and microseconds per sample of each run.

    Counts the rows of the batches it takes the seconds of: all of them, of any
    size, or those of ``batch_size`` rows alone when given; then within the first
    ``n_samples // batch_size`` if that is given too. Batch 0 of the run is left out when
    ``skip_first``.
    """
    counted = log if batch_size is None else log.filter(F.col("n_rows") == batch_size)
    if n_samples is not None:
        if batch_size is None:
            raise ValueError("a budget of rows needs the batch size")
        counted = counted.filter(F.col("batch_idx") < n_samples // batch_size + int(skip_first))
    if skip_first:
        counted = counted.filter(F.col("batch_idx") > 0)
    totals = counted.groupBy(*by).agg(*_totals(F.count(F.lit(1)), F.sum(F.col("seconds").cast(_SECONDS))))
    return _rates(totals, *by)


def _totals(n_batches: Column, seconds: Column) -> list[Column]:
    """Batches, rows and seconds of a run, under the names ``_rates`` reads."""
    return [
        n_batches.cast("bigint").alias("n_batches"),
        F.sum("n_rows").cast("bigint").alias("n_rows"),
        seconds.cast("double").alias("seconds"),
    ]


def _rates(totals: DataFrame, *by: str) -> DataFrame:
    return totals.select(
        *by,
        "n_batches",
        "n_rows",
        "seconds",
        (F.col("n_rows") / F.nullif(F.col("seconds"), F.lit(0.0))).alias("samples_per_sec"),
        (F.col("seconds") * 1e6 / F.col("n_rows")).alias("time_per_sample"),
    )


def throughput_epochs(log: DataFrame, batch_size: int | None = None) -> DataFrame:
    """Throughput of each tool and epoch, the first batch left out as warm-up."""
    return throughput(log, ["tool", "epoch"], batch_size=batch_size, skip_first=True)


def batch_intervals(
    log: DataFrame, run: str, idx: str, ts: str, start: Column, width: int = 65_536
) -> DataFrame:
    """Microseconds since the previous batch of the run, since ``start`` for the first.

    A run is cut into ranges of ``width`` indices. Inside a range the previous
    time is a ``lag``; its first batch takes the last time of the range before,
    found on one row per range. A run of any length is spread over its ranges.
    """
    # A string that is never null: the join and the window then share one exchange of the log.
    name = F.when(F.col(run).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(run).cast("string")))
    cut = log.withColumns({"_run": name, "_range": F.floor(F.col(idx) / width).cast("bigint")})
    last = cut.groupBy("_run", "_range").agg(F.max_by(ts, idx).alias("_last"))
    by_run = Window.partitionBy("_run").orderBy("_range")
    before = last.select("_run", "_range", F.lag("_last").over(by_run).alias("_before"))
    inside = Window.partitionBy("_run", "_range").orderBy(idx)
    joined = cut.join(before, ["_run", "_range"], "left")
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(inside), F.col("_before"), start)
    seconds = (
        F.extract(F.lit("DAY"), F.col("_gap")) * 86_400
        + F.extract(F.lit("HOUR"), F.col("_gap")) * 3_600
        + F.extract(F.lit("MINUTE"), F.col("_gap")) * 60
        + F.extract(F.lit("SECOND"), F.col("_gap"))
    )
    return (
        joined.withColumn("_gap", gap)
        .withColumn("interval_us", (seconds * 1_000_000).cast("bigint"))
        .select(*[F.col(c) for c in log.columns], "interval_us")
    )


def supported_runs() -> list[tuple[str, bool]]:
    """Every (layout, random) pair that its kind can be read in."""
    return [
        (name, random)
        for name in LAYOUTS
        for random in (False, True)
        if not (random and name.split("_")[0] in NO_RANDOM)
        and not ("sp" in name and name.split("_")[0] in NO_SPARSE)
        and not ("sp" not in name and name.split("_")[0] in ONLY_SPARSE)
    ]


def run_matrix(shards: DataFrame, batch_size: int = 128) -> DataFrame:
    """Every supported (layout, read order) of each shard, and its batches per pass.

    13 sequential and 10 random runs per shard; unsupported pairs are left out.
    """
    name = F.col("layout")
    kind = F.substring_index(name, "_", 1)
    listed = shards.select("*", F.explode(F.array(*map(F.lit, LAYOUTS))).alias("layout")).select(
        "*", F.explode(F.array(F.lit(False), F.lit(True))).alias("random")
    )
    runs = listed.withColumns({"kind": kind, "sparse": F.contains(name, F.lit("sp"))})
    supported = (
        ~(F.col("random") & F.col("kind").isin(NO_RANDOM))
        & ~(F.col("sparse") & F.col("kind").isin(NO_SPARSE))
        & ~(~F.col("sparse") & F.col("kind").isin(ONLY_SPARSE))
    )
    return runs.filter(supported).select(
        *[F.col(c) for c in shards.columns],
        F.concat(name, F.when(F.col("random"), F.lit("_rand")).otherwise(F.lit(""))).alias("name"),
        "kind",
        "random",
        "sparse",
        F.ceil(F.col("n_observations") / batch_size).cast("bigint").alias("n_batches"),
    )


def append_loop_log(rows: DataFrame, path: str) -> None:
    """Append ``name, epoch, seconds`` as tab-separated text without a header."""
    schemas.conform(rows, schemas.LOOP_LOG).write.mode("append").option("sep", "\t").option("header", False).csv(path)


def read_loop_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOOP_LOG).option("sep", "\t").option("header", False).csv(path)


_RUN = "struct<time_per_sample:double,samples_per_sec:double,segment:bigint,batch_times:array<double>>"
NESTED = f"map<string,map<string,{_RUN}>>"


def nested_results(log: DataFrame, batch_size: int | None = None, segment: int = 10_000) -> DataFrame:
    """JSON lines ``{tool: {epoch_k: {time_per_sample, samples_per_sec, segment, batch_times}}}``.

    Batch times of an epoch are listed in order over as many lines as it has
    segments of ``segment`` batches, so no list grows with the run. The log is
    read once: the rates of an epoch come from the sums of its written segments.
    """
    timed = log.filter(F.col("batch_idx") > 0)
    if batch_size is not None:
        timed = timed.filter(F.col("n_rows") == batch_size)
    entry = F.struct("batch_idx", "seconds")
    segments = settle(
        timed.groupBy("tool", "epoch", F.floor(F.col("batch_idx") / segment).alias("segment")).agg(
            F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["seconds"].cast("double")).alias("batch_times"),
            F.count(F.lit(1)).alias("n_batches"),
            F.sum("n_rows").cast("bigint").alias("n_rows"),
            F.sum(F.col("seconds").cast(_SECONDS)).alias("seconds"),
        ),
        "segments",
    )
    totals = segments.groupBy(F.col("tool").alias("_tool"), F.col("epoch").alias("_epoch")).agg(
        *_totals(F.sum("n_batches"), F.sum("seconds"))
    )
    same = F.col("tool").eqNullSafe(F.col("_tool")) & F.col("epoch").eqNullSafe(F.col("_epoch"))
    lines = segments.select("tool", "epoch", "segment", "batch_times").join(_rates(totals, "_tool", "_epoch"), same)
    body = F.struct("time_per_sample", "samples_per_sec", "segment", "batch_times")
    epoch_key = F.concat(F.lit("epoch_"), F.col("epoch").cast("string"))
    return lines.select(F.to_json(F.create_map("tool", F.create_map(epoch_key, body))).alias("value"))


def write_nested_results(
    log: DataFrame, path: str, batch_size: int | None = None, segment: int = 10_000
) -> None:
    nested_results(log, batch_size, segment).write.mode("overwrite").text(path)


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per (tool, epoch, batch) of written results; ``batch_ord`` counts timed batches from 0 per segment."""
    parsed = spark.read.text(path).select(F.from_json("value", NESTED).alias("doc"))
    tools = parsed.select(F.explode("doc").alias("tool", "epochs"))
    epochs = tools.select("tool", F.explode("epochs").alias("epoch_key", "run"))
    return epochs.select(
        "tool",
        "epoch_key",
        F.col("run.segment").alias("segment"),
        F.col("run.time_per_sample").alias("time_per_sample"),
        F.col("run.samples_per_sec").alias("samples_per_sec"),
        F.posexplode("run.batch_times").alias("batch_ord", "seconds"),
    )
