"""A shuffled store that takes new shards without rewriting the old.

Rows are kept by ranges of their key, md5 of seed and id, which is also the order of a full
shuffle. An append is a *run*: files of its own in the ranges its rows fall
in. Readers merge the runs of a range, so the order is that of a shuffle of all rows
at once, however they came. ``compact`` makes the runs of a range one where they
are too many; other files stay as they are.

A version is a small table of the runs of each range. It is written last, under
the next number, so a job that dies leaves the version before; files that no version
lists are never read. There is one writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.scalars import seed_text, seeded_hex
from rowloom.operators.ordinals import hex_bucket, with_ordinal
from rowloom.workdir import is_complete

_LINES = T.StructType(
    [
        T.StructField("run", T.IntegerType()),
        T.StructField("range", T.StringType()),
        T.StructField("n_rows", T.LongType()),
    ]
)


@dataclass
class GrowingStore:
    """``digits`` hex digits of the key make ``16 ** digits`` ranges; ``rows_per_file`` bounds a file."""

    spark: SparkSession
    root: str
    seed: int | str = 42
    digits: int = 2
    rows_per_file: int = 2**16

    # --- versions ---------------------------------------------------------------

    def version(self) -> int:
        """Number of the last complete version; 0 before the first append."""
        number = 0
        while is_complete(self.spark, f"{self.root}/version={number + 1}"):
            number += 1
        return number

    def runs(self) -> DataFrame:
        """``run``, ``range``, ``n_rows``: at most runs x ranges lines."""
        number = self.version()
        if not number:
            return self.spark.createDataFrame([], _LINES)
        return self.spark.read.schema(_LINES).parquet(f"{self.root}/version={number}")

    def _commit(self, number: int, lines: DataFrame) -> None:
        lines.select(*_LINES.fieldNames()).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/version={number}")

    def _write_run(self, keyed: DataFrame, number: int) -> DataFrame:
        """Files of one run by range, sorted by key; the lines of the run."""
        path = f"{self.root}/run={number}"
        # Ranges of the key are even whatever the ids are, so tasks are too.
        placed = keyed.repartitionByRange("_key", "row_id").sortWithinPartitions("range", "_key", "row_id")
        writer = placed.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", self.rows_per_file)
        writer.partitionBy("range").parquet(path)
        stored = self.spark.read.schema(placed.schema).parquet(path)
        return stored.groupBy("range").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("run", F.lit(number))

    # --- writing -----------------------------------------------------------------

    def append(self, rows: DataFrame) -> int:
        """Add rows with new ``row_id``; the number of the version. No file is rewritten."""
        number = self.version() + 1
        # Kept as text with a letter in front, so that no reader takes it for a number.
        keyed = rows.withColumn("_key", seeded_hex(seed_text(self.seed), "", F.col("row_id")))
        keyed = keyed.withColumn("range", F.concat(F.lit("r"), hex_bucket(F.col("_key"), self.digits)))
        lines = self._write_run(keyed, number)
        self._commit(number, self.runs().unionByName(lines))
        return number

    def compact(self, max_runs: int = 4) -> int:
        """Ranges of more than ``max_runs`` runs become one run; the number of the version."""
        runs = self.runs()
        number = self.version() + 1
        many = [r["range"] for r in runs.groupBy("range").count().filter(F.col("count") > max_runs).collect()]
        if not many:
            return number - 1
        old = runs.filter(F.col("range").isin(many))
        lines = self._write_run(self._read(old), number)
        self._commit(number, runs.filter(~F.col("range").isin(many)).unionByName(lines))
        return number

    # --- reading -------------------------------------------------------------------

    def _read(self, runs: DataFrame) -> DataFrame:
        paths = [f"{self.root}/run={r.run}/range={r['range']}" for r in runs.orderBy("run", "range").collect()]
        if not paths:
            raise LookupError(f"no rows in {self.root}")
        return self.spark.read.option("basePath", self.root).parquet(*paths).drop("run")

    def rows(self) -> DataFrame:
        """All rows, in no order."""
        return self._read(self.runs()).drop("_key", "range")

    def ordered(self, digits: int = 3) -> DataFrame:
        """All rows with ``ord``, their place in the shuffle of all of them: one exchange, by range of the key."""
        stored = self._read(self.runs()).withColumn("_part", hex_bucket(F.col("_key"), digits))
        placed = with_ordinal(stored, order_by=["_key", "row_id"], bucket=F.col("_part"), max_offsets=16**digits)
        return placed.drop("_key", "_part", "range")
