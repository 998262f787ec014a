"""Sets of rows as bitmaps: tested where a matrix is read, so that other rows are not moved.

A set is a table of ``bucket`` and ``words``: a bucket stands for 32,768 consecutive ids,
its words are 512 integers of 64 bits, one bit an id. A matrix looks its bucket
up in the broadcast set and tests one bit. A larger set is looked up in slices of
``MAX_BROADCAST_BUCKETS`` buckets; each slice reads the ids of its own range only. Sets
that are no smaller as bitmaps are joined as ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.slicing import coord_range
from rowloom.workdir import settle

BUCKET_IDS = 32_768
_WORD_BYTES = 8
_WORDS = BUCKET_IDS // 64
# Buckets of one slice: 4 kB each, 64 MB in all.
MAX_BROADCAST_BUCKETS = 16_384
# A bucket pays when it holds so many rows; sets of scattered ids are joined as ids.
LEAST_ROWS_A_BUCKET = 64
MAX_SLICES = 256


def row_bitmaps(ids: DataFrame, key: str = "row_id") -> DataFrame:
    """``bucket`` and ``bits``: the set of the ids in ``key``; repeated ids count once, nulls not.

    Partial bitmaps are made before the exchange, so what moves is a bitmap per task and bucket.
    """
    known = ids.filter(F.col(key).isNotNull())
    return known.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")
    )


def union_of(sets: list[DataFrame]) -> DataFrame:
    """The ids that are in any of the sets."""
    stacked = reduce(DataFrame.unionByName, sets)
    return stacked.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, *groups: str) -> DataFrame:
    """Number of ids, for each of ``groups`` or in all, from the bitmaps alone."""
    return sets.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).alias("n_rows"))


def _words(bits: Column) -> Column:
    """The bytes of a bitmap as signed 64-bit integers, most significant byte first."""

    def word(i: Column) -> Column:
        eight = F.substring(bits, i * _WORD_BYTES + 1, F.lit(_WORD_BYTES))
        return F.conv(F.hex(eight), 16, -10).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), word)


def _has(words: Column, key: Column) -> Column:
    """Whether the bit of an id is set: bit ``p % 8`` of byte ``p div 8``."""
    at = F.bitmap_bit_position(key).cast("int")
    byte = F.call_function("mod", F.shiftright(at, 3), F.lit(_WORD_BYTES))
    bit = (F.lit(_WORD_BYTES - 1) - byte) * 8 + at % 8
    return F.getbit(F.get(words, F.shiftright(at, 6)), bit) == 1


def keep_rows(x: DataFrame, bitmaps: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of ``x`` whose id is in a set (see ``row_bitmaps``); ``x`` is not exchanged.

    The set is written once. Where its buckets hold few rows each, it is no smaller
    than its ids, and these are semi-joined instead; the rows are the same.
    """
    stored = settle(bitmaps, "row-set")
    bucket = F.col("bucket")
    slice_ = F.floor(bucket / MAX_BROADCAST_BUCKETS).cast("bigint")
    seen = stored.agg(
        F.count(F.lit(1)).alias("buckets"), F.sum(F.bitmap_count("bits")).alias("rows"), F.count_distinct(slice_).alias("slices")
    ).first()
    if not seen.buckets:
        return x.filter(F.lit(False))
    scattered = seen.buckets > MAX_BROADCAST_BUCKETS and seen.rows < seen.buckets * LEAST_ROWS_A_BUCKET
    if scattered or seen.slices > MAX_SLICES:
        return x.join(row_ids(stored).withColumnRenamed("row_id", key), key, "left_semi")
    words = stored.select(bucket.alias("_bucket"), _words(F.col("bits")).alias("_words"))
    numbers = [r[0] for r in stored.select(slice_).distinct().orderBy(slice_).collect()]
    kept = []
    for number in numbers:
        low, high = number * MAX_BROADCAST_BUCKETS, (number + 1) * MAX_BROADCAST_BUCKETS
        part = x if len(numbers) == 1 else x.filter(F.col(key).between(*_id_range(low, high)))
        own = words.filter((F.col("_bucket") >= low) & (F.col("_bucket") < high))
        # At most MAX_BROADCAST_BUCKETS bitmaps.
        hit = part.withColumn("_bucket", F.bitmap_bucket_number(key)).join(F.broadcast(own), "_bucket")
        kept.append(hit.filter(_has(F.col("_words"), F.col(key))).select(*x.columns))
    return reduce(DataFrame.unionByName, kept)


def _id_range(low: int, high: int) -> tuple[int, int]:
    """Least and greatest id of the buckets from ``low`` to ``high - 1``; ids above 0 start at bucket 1."""
    first = (low - 1) * BUCKET_IDS + 1 if low > 0 else -((1 - low) * BUCKET_IDS - 1)
    last = (high - 1) * BUCKET_IDS if high > 1 else -(1 - high) * BUCKET_IDS
    return first, last


def row_ids(bitmaps: DataFrame) -> DataFrame:
    """The ids of a set, as ``row_id``."""
    words = bitmaps.select("bucket", F.posexplode(_words(F.col("bits"))).alias("_nth", "_word"))
    bits = words.filter(F.col("_word") != 0).select(
        "bucket", "_nth", "_word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_bit")
    )
    position = F.col("_nth") * 64 + (7 - F.shiftright("_bit", 3)) * 8 + F.col("_bit") % 8
    above = (F.col("bucket") - 1) * BUCKET_IDS + position + 1
    below = F.col("bucket") * BUCKET_IDS - position
    return bits.filter(F.getbit("_word", F.col("_bit")) == 1).select(
        F.when(F.col("bucket") > 0, above).otherwise(below).cast("bigint").alias("row_id")
    )


def axis_query(obs: DataFrame, x_coo: DataFrame, last_var: int | None = None) -> DataFrame:
    """Sub-matrix of the rows in ``obs`` and variables up to ``last_var``, see ``slicing.axis_query``.

    Entries are tested where they are read; only those of chosen rows are exchanged.
    """
    entries = x_coo if last_var is None else coord_range(x_coo, last_var)
    return obs.join(keep_rows(entries, row_bitmaps(obs)), "row_id", "left")
