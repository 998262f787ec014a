"""Mix sources to target weights by systematic sampling; DataFrame functions only.

Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share all
words of the corpus; a target stops at ``max_copies`` times its source's words
and the excess goes to the others by weight. Each document of a source expects
target / source words copies. Expected copies are summed along the documents of
the source, one offset is added, and a document is taken once for each integer
boundary that its share crosses. Documents stand in order of size classes, so
that the words taken come near the target, and by hash within one.

The running sum needs no long window: documents fall into buckets (source, size
class, two hash steps of 256), bucket totals are summed step by step over at
most 256 lines (size classes: some 320), and only the documents of a bucket meet in a window.
Copies are counted in units of 2**-24 in whole numbers: reruns agree.

Defined results: a null text has no words; documents without words and sources
without words are never taken; rows that agree in id, size and text
are interchangeable; an empty table gives no rows; extra columns pass through
``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import WORD_PATTERN, key_column, write_table

UNIT_BITS = 24
MAX_SOURCES = 100_000
_BUCKET = ["_source", "_class", "_step1", "_step2"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _size_class(size: str) -> Column:
    """Eight classes for each doubling: the length in bits and the three bits after the first."""
    return F.expr(
        f"length(bin({size})) * 8 + cast(shiftright({size}, greatest(length(bin({size})) - 4, 0)) & 7 as int)"
    )


def _offset(source_key: Column, seed: str) -> Column:
    """One offset per source in [0, 1), in units."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), source_key).cast("binary")), 1, UNIT_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_copies: int = 3) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one line per source; more than MAX_SOURCES raise.

    In order of cap / weight, a source is capped when the level of those left, words
    not yet given per weight, is above its cap; those capped are a prefix.
    """
    if sizes.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_copies).withColumn(
        "rank", F.row_number().over(by_name)
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    open_ = ranked.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), none)).alias("open_words"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none)).alias("open_weight"),
    )
    exact = "decimal(20,0)", "decimal(10,0)"
    capped = F.col("open_words").cast(exact[0]) * F.col("weight").cast(exact[1]) > F.col("cap").cast(
        exact[0]
    ) * F.col("open_weight").cast(exact[1])
    flagged = open_.withColumn("capped", capped)
    left = flagged.select(
        "*",
        (F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)).alias("rest"),
        F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(whole).alias("rest_weight"),
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("rest").cast("double") / F.col("rest_weight").cast("double")
    )
    return left.select("source", "source_size", target.alias("target"))


def _with_keys(docs: DataFrame, payload: list[Column]) -> DataFrame:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    keyed = docs.select(
        *payload,
        F.col("doc_id").alias("_doc_id"),
        F.col("source").alias("_name"),
        key_column(F.col("source")).alias("_source"),
        word_count(F.col("text")).alias("_size"),
        digest.alias("_digest"),
        F.xxhash64("text").alias("_tie"),
    )
    return keyed.select(
        "*",
        _size_class("_size").alias("_class"),
        F.substring("_digest", 1, 2).alias("_step1"),
        F.substring("_digest", 3, 2).alias("_step2"),
    )


def _bases(buckets: DataFrame) -> DataFrame:
    """Documents of the source before each bucket, by running sums over short lists."""
    known = buckets.select(*_BUCKET, "_n", F.lit(0).cast("long").alias("_base"))
    for depth in range(len(_BUCKET) - 1, 0, -1):
        outer, inner = _BUCKET[:depth], _BUCKET[depth]
        level = buckets.groupBy(*outer, inner).agg(F.sum("_n").alias("_level_n"))
        before = Window.partitionBy(*outer).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
        starts = level.select(
            *outer, inner, F.coalesce(F.sum("_level_n").over(before), F.lit(0).cast("long")).alias("_start")
        )
        known = known.join(starts, [*outer, inner]).select(
            *_BUCKET, "_n", (F.col("_base") + F.col("_start")).alias("_base")
        )
    return known.drop("_n")


def _sampled(docs: DataFrame, payload: list[Column], seed: str, max_copies: int) -> DataFrame:
    """``payload`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``."""
    counted = _with_keys(docs, []).groupBy("_name", *_BUCKET).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")
    )
    buckets = write_table(counted, "mix-buckets")
    sizes = buckets.groupBy(F.col("_name").alias("source")).agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, max_copies).select(
        key_column(F.col("source")).alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    step = F.least(F.floor(rate * float(1 << UNIT_BITS)), F.lit(max_copies << UNIT_BITS).cast("long"))
    begun = write_table(
        _bases(buckets).join(F.broadcast(targets), "_source").select(  # MAX_SOURCES lines at most
            *_BUCKET,
            "_source_size",
            "_target",
            step.alias("_step"),
            (F.col("_base") * step + _offset(F.col("_source"), seed)).alias("_from"),
        ),
        "mix-bases",
    )
    order = Window.partitionBy(*_BUCKET).orderBy("_digest", "_doc_id", "_size", "_tie")
    placed = _with_keys(docs, payload).withColumn("_place", F.row_number().over(order))
    joined = placed.join(begun, _BUCKET)
    upto = F.col("_from") + F.col("_place") * F.col("_step")
    crossed = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("_step"), UNIT_BITS)
    copies = F.when(F.col("_size") > 0, crossed).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("_copies", copies)


def mix_plan(docs: DataFrame, seed: str = "mix", max_copies: int = 3) -> DataFrame:
    """Per document: id, words, words and target of its source, copies and words that the mix takes."""
    plan = _sampled(docs.select("doc_id", "source", "text"), [], seed, max_copies)
    return plan.select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


def mix(docs: DataFrame, seed: str = "mix", max_copies: int = 3) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with its own columns."""
    taken = _sampled(docs, [F.struct("*").alias("_row")], seed, max_copies).filter(F.col("_copies") > 0)
    return taken.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))), "_row").select("_row.*")
