"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less meet half way: one takes up to two flips,
the other up to one. Every fingerprint shuffles on its variants. All that reach
a variant with at most one flip are within two of each other and within three of
those that reach it with two, so one star per variant holds all its links and no
pairs are listed. Two things keep the balls small. Of two fingerprints at
distance 3 exactly one has an even number of ones, and it takes the two flips;
two of the three bits lie in one half of the fingerprint, so it flips two bits of
one half only (65 + 992 variants, 65 for the odd ones). And only fingerprints
with a neighbour candidate take part: within distance 3 one of the two 32-bit
halves differs in one bit at most, so all halves and their one-bit variants are
shuffled first. A variant is reached by 2,081 different fingerprints at most.

Defined results: texts without words (null and empty ones too) have fingerprint
zero and are linked like others; a component with null ids only has id null, else
null ids do not count; repeated rows each give a row; an empty table gives none;
only the columns doc_id and text are read, and ``keep_one`` passes the others on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import as_bytes, key_column, write_table
from rowloom.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) word shingles of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    left = n
    while left:  # blocks bound the memory of a very long text
        size = min(left, _BLOCK)
        hashes = np.fromiter((digest(gram, seed) for gram, _ in zip(grams, range(size))), np.uint64, size)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(size, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
        left -= size
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.asarray([fingerprint(text) for text in as_bytes(batch.column(1))], np.uint64)
        columns = [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, fp`` (64 bits, signed) of every row, with columns of ``extra`` (strings) beside them."""
    extra = extra or {}
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *(c.alias(n) for n, c in extra.items())
    )
    schema = "doc_id long, fp long" + "".join(f", {name} string" for name in extra)
    return narrow.mapInArrow(_signed, schema)


def _long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masks(values: list[int]) -> Column:
    return F.explode(F.array(*(F.lit(_long(value)).cast("long") for value in values)))


_FLIPS_1 = [1 << i for i in range(64)]
_FLIPS_2 = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]


def _with_candidates(prints: DataFrame) -> DataFrame:
    """Those of the distinct ``fp`` that share a half, up to one bit, with another."""
    halves = prints.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")),
                F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")),
            )
        ).alias("h"),
    ).select("fp", "h.side", "h.half")
    masks = [0, *(1 << i for i in range(32))]
    reached = halves.select("side", "half", "fp", _masks(masks).alias("mask")).select(
        "side", F.col("half").bitwiseXOR(F.col("mask")).alias("half"), "fp"
    )
    shared = (
        reached.groupBy("side", "half")
        .agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
        .filter("low != high")
        .select("side", "half")
    )
    return halves.join(shared, ["side", "half"], "left_semi").select("fp").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Edges ``a, b`` between distinct ``fp`` at distance 3 or less that connect all such pairs."""
    candidates = write_table(_with_candidates(prints), "simhash-candidates")
    near = candidates.select("fp", _masks([0, *_FLIPS_1]).alias("mask"))
    far = candidates.filter(F.bit_count("fp") % 2 == 0).select("fp", _masks(_FLIPS_2).alias("mask"))
    balls = near.select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", F.lit(True).alias("close")
    ).union(far.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", F.lit(False).alias("close")))
    met = balls.groupBy("variant").agg(
        F.min(F.when(F.col("close"), F.col("fp"))).alias("a"),
        F.collect_list("fp").alias("others"),  # 2,081 at most: all lie within two bits of the variant
    )
    pairs = met.filter(F.col("a").isNotNull() & (F.size("others") > 1)).select("a", F.explode("others").alias("b"))
    found = pairs.filter("a != b").distinct()
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: id, fingerprint as 16 hex digits, smallest id of its component."""
    signed = write_table(fingerprints(docs), "simhash")
    return _classes(signed).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _classes(signed: DataFrame) -> DataFrame:
    """``signed`` with ``component_id``."""
    by_print = write_table(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    roots = components(links(by_print.select("fp")), "a", "b")
    rooted = by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id")
    return signed.join(members, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: the first by id, nulls last, then by text.

    The rows that stay are found on ids and digests; their texts move once.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    row_key = F.concat(key_column(F.col("doc_id")), F.lit("|"), digest)
    signed = write_table(fingerprints(docs, {"row_key": row_key}), "simhash")
    by_print = write_table(
        signed.groupBy("fp").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")
        ),
        "simhash-prints",
    )
    roots = components(links(by_print.select("fp")), "a", "b")
    kept = (
        by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row_key").alias("_row_key"))
    )
    rows = docs.select(F.struct("*").alias("_row"), row_key.alias("_row_key"))
    return rows.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select("_row.*")
