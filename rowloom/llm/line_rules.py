"""Quality rules for web text: repetition, length, and lines that many documents of a host share.

Each text gives its counts and its normalised lines (A-Z lower-cased, runs of
white space one space, runs of digits one 0) as hashes with their words. Per host
and line the distinct documents are counted; a line found in more than ``min_docs``
of them is removed, however large the host. A document left with less than
``min_left`` of its words is depleted and rejected. Counting moves one narrow row per
line of a document; the lines above the limit meet those rows again by host and line,
spread over ``SALTS`` keys as one line may stand in a third of all documents.

Defined results: a null text has no words and no lines; null hosts form a host of their own;
rows of one doc_id are one document, rows without an id one document each; repeated rows each
give a row; a very long text is one row with all its lines; a line in exactly ``min_docs``
documents stays; empty tables give no rows; only doc_id, source and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import as_texts, key_column, write_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 10
MIN_LEFT_PERCENT = 50
SALTS = 16

_SYMBOL = re.compile(r"[#*$%&|<>]")
_DIGITS = re.compile(rb"[0-9]+")
_SCHEMA = (
    "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,words:long>>"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]
)


def repeat_words(words: list) -> int:
    """Words in three-word windows that are found twice or more, the first finding included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for window in windows:
        if window in seen:
            twice.add(window)
        else:
            seen.add(window)
    covered = upto = 0
    for start, window in enumerate(windows):
        if window in twice:
            covered += start + 3 - max(start, upto)
            upto = start + 3
    return covered


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode()
    words = data.split()
    # Code points in words: bytes that do not continue a character.
    chars = len(b"".join(words).decode())
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\r\x0b\f")]
    return len(words), chars, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def normal_lines(text: str) -> dict[int, int]:
    """Hash of each different normalised line, with the words of all its repeats in the text."""
    found: dict[int, int] = {}
    for line in text.encode().lower().split(b"\n"):
        words = line.split()
        if words:
            digest = xxhash.xxh64_intdigest(_DIGITS.sub(b"0", b" ".join(words)), 0)
            digest -= (digest >> 63) << 64
            found[digest] = found.get(digest, 0) + len(words)
    return found


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        ids, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_texts(batch.column(2))
        for doc_id, source, text in zip(ids, sources, texts):
            lines = [{"line": line, "words": words} for line, words in normal_lines(text).items()]
            rows.append(dict(zip(_ARROW.names, (doc_id, source, *text_counts(text), lines))))
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``line`` of those in more than ``min_docs`` distinct documents; each null id is one of its own."""
    without_id = F.count(F.when(F.col("doc_id").isNull(), F.lit(1)))
    counted = lines.groupBy("line").agg((F.count_distinct("doc_id") + without_id).alias("n_docs"))
    return counted.filter(F.col("n_docs") > min_docs).select("line")


def removed_words(lines: DataFrame, min_docs: int) -> DataFrame:
    """``row, n_removed_words`` of the rows that have frequent lines."""
    salts = F.array(*(F.lit(k) for k in range(SALTS)))
    frequent = frequent_lines(lines, min_docs).select("line", F.explode(salts).alias("salt"))
    salted = lines.select("line", F.pmod(F.xxhash64("row"), SALTS).cast("int").alias("salt"), "row", "words")
    return salted.join(frequent, ["line", "salt"]).groupBy("row").agg(F.sum("words").alias("n_removed_words"))


def apply_rules(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_docs: int = MIN_DOCS,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """Counts of each document, words in removed lines, and whether it is kept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    measured = write_table(
        narrow.mapInArrow(_measure, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "line-rules", "zstd"
    )
    lines = measured.select("doc_id", "row", key_column(F.col("source")).alias("host"), F.explode("lines").alias("l")).select(
        "doc_id", "row", F.xxhash64("host", "l.line").alias("line"), "l.words"
    )
    judged = (
        measured.drop("lines", "source")
        .join(removed_words(lines, min_docs), "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn(
            "base_failed",
            (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        )
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_removed_words",
        "base_failed",
        (~F.col("base_failed") & (100 * left >= min_left_percent * F.col("n_words"))).alias("kept"),
    )
