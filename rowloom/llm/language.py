"""Language of web pages by Bayesian fusion of four kinds of evidence.

1. Text: a letter trigram model per language, counted over all labelled documents.
2. Declared markup: the language that the page states, weighed by how often each
   statement goes with each language.
3. Address suffix: likewise for the last label of the host name.
4. Host: the languages of the other pages of the host, smoothed towards those of
   its domain, which are smoothed towards those of all pages.

Two to four are soft counts of the text evidence over all pages, by grouped
aggregation; a page's own share is taken out of its host and its domain, so
no page votes for itself. Then log evidence is added up per language.

Defined results: a page without letters has no text evidence; null addresses and
undeclared languages are kinds of their own; without labelled documents there are no
languages and ``lang`` is null with confidence 0; repeated pages each give a row
and each count; an empty table gives none; columns other than those named are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import as_texts, key_column, write_table

BUCKET_BITS = 16
MAX_LANGUAGES = 200
SMOOTHING = 0.5
#: Trigrams overlap, so their evidence counts for less, and for no more than so many trigrams.
TEXT_WEIGHT = 0.3
MAX_TRIGRAMS = 200.0
PRIOR_PAGES = 5.0

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})"
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


class TextModel(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


def page_text(page: str) -> str:
    """Visible text of a page: no scripts, styles, comments and tags."""
    return html_lib.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page)))


_BLOCK = 1 << 20


def trigram_counts(text: str) -> np.ndarray:
    """Counts by bucket of trigrams of the lower-cased letters, other runs being one space."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for buckets in _trigrams(text):
        counts += np.bincount(buckets, minlength=1 << BUCKET_BITS)
    return counts


def _trigrams(text: str) -> Iterator[np.ndarray]:
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4")
    for start in range(0, len(codes) - 2, _BLOCK):  # blocks overlap by two letters
        c = codes[start : start + _BLOCK + 2].astype(np.uint32)
        mixed = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(5) + c[2:]
        yield (mixed * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1))):
            total = totals.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            if len(totals) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            for buckets in _trigrams(text):
                if len(buckets) > 1 << 14:
                    total += np.bincount(buckets, minlength=1 << BUCKET_BITS)
                else:
                    np.add.at(total, buckets, 1)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": total[at]}
        )


def fit_text(docs: DataFrame) -> TextModel:
    """Trigram model of each language, over all documents with a language."""
    counted = (
        docs.filter(F.col("lang").isNotNull())
        .select("lang", "text")
        .mapInArrow(_count_task, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    languages: dict[str, np.ndarray] = {}
    for row in counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).toLocalIterator():
        column = languages[row["lang"]] = np.zeros(1 << BUCKET_BITS)  # MAX_LANGUAGES arrays at most
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        column[[c["bucket"] for c in row["c"]]] = [c["n"] for c in row["c"]]
    names = sorted(languages)
    if not names:
        return TextModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32))
    counts = np.stack([languages[name] for name in names], axis=1) + SMOOTHING
    return TextModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _text_evidence(model: TextModel):
    log_p = model.log_p

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_texts(batch.column(1)):
                total, n = np.zeros(log_p.shape[1]), 0
                for buckets in _trigrams(page_text(text)):
                    total += log_p[buckets].sum(axis=0, dtype=np.float64)
                    n += len(buckets)
                scale = TEXT_WEIGHT * min(1.0, MAX_TRIGRAMS / n) if n else 0.0
                rows.append((total - total.max(initial=-np.inf if total.size else 0)) * scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]],
                ["page_id", "evidence", *batch.schema.names[2:]],
            )

    return evidence


def page_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """Per page: id, log evidence of its text per language, declared language, suffix, domain and host."""
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    host = F.when(F.length(host) > 0, host)
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "html",
        key_column(F.nullif(F.lower(F.regexp_extract("html", _DECLARED, 1)), F.lit(""))).alias("declared"),
        key_column(F.substring_index(host, ".", -1)).alias("suffix"),
        key_column(F.substring_index(host, ".", -2)).alias("domain"),
        key_column(host).alias("host"),
    )
    return named.mapInArrow(
        _text_evidence(model),
        "page_id long, evidence array<double>, declared string, suffix string, domain string, host string",
    )


def _normal(log: Column) -> Column:
    """Probabilities from log evidence."""
    top = F.array_max(log)
    raised = F.transform(log, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, key: str, n: int) -> DataFrame:
    """Per key the sum of the probabilities of each language, as an array."""
    sums = df.groupBy(key).agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)))
    return sums.select(key, F.array(*(F.col(f"s{i}") for i in range(n))).alias(f"{key}_sums"))


def _total(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)


def _without_own(sums: str) -> Column:
    return F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))


def _smoothed(counts: str, prior: str) -> Column:
    return F.zip_with(counts, prior, lambda c, q: (c + PRIOR_PAGES * q) / (_total(counts) + PRIOR_PAGES))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """Per page: id, language, its posterior, the language of the text alone, declared language, host."""
    n = len(model.languages)
    if not n:
        return pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.lit(None).cast("string").alias("lang"),
            F.lit(0.0).alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"),
        )
    seen = write_table(page_evidence(pages, model).withColumn("p", _normal(F.col("evidence"))), "page-evidence")
    overall = seen.agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n))).first()
    pages_of = np.array([x or 0.0 for x in overall]) + SMOOTHING  # per language
    everywhere = F.array(*(F.lit(float(x)) for x in pages_of / pages_of.sum()))
    languages = F.array(*(F.lit(name) for name in model.languages))

    def likelihood(key: str) -> Column:
        """log P(statement | language), up to a constant."""
        kinds = seen.select(key).distinct().count()
        weights = F.array(*(F.lit(float(x + SMOOTHING * kinds)) for x in pages_of))
        return F.zip_with(f"{key}_sums", weights, lambda s, w: F.log((s + SMOOTHING) / w))

    joined = seen
    for key in ("declared", "suffix", "domain", "host"):
        joined = joined.join(_sums(seen, key, n), key)
    joined = joined.select("*", everywhere.alias("everywhere"))
    joined = joined.withColumn("domain_others", _without_own("domain_sums"))
    joined = joined.withColumn("host_others", _without_own("host_sums"))
    joined = joined.withColumn("domain_prior", _smoothed("domain_others", "everywhere"))
    joined = joined.withColumn("host_prior", _smoothed("host_others", "domain_prior"))
    joined = joined.withColumn("declared_log", likelihood("declared")).withColumn("suffix_log", likelihood("suffix"))
    total = F.transform(
        F.arrays_zip("evidence", "host_prior", "declared_log", "suffix_log"),
        lambda z: z["evidence"] + F.log(z["host_prior"]) + z["declared_log"] + z["suffix_log"],
    )
    fused = joined.withColumn("posterior", _normal(total))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    text_best = F.array_position("evidence", F.array_max("evidence")).cast("int")
    return fused.select(
        "page_id",
        F.element_at(languages, best).alias("lang"),
        F.array_max("posterior").alias("confidence"),
        F.element_at(languages, text_best).alias("text_lang"),
    )


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
