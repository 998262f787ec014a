"""Secret scans over an incremental ledger of blobs.

A text is a blob, addressed by its SHA-256; a row of the documents is a path to
one of its versions. The ledger lists the pairs (blob, rule version) that were scanned, with
their findings. A scan keeps of each blob one text, drops pairs that the ledger
holds, applies the rules to the others and appends them; findings are then joined
back to all paths. Scanning the same documents again reads the ledger only, and a
new rule version scans each blob anew for that rule alone.

Defined results: null and empty texts are the empty blob, without findings; copies share
one scan and each gets all findings; an empty table gives no rows; only doc_id
and text are read. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import as_texts
from rowloom.workdir import path_exists


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern``; those that ``holds`` refuses are dropped."""

    kind: str
    version: int
    pattern: str
    holds: Callable[[re.Match], bool]
    flags: int = re.ASCII
    needs: tuple[str, ...] = ()  # a match holds one of these strings, in lower case


# The order of kinds is part of the result. A run of 32 or more is found as such: runs do not nest.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m.group(2)) >= 8,
        re.ASCII | re.IGNORECASE,
        ("passw", "secret", "token", "api"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 16, re.ASCII, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", lambda m: True),
)
# Formats with a fixed prefix of their own.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True, re.ASCII, ("private key",)),
    Rule("web_token", 1, r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", lambda m: True, re.ASCII, ("eyj",)),
    Rule("forge_token", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[\w-]{20,})", lambda m: True, re.ASCII, ("gh", "glpat")),
)
RULES = BASE_RULES + MORE_RULES

_FOUND = pa.schema(
    [("blob", pa.binary()), ("kind", pa.string()), ("version", pa.int32())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)
LEDGER_SCHEMA = "blob binary, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def spans_of(text: str, rule: Rule, lowered: str | None = None) -> list[tuple[int, int]]:
    if rule.needs:
        lowered = text.lower() if lowered is None else lowered
        if not any(part in lowered for part in rule.needs):
            return []
    return [m.span() for m in re.finditer(rule.pattern, text, rule.flags) if rule.holds(m)]


def _scan(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            done = batch.column(2).to_pylist()
            for blob, text, scanned in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), done):
                lowered = text.lower()
                for rule in rules:
                    if f"{rule.kind}:{rule.version}" not in scanned:
                        spans = [{"start": a, "end": b} for a, b in spans_of(text, rule, lowered)]
                        rows.append({"blob": blob, "kind": rule.kind, "version": rule.version, "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return scan


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    if path_exists(spark, ledger):
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    return spark.createDataFrame([], LEDGER_SCHEMA)


def _paths(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")
    )


def scan_new(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blobs of ``docs`` for the rules they were not scanned for, and append to the ledger."""
    spark = docs.sparkSession
    blobs = _paths(docs).select("blob", "text").dropDuplicates(["blob"])
    if path_exists(spark, ledger):
        wanted = {f"{rule.kind}:{rule.version}" for rule in rules}
        scanned = (
            read_ledger(spark, ledger)
            .select("blob", F.concat_ws(":", "kind", F.col("version").cast("string")).alias("rule"))
            .filter(F.col("rule").isin(sorted(wanted)))
            .groupBy("blob")
            .agg(F.collect_set("rule").alias("scanned"))  # as many as there are rules
        )
        blobs = blobs.join(scanned, "blob", "left").withColumn(
            "scanned", F.coalesce("scanned", F.array().cast("array<string>"))
        )
        blobs = blobs.filter(F.size("scanned") < len(wanted))
    else:
        blobs = blobs.withColumn("scanned", F.array().cast("array<string>"))
    blobs.select("blob", "text", "scanned").mapInArrow(_scan(rules), LEDGER_SCHEMA).write.mode("append").parquet(ledger)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per path: id, blob and its findings as structs (start, rank of the kind, kind, end) in order."""
    spark = docs.sparkSession
    rank = F.create_map(*(F.lit(x) for i, rule in enumerate(rules) for x in (f"{rule.kind}:{rule.version}", i)))
    found = (
        read_ledger(spark, ledger)
        .withColumn("rank", rank[F.concat_ws(":", "kind", F.col("version").cast("string"))])
        .filter(F.col("rank").isNotNull() & (F.size("spans") > 0))
        .select("blob", "kind", "rank", F.explode(F.array_distinct("spans")).alias("span"))
        .groupBy("blob")
        # Two runs at once may both have scanned a blob: a set keeps one of equal findings.
        .agg(F.array_sort(F.collect_set(F.struct("span.start", "rank", "kind", "span.end"))).alias("found"))
    )
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return (
        _paths(docs)
        .select("doc_id", "blob")
        .join(found, "blob", "left")
        .select("doc_id", "blob", F.coalesce("found", nothing).alias("found"))
    )
