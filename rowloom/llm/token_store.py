"""Token ids of a corpus as flat unsigned integer files with 64-bit document offsets.

One part holds a range of document ids in ascending order, as three flat
little-endian files: ``.bin`` (ids of all documents, end id after each, 16 bits
where the vocabulary fits, else 32), ``.idx`` (offsets into it, 64 bits, one more
than documents) and ``.doc`` (document ids, 64 bits). The table ``parts`` holds for each part
its documents, those with a null id (they come first), its tokens and its width;
the position of a part in the whole corpus is the prefix sum of tokens before it.

Defined results: a null or empty text has the end id alone; null ids sort first;
rows of one id are ordered by text; repeated rows are all kept; an empty table
gives a store without parts; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import as_texts, groups_of
from rowloom.llm.encoding import encoder

_PARTS = "part int, n_docs long, n_null_ids long, n_tokens long, width int"
_ENCODE_CHARS = 4 << 20
_READ_DOCS = 1 << 14


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _PartWriter:
    """The three files of a part; they get their names only when all are whole.

    A retried or doubled task writes the same bytes under names of its own, so
    whichever is renamed last leaves a good part.
    """

    def __init__(self, path: str, part: int, attempt: int) -> None:
        self._fs, root = _file_system(path)
        self._fs.create_dir(root, recursive=True)
        self._names = {kind: f"{root}/part-{part:06d}.{kind}" for kind in ("bin", "idx", "doc")}
        self._attempt = attempt
        self._out = {kind: self._fs.open_output_stream(self._temporary(kind)) for kind in self._names}
        self.n_docs = self.n_null = self.n_tokens = 0
        self._out["idx"].write(np.zeros(1, "<u8").tobytes())

    def _temporary(self, kind: str) -> str:
        return f"{self._names[kind]}.{self._attempt}.tmp"

    def add(self, doc_ids: list[int | None], codes: list[bytes], end: bytes) -> None:
        self._out["bin"].write(b"".join([code + end for code in codes]))
        sizes = np.fromiter((len(code) // len(end) + 1 for code in codes), np.int64, len(codes))
        self._out["idx"].write((self.n_tokens + np.cumsum(sizes)).astype("<u8").tobytes())
        self._out["doc"].write(np.asarray([0 if i is None else i for i in doc_ids], "<i8").tobytes())
        self.n_docs += len(codes)
        self.n_null += sum(i is None for i in doc_ids)
        self.n_tokens += int(sizes.sum())

    def close(self) -> None:
        for kind, stream in self._out.items():
            stream.close()
            if self._fs.get_file_info(self._names[kind]).type != pafs.FileType.NotFound and not isinstance(
                self._fs, pafs.LocalFileSystem
            ):
                self._fs.delete_file(self._names[kind])  # not every store renames onto a file
            self._fs.move(self._temporary(kind), self._names[kind])


def _encode_part(path: str, tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer = None
        encode_texts = encoder(tokenizer)
        end = np.asarray([end_id], encode_texts.dtype).tobytes()
        for batch in batches:
            texts = as_texts(batch.column(1))
            rows = zip(batch.column(0).to_pylist(), texts)
            for run in groups_of(rows, map(len, texts), _ENCODE_CHARS):
                writer = writer or _PartWriter(path, context.partitionId(), context.taskAttemptId())
                writer.add([i for i, _ in run], encode_texts.encode([t for _, t in run]), end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "part": context.partitionId(),
                        "n_docs": writer.n_docs,
                        "n_null_ids": writer.n_null,
                        "n_tokens": writer.n_tokens,
                        "width": encode_texts.dtype.itemsize,
                    }
                ],
                schema=pa.schema(
                    [("part", pa.int32())]
                    + [(n, pa.int64()) for n in ("n_docs", "n_null_ids", "n_tokens")]
                    + [("width", pa.int32())]
                ),
            )

    return encode


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts and write the store to ``path``, which all executors must reach."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The hash lets rows that share an id, or have none, spread over tasks.
    ordered = narrow.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions(
        "id", F.xxhash64("text"), "text"
    )
    parts = ordered.mapInArrow(_encode_part(path, tokenizer, end_id), _PARTS)
    parts.write.parquet(f"{path}/parts")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One line per part with the number of tokens in all parts before it, ``base``."""
    parts = spark.read.schema(_PARTS).parquet(f"{path}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one line per file
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _mapped(fs: pafs.FileSystem, name: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped where the file system is local, else read."""
    if fs.get_file_info(name).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype=dtype, mode="r")
    with fs.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype)


def _read_part(path: str, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:06d}"
                ids = _mapped(fs, f"{name}.bin", f"<u{row['width']}")
                offsets = _mapped(fs, f"{name}.idx", "<u8").astype(np.int64)
                doc_ids = _mapped(fs, f"{name}.doc", "<i8")
                if len(offsets) != row["n_docs"] + 1 or offsets[-1] != row["n_tokens"] or len(ids) != offsets[-1]:
                    raise ValueError(f"{name}: sizes differ from the table of parts")
                for first in range(0, row["n_docs"], _READ_DOCS):
                    last = min(first + _READ_DOCS, row["n_docs"])
                    spans = [ids[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(first, last)]
                    columns = {
                        "doc_id": pa.array(
                            doc_ids[first:last].astype(np.int64), mask=np.arange(first, last) < row["n_null_ids"]
                        ),
                        "start": pa.array(row["base"] + offsets[first:last]),
                        "n_tokens": pa.array(np.diff(offsets[first : last + 1])),
                        "ids_crc32": pa.array([zlib.crc32(span) for span in spans], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([span.astype(np.int64) for span in spans], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    return read


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: id, position of its first token in the corpus, tokens, CRC-32 of its ids, on request the ids."""
    parts = read_parts(spark, path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    spread = parts.repartition(max(1, parts.count()), "part")
    return spread.select("part", "n_docs", "n_null_ids", "n_tokens", "width", "base").mapInArrow(
        _read_part(path, with_ids), schema
    )
