"""Product quantisation of vectors: codes, errors and codebooks, by Lloyd rounds with adaptive bounds.

A vector is cut into ``PARTS`` equal parts, each coded by the nearest of
``ENTRIES`` entries of its own codebook. The first assignment measures all
distances and keeps, for each part, its ``b`` closest entries in order with a lower bound
of each distance, and one outer bound below which no other entry lies. When the
entries have moved, a bound falls by as much as its entry moved, the outer one by
the farthest move. Only entries whose bound is not above the distance to the present
entry can be nearer, and only those are measured, in whole numbers; all
entries are, where the outer bound is not above it. ``b`` adapts: every batch keeps as
many entries as nearly all of its parts had use for.

Bounds are whole units, rounded down; moves and distances they are compared with are rounded up. So
codes do not depend on rounding, on ``b`` or on how rows are dealt out. A row
stays where it is read: each round writes its rows with their bounds, and one line
per part, entry and task for the new entries, of which there are ``64 x dimensions`` at most.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped. Shorter vectors are filled up with zeros to the longest, that to a multiple
of 16. The first codebook comes from the 64 smallest ``vec_id``, null ids last, equal ids by vector; repeated
rows count each. With fewer rows there are fewer entries. Components whose squared
distances could pass 63 bits (2 ** 27 with 64 of them) are cut there. Other columns are ignored, whatever
their names. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import key_column, write_table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Entries with a bound of their own: so many at first, never fewer than the least.
NEAR = 8
LEAST_NEAR = 2
# Share of the parts that may need a full search for want of entries in their list.
SPARE = 0.02
TOP = 65_535
STEP_ROWS = 2_048


@dataclass(frozen=True)
class Shape:
    """How the vectors of a table are cut and counted."""

    width: int  # components of a part
    limit: int  # no component is larger
    low: int
    high: int
    near: int = NEAR

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<i2" if max(-self.low, self.high) < 1 << 15 else "<i4")

    @property
    def exact(self) -> np.dtype:
        """Floats where they hold every squared distance, else 64-bit integers."""
        return np.dtype(np.float64 if self.span**2 * self.width < 1 << 51 else np.int64)

    @property
    def span(self) -> int:
        return self.high - self.low + 1

    @property
    def unit(self) -> float:
        """What bounds count in: the longest distance is below 2 ** 16 of them."""
        return self.span * math.sqrt(self.width) / TOP

    def down(self, squared: np.ndarray) -> np.ndarray:
        """Whole units below the root of a squared distance."""
        return np.minimum(np.sqrt(squared.astype(np.float64)) / self.unit * (1 - 1e-9), TOP).astype(np.int32)

    def up(self, squared: np.ndarray) -> np.ndarray:
        """Whole units above it."""
        return np.ceil(np.sqrt(squared.astype(np.float64)) / self.unit * (1 + 1e-9)).astype(np.int32)


def whole(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``x``, the vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", "label", x.alias("x")).filter(F.col("x").isNotNull() & ~bad)


def shape_of(kept: DataFrame) -> Shape | None:
    """Dimensions and extremes of the table, from one pass; None without rows."""
    seen = kept.agg(
        F.max(F.size("x")).alias("size"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")
    ).first()
    if seen.size is None:
        return None
    width = max(1, -(-seen.size // PARTS))
    limit = math.isqrt((1 << 62) // (width * PARTS)) // 2
    low, high = (math.floor(max(-limit, min(limit, SCALE * (v or 0.0)))) for v in (seen.low, seen.high))
    return Shape(width, limit, min(low, 0), max(high, 0))


def _integers(column: pa.Array, shape: Shape) -> np.ndarray:
    """``floor(256 x)`` of list values as (rows, parts, width)."""
    size = shape.width * PARTS
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ints = np.floor(np.clip(values * SCALE, -shape.limit, shape.limit)).astype(np.int64)
    if not (lengths == size).all():
        filled = np.zeros((len(lengths), size), np.int64)
        filled[np.arange(size) < lengths[:, None]] = ints
        ints = filled
    return ints.reshape(-1, PARTS, shape.width)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value a row."""
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1] if len(rows) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def _rows(column: pa.Array, dtype: np.dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, *shape)


# --- one part of a block of rows --------------------------------------------------


def search(x: np.ndarray, book: np.ndarray, b: int, shape: Shape) -> tuple[np.ndarray, ...]:
    """Nearest entry, its squared distance, the ``b`` closest entries, their bounds, the outer bound."""
    squared = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    order = np.argsort(squared, axis=1, kind="stable")[:, : b + 1]
    kept = np.take_along_axis(squared, order, 1)
    bounds = shape.down(kept)
    outer = bounds[:, b] if order.shape[1] > b else np.full(len(x), TOP, np.int32)
    return order[:, 0], kept[:, 0], order[:, :b], bounds[:, :b], outer


def revise(
    x: np.ndarray,
    book: np.ndarray,
    moved: np.ndarray,
    entry: np.ndarray,
    near: np.ndarray,
    bounds: np.ndarray,
    outer: np.ndarray,
    shape: Shape,
) -> tuple[np.ndarray, ...]:
    """The same as ``search`` after entries have moved, from what was kept; and entries needed by each row."""
    b = near.shape[1]
    bounds = np.maximum(bounds - moved[near], 0)
    outer = np.maximum(outer - moved.max(), 0)
    gap = x - book[entry]
    best = (gap * gap).sum(1)
    reach = shape.up(best)
    entry = entry.copy()
    near_enough = bounds <= reach[:, None]
    needed = near_enough.sum(1)
    unsure = outer <= reach
    needed[unsure] = b + 1
    # Entries of the list that may be nearer, measured exactly; the present one with them, for its bound.
    row, place = np.nonzero(near_enough & ~unsure[:, None])
    other = near[row, place]
    gap = x[row] - book[other]
    squared = (gap * gap).sum(1)
    bounds[row, place] = shape.down(squared)
    order = np.lexsort((other, squared, row))
    row, first = np.unique(row[order], return_index=True)
    entry[row], best[row] = other[order][first], squared[order][first]
    if unsure.any():
        entry[unsure], best[unsure], near[unsure], bounds[unsure], outer[unsure] = search(x[unsure], book, b, shape)
    # The nearest entry stays in front, the others by their bounds.
    order = np.lexsort((near, near != entry[:, None], bounds), axis=1)
    return entry, best, np.take_along_axis(near, order, 1), np.take_along_axis(bounds, order, 1), outer, needed


def shorten(near: np.ndarray, bounds: np.ndarray, outer: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Lists of ``b`` entries; the bounds of those left out go into the outer one."""
    if b < near.shape[2]:
        outer = np.minimum(outer, bounds[:, :, b])
    return near[:, :, :b], bounds[:, :, :b], outer


def adapted(needed: np.ndarray, b: int) -> int:
    """Entries to keep: enough for all but ``SPARE`` of the parts whose list was long enough."""
    counts = np.bincount(needed[needed <= b], minlength=b + 1)
    if not counts.any():
        return b
    enough = np.searchsorted(np.cumsum(counts), (1 - SPARE) * counts.sum())
    return int(min(b, max(min(LEAST_NEAR, b), enough)))


# --- passes over the table ----------------------------------------------------------

_KEPT = "ints binary, entries binary, near binary, bounds binary, outer_bound binary, b int, error long"


def _batch(batch: pa.RecordBatch, shape: Shape, ints, entries, near, bounds, outer, error) -> pa.RecordBatch:
    columns = {
        "vec_id": batch.column("vec_id"),
        "label": batch.column("label"),
        "ints": _binary(ints.astype(shape.dtype)),
        "entries": _binary(entries.astype(np.uint8)),
        "near": _binary(near.astype(np.uint8)),
        "bounds": _binary(bounds.astype("<u2")),
        "outer_bound": _binary(outer.astype("<u2")),
        "b": pa.array(np.full(len(ints), near.shape[2], np.int32)),
        "error": pa.array(error.astype(np.int64)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def assign_first(kept: DataFrame, book: np.ndarray, shape: Shape) -> DataFrame:
    """Every part to its nearest entry, by all distances, with its bounds."""
    b = min(shape.near, book.shape[1])

    def run(batches):
        for batch in _steps(batches):
            ints = _integers(batch.column("x"), shape)
            found = [search(ints[:, p].astype(shape.exact), book[p].astype(shape.exact), b, shape) for p in range(PARTS)]
            entries, squared, near, bounds, outer = (np.stack(v, 1) for v in zip(*found))
            yield _batch(batch, shape, ints, entries, near, bounds, outer, squared.sum(1))

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, {_KEPT}")


def assign_again(state: DataFrame, book: np.ndarray, before: np.ndarray, shape: Shape) -> DataFrame:
    """Every part to its nearest entry after ``before`` became ``book``, by the bounds that were kept."""
    gap = (book - before).astype(shape.exact)
    moved = shape.up((gap * gap).sum(2))

    def run(batches):
        for batch in _steps(batches):
            lengths = batch.column("b").to_numpy()
            for b in np.unique(lengths):
                some = batch.filter(pa.array(lengths == b))
                ints = _rows(some.column("ints"), shape.dtype, PARTS, shape.width)
                entries = _rows(some.column("entries"), np.uint8, PARTS).astype(np.int64)
                near = _rows(some.column("near"), np.uint8, PARTS, b).astype(np.int64)
                bounds = _rows(some.column("bounds"), np.dtype("<u2"), PARTS, b).astype(np.int32)
                outer = _rows(some.column("outer_bound"), np.dtype("<u2"), PARTS).astype(np.int32)
                found = [
                    revise(
                        ints[:, p].astype(shape.exact),
                        book[p].astype(shape.exact),
                        moved[p],
                        entries[:, p],
                        near[:, p].copy(),
                        bounds[:, p],
                        outer[:, p],
                        shape,
                    )
                    for p in range(PARTS)
                ]
                entries, squared, near, bounds, outer, needed = (np.stack(v, 1) for v in zip(*found))
                near, bounds, outer = shorten(near, bounds, outer, adapted(needed, int(b)))
                yield _batch(some, shape, ints, entries, near, bounds, outer, squared.sum(1))

    return state.mapInArrow(run, state.schema)


def new_entries(state: DataFrame, book: np.ndarray, shape: Shape) -> np.ndarray:
    """Floors of the means of the parts of each entry; an entry without parts stays."""
    n_slots = PARTS * book.shape[1]

    def run(batches):
        sums = np.zeros((n_slots, shape.width + 1), np.int64)
        for batch in _steps(batches):
            ints = _rows(batch.column("ints"), shape.dtype, PARTS, shape.width).astype(np.int64)
            slots = _rows(batch.column("entries"), np.uint8, PARTS) + np.arange(PARTS) * book.shape[1]
            np.add.at(sums[:, 0], slots.ravel(), 1)
            np.add.at(sums[:, 1:], slots.ravel(), ints.reshape(-1, shape.width))
        slot = np.nonzero(sums[:, 0])[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(slot, shape.width + 1)),
                pa.array(np.tile(np.arange(shape.width + 1), len(slot))),
                pa.array(sums[slot].ravel()),
            ],
            names=["slot", "place", "total"],
        )

    sums = state.select("ints", "entries").mapInArrow(run, "slot long, place long, total long")
    whole_sums = np.zeros((n_slots, shape.width + 1), np.int64)
    # At most entries x dimensions lines, however many rows there are.
    for slot, place, total in sums.groupBy("slot", "place").agg(F.sum("total")).collect():
        whole_sums[slot, place] = total
    count = whole_sums[:, :1]
    means = whole_sums[:, 1:] // np.maximum(count, 1)
    return np.where(count > 0, means, book.reshape(n_slots, -1)).reshape(book.shape)


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


@dataclass(frozen=True)
class Codes:
    """``rows`` (``vec_id``, ``label``, ``entries``, ``error``) and the codebooks, as (parts, entries, width)."""

    rows: DataFrame
    book: np.ndarray


def quantise(vectors: DataFrame, rounds: int = ROUNDS, near: int = NEAR) -> Codes:
    """Codes of all whole vectors of ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    kept = whole(vectors)
    shape = shape_of(kept)
    if shape is None:
        none = kept.select("vec_id", "label", F.lit(b"").alias("entries"), F.lit(0).cast("long").alias("error"))
        return Codes(none, np.zeros((PARTS, 0, 1), np.int64))
    shape = Shape(shape.width, shape.limit, shape.low, shape.high, near)
    # A fixed number of rows starts the codebooks.
    smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    start = _integers(pa.array([row.x for row in smallest], pa.list_(pa.float64())), shape)
    book = np.ascontiguousarray(start.transpose(1, 0, 2))
    state = write_table(assign_first(kept, book, shape), "codes-0")
    for n in range(rounds):
        before, book = book, new_entries(state, book, shape)
        state = write_table(assign_again(state, book, before, shape), f"codes-{n + 1}")
    return Codes(state.select("vec_id", "label", "entries", "error"), book)


def with_errors(codes: Codes) -> DataFrame:
    """Codes as text, with the error of each row, of its label and the digest of the codebooks.

    Errors are summed by label before they are moved; the join with the labels is
    Spark's choice by size, and adaptive execution splits a hot label.
    """
    rows = codes.rows.withColumn("_label", key_column(F.col("label")))
    by_label = rows.groupBy("_label").agg(F.try_sum("error").alias("label_error"))
    return rows.join(by_label, "_label").select(
        "vec_id",
        F.lower(F.hex("entries")).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(codes.book)).alias("codebooks_sha256"),
    )
