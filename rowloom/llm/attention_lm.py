"""Text scores of a small causal self-attention model on subword ids, beside a word count baseline.

Text is read as its lower-cased (A-Z) words, each behind a space, in subword ids of a public
tokenizer. Model: one attention layer on embeddings of subwords, with a bias for
each distance. It predicts the class of the next subword; classes hold equal shares
of the corpus by frequency, and a subword within its class has its smoothed
share. Ids come in blocks of ``BLOCK``; a window is a block and
the one before it, so windows overlap by half and each id is scored once, with
``BLOCK`` to ``2 * BLOCK - 1`` ids before it. Masked attention runs over many windows at once.

Corpus work: ids, words of each chunk of documents and their counts are written
once. Word counts are summed over chunks and brought back to the chunk that has
the word, so the words shuffled are those of chunks and not of documents. Subword
counts are over all training documents. Weights are trained on every block of all
training documents, in groups of some ``GROUP_WINDOWS`` windows, and averaged
after each of ``ROUNDS`` rounds: more text gives more groups, not longer ones. Texts
go to groups in segments of ``SEGMENT`` blocks, so a long one is spread over many.

Defined results: null and empty texts are an end alone, which is scored; a null
id is in the fold of the text ``null``; repeated rows each count and each give a
row; an empty table gives none, and without training documents all counts are zero;
only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import as_texts, held_out, shuffles_dropped, write_table
from rowloom.llm.encoding import Encoder, encoder
from rowloom.workdir import fresh_path

FOLDS, HELD_OUT_FOLD = 7, 2
BLOCK = 16
CLASSES = 64
SLOTS = 1024
WIDTH = 16
SEGMENT = 64
GROUP_WINDOWS = 2048
MINIBATCH = 32
ROUNDS = 3
RATE = 0.01
CHUNK_CHARS = 4 << 20
_WORK_BLOCKS = 1024
_LOG10 = 1 / np.log(10)

_ENCODED = pa.schema(
    [("kind", pa.int32()), ("chunk", pa.int64()), ("place", pa.int32())]
    + [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())]
    + [("word_ids", pa.binary()), ("word_tf", pa.binary()), ("ids", pa.binary())]
    + [("word", pa.binary()), ("n_train", pa.int64())]
)
_ENCODED_SQL = (
    "kind int, chunk long, place int, doc_id long, held_out boolean, n_tokens long, "
    "word_ids binary, word_tf binary, ids binary, word binary, n_train long"
)

_SEGMENTS = pa.schema(
    [("doc_id", pa.int64()), ("number", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("ids", pa.binary())]
)


class _Chunk:
    """Documents and the words that they have, up to ``CHUNK_CHARS`` characters."""

    def __init__(self, number: int) -> None:
        self.number, self.chars = number, 0
        self._vocabulary: dict[bytes, int] = {}
        self._docs: list[tuple] = []
        self._numbers: list[np.ndarray] = []

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        words = text.encode().lower().split()
        vocabulary = self._vocabulary
        for word in set(words).difference(vocabulary):
            vocabulary[word] = len(vocabulary)
        numbers = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
        self._numbers.append(numbers)
        unique, counts = np.unique(numbers, return_counts=True)
        gaps = np.diff(unique, prepend=np.int32(0)).astype("<i4")
        self._docs.append((doc_id, held, len(words) + 1, gaps.tobytes(), counts.astype("<i4").tobytes()))
        self.chars += len(text)

    def _ids(self, subwords: Encoder) -> list[bytes]:
        """Subword ids of each document; a word of the chunk is encoded once."""
        flat, lengths = subwords.encode_words([word.decode() for word in self._vocabulary])
        starts = np.cumsum(lengths) - lengths
        found = []
        for numbers in self._numbers:
            n = lengths[numbers]
            first = np.repeat(starts[numbers] - (np.cumsum(n) - n), n)
            found.append(flat[first + np.arange(len(first))].tobytes())
        return found

    def rows(self, subwords: Encoder) -> Iterator[pa.RecordBatch]:
        def batch(n: int, **columns) -> pa.RecordBatch:
            columns |= {"chunk": np.full(n, self.number, np.int64), "place": np.arange(n, dtype=np.int32)}
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ENCODED],
                schema=_ENCODED,
            )

        names = ("doc_id", "held_out", "n_tokens", "word_ids", "word_tf")
        n = len(self._docs)
        columns = dict(zip(names, map(list, zip(*self._docs))))
        yield batch(n, kind=np.zeros(n, np.int32), ids=self._ids(subwords), **columns)
        n = len(self._vocabulary)
        used = [numbers for numbers, doc in zip(self._numbers, self._docs) if not doc[1]]
        used = np.concatenate(used) if used else np.zeros(0, np.int32)
        yield batch(
            n, kind=np.ones(n, np.int32), word=list(self._vocabulary), n_train=np.bincount(used, minlength=n)[:n]
        )


def _encode(tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = encoder(tokenizer)
        part = TaskContext.get().partitionId() << 32
        chunk = _Chunk(part)
        for batch in batches:
            held = batch.column(1).to_pylist()
            for doc_id, is_held, text in zip(batch.column(0).to_pylist(), held, as_texts(batch.column(2))):
                if chunk.chars and chunk.chars + len(text) > CHUNK_CHARS:
                    yield from chunk.rows(subwords)
                    chunk = _Chunk(chunk.number + 1)
                chunk.add(doc_id, is_held, text)
        yield from chunk.rows(subwords)

    return encode


# Word counts


def _counted_words(words: DataFrame) -> DataFrame:
    """``chunk, place, n``: training count in the whole corpus of each word of each chunk; ``first`` marks one per word."""
    # A word has one line per chunk at most: no line count of a word follows its frequency.
    same = Window.partitionBy("word")
    return words.select(
        "chunk",
        "place",
        "n_train",
        F.sum("n_train").over(same).alias("n"),
        (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"),
    )


def _baseline(n_tokens: int, n_types: int, n_end: int):
    """Base score and known tokens of the documents of a chunk, from the counts of its words."""
    floor = np.log10(n_tokens + n_types + 1) if n_tokens + n_types else 0.0
    end = np.log10(n_end + 1) - floor

    def baseline(docs: pa.Table, words: pa.Table) -> pa.Table:
        counts = np.zeros(len(words), np.int64)
        counts[words["place"].to_numpy()] = words["n"].to_numpy()
        logs = np.log10(counts + 1) - floor
        scores, known = [], []
        for gaps, tf in zip(docs["word_ids"].to_pylist(), docs["word_tf"].to_pylist()):
            at = np.cumsum(np.frombuffer(gaps, "<i4"))
            times = np.frombuffer(tf, "<i4")
            scores.append(float(logs[at] @ times) + end)
            known.append(int(times[counts[at] > 0].sum()) + (n_end > 0))
        return pa.table(
            {
                "chunk": docs["chunk"],
                "place": docs["place"],
                "doc_id": docs["doc_id"],
                "held_out": docs["held_out"],
                "n_tokens": docs["n_tokens"],
                "n_known": pa.array(known, pa.int64()),
                "base_score": pa.array(scores, pa.float64()),
            }
        )

    return baseline


# Subwords: classes, slots and the model


class Subwords(NamedTuple):
    """By id (the end of a text is the last): input slot, class, log share within the class."""

    slot: np.ndarray
    klass: np.ndarray
    log_share: np.ndarray
    prior: np.ndarray

    @property
    def start(self) -> int:
        return SLOTS + CLASSES

    @property
    def pad(self) -> int:
        return SLOTS + CLASSES + 1


def _count_ids(n_ids: int, dtype: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids + 1, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype)
            total += np.bincount(ids, minlength=n_ids + 1)
            total[n_ids] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at.astype(np.int32), "n": total[at]})

    return count


def subword_classes(counts: np.ndarray) -> Subwords:
    """Frequency classes of about equal mass; add-one shares within each."""
    order = np.argsort(-counts, kind="stable")
    smoothed = counts[order] + 1.0
    mass = (np.cumsum(smoothed) - smoothed / 2) / smoothed.sum()
    klass = np.empty(len(counts), np.int64)
    klass[order] = np.minimum((mass * CLASSES).astype(np.int64), CLASSES - 1)
    total = np.bincount(klass, counts + 1.0, CLASSES)
    slot = np.empty(len(counts), np.int64)
    slot[order] = np.where(np.arange(len(counts)) < SLOTS, np.arange(len(counts)), SLOTS + klass[order])
    log_share = np.log(counts + 1.0) - np.log(total[klass])
    return Subwords(slot.astype(np.int32), klass.astype(np.int32), log_share, total / total.sum())


def blocks_of(ids: np.ndarray, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of a text in blocks: a block of padding, then start and ids; targets are ids and end."""
    n = len(ids) + 1
    n_blocks = -(-n // BLOCK)
    inputs = np.full((n_blocks + 1) * BLOCK, subwords.pad, np.int32)
    inputs[BLOCK] = subwords.start
    inputs[BLOCK + 1 : BLOCK + n] = subwords.slot[ids]
    targets = np.full((n_blocks + 1) * BLOCK, -1, np.int32)
    targets[BLOCK : BLOCK + n - 1] = ids
    targets[BLOCK + n - 1] = len(subwords.slot) - 1
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK)


_SHAPES = {
    "e": (SLOTS + CLASSES + 2, WIDTH),
    "q": (WIDTH, WIDTH),
    "k": (WIDTH, WIDTH),
    "v": (WIDTH, WIDTH),
    "o": (WIDTH, WIDTH),
    "r": (2 * BLOCK,),
    "u": (WIDTH, CLASSES),
    "b": (CLASSES,),
}
# Distance of each key of a window from each query of its second block; later keys are masked.
_DISTANCE = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(2 * BLOCK)[None, :]
_LATER = _DISTANCE < 0
_BLOCKED = -1e4
_TOP = 60.0  # weights stay far below; exp of it still fits 32 bits
_BIAS = np.where(_LATER, 2 * BLOCK, _DISTANCE)  # place in the biases, with that of later keys behind them
_CELLS = np.arange((SLOTS + CLASSES + 2) * WIDTH).reshape(-1, WIDTH)  # places of the weights of a slot


def first_weights(subwords: Subwords) -> dict[str, np.ndarray]:
    """Small seeded weights; the output bias is the log share of each class."""
    random = np.random.default_rng(7)
    weights = {name: random.normal(0, 0.3 if name == "e" else 0.25, shape) for name, shape in _SHAPES.items()}
    weights["r"] = -0.1 * np.arange(2 * BLOCK)
    weights["u"] *= 0.2
    weights["b"] = np.log(np.maximum(subwords.prior, 1e-9))
    return weights


def pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in _SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    weights, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        weights[name] = flat[at : at + size].reshape(shape)
        at += size
    return weights


def _in_range(sums: np.ndarray) -> bool:
    """Whether sums of exponents are far from what 32 bits cannot hold."""
    return math.exp(-_TOP) < sums.min() and sums.max() < math.exp(_TOP)


class _Pass:
    """Forward and backward pass over ``n`` windows, in arrays that are kept from one minibatch to the next.

    Queries meet embeddings through one matrix (``q k'``), values leave through another (``v o``): a product less for each,
    and the gradients of the four come from those two. Attention is divided by its sum only after it has met the embeddings.
    """

    def __init__(self, n: int, kind: np.dtype) -> None:
        rows = n * BLOCK
        self.n, self._kind = n, np.dtype(kind).type
        self._x, self._dx, self._dk = (np.empty((n, 2 * BLOCK, WIDTH), kind) for _ in range(3))
        self._s, self._ds = (np.empty((n, BLOCK, 2 * BLOCK), kind) for _ in range(2))
        self._xq, self._q, self._mixed, self._h, self._dh, self._dmixed, self._dq = (np.empty((rows, WIDTH), kind) for _ in range(7))
        self._z = np.empty((rows, CLASSES), kind)
        self._cells = np.empty((n, 2 * BLOCK, WIDTH), np.int64)
        self._ones = np.ones(max(rows, CLASSES), kind)
        self._row = np.arange(rows) * CLASSES
        self._bias = np.full(2 * BLOCK + 1, _BLOCKED, kind)
        self._distances = (_BIAS.reshape(-1, 1) == np.arange(2 * BLOCK)).astype(kind)

    @np.errstate(over="ignore")
    def run(self, w: dict[str, np.ndarray], windows: np.ndarray, classes: np.ndarray, pad: int):
        """Gradient of the mean negative log class probability over targets that are not -1; sums of exponents, logits of the targets."""
        n, rows, ones = self.n, self.n * BLOCK, self._ones
        by_window = (n, BLOCK, WIDTH)
        scale = self._kind(1 / np.sqrt(WIDTH))
        qk, vo = w["q"] @ w["k"].T * scale, w["v"] @ w["o"]
        x = w["e"].take(windows, axis=0, out=self._x, mode="clip")
        x_turned = x.transpose(0, 2, 1)
        xq = self._xq
        xq.reshape(by_window)[...] = x[:, BLOCK:]
        q = np.matmul(xq, qk, out=self._q)
        self._bias[: 2 * BLOCK] = w["r"]
        bias = self._bias.take(_BIAS)
        # Rows are shifted by their maxima only where sums of exponents leave a safe range without that.
        for shifted in (False, True):
            s = np.matmul(q.reshape(by_window), x_turned, out=self._s)
            s += bias
            # Padding stands in the block before a text, or behind the end of one, where no target sees it.
            for first in np.flatnonzero(windows[:, 0] == pad):
                s[first, :, :BLOCK] = _BLOCKED
            if shifted:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            total = s.reshape(rows, -1) @ ones[: 2 * BLOCK]
            if _in_range(total):
                break
        share = 1 / total[:, None]
        mixed = self._mixed
        np.matmul(s, x, out=mixed.reshape(by_window))
        mixed *= share
        h = np.matmul(mixed, vo, out=self._h)
        h += xq
        classes = classes.reshape(-1)
        valid = classes >= 0
        weight = valid * self._kind(1 / max(1, np.count_nonzero(valid)))
        at = self._row + np.maximum(classes, 0)
        for shifted in (False, True):
            z = np.matmul(h, w["u"], out=self._z)
            z += w["b"]
            if shifted:
                z -= z.max(axis=1, keepdims=True)
            z_at = z.reshape(-1)[at]
            np.exp(z, out=z)
            total = z @ ones[:CLASSES]
            if _in_range(total):
                break
        z *= (weight / total)[:, None]
        z.reshape(-1)[at] -= weight

        g = {"u": (z.T @ h).T, "b": ones[:rows] @ z}
        dh = np.matmul(z, w["u"].T, out=self._dh)
        dvo = mixed.T @ dh
        g["v"], g["o"] = dvo @ w["o"].T, w["v"].T @ dvo
        dmixed = np.matmul(dh, vo.T, out=self._dmixed)
        dmixed *= share
        ds = np.matmul(dmixed.reshape(by_window), x_turned, out=self._ds)
        mixed *= dmixed
        ds -= (mixed @ ones[:WIDTH]).reshape(n, BLOCK, 1)
        ds *= s
        g["r"] = ones[:n] @ ds.reshape(n, -1) @ self._distances
        dq = self._dq
        np.matmul(ds, x, out=dq.reshape(by_window))
        dqk = xq.T @ dq * scale
        g["q"], g["k"] = dqk @ w["k"], dqk.T @ w["q"]
        dx = np.matmul(s.transpose(0, 2, 1), dmixed.reshape(by_window), out=self._dx)
        dx += np.matmul(ds.transpose(0, 2, 1), q.reshape(by_window), out=self._dk)
        dh += np.matmul(dq, qk.T, out=h)
        dx[:, BLOCK:] += dh.reshape(by_window)
        cells = _CELLS.take(windows, axis=0, out=self._cells, mode="clip")
        g["e"] = np.bincount(cells.reshape(-1), dx.reshape(-1), w["e"].size).reshape(w["e"].shape)
        return g, total, z_at


def loss_and_gradient(w: dict[str, np.ndarray], windows: np.ndarray, classes: np.ndarray, pad: int):
    """Mean negative log class probability over targets that are not -1, and its gradient."""
    g, total, z_at = _Pass(len(windows), w["e"].dtype).run(w, windows, classes, pad)
    valid = classes.reshape(-1) >= 0
    return float((np.log(total) - z_at)[valid].sum()) / max(1, int(valid.sum())), g


def train_group(flat: np.ndarray, windows: np.ndarray, classes: np.ndarray, pad: int) -> np.ndarray:
    """Weights after one pass over the windows in minibatches, by Adam, as exact as ``flat``."""
    flat = flat.copy()
    m, v, g, step_by = (np.zeros_like(flat) for _ in range(4))
    w, parts = unpack(flat), unpack(g)
    windows, classes = windows.astype(np.int64), classes.astype(np.int64)
    work = None
    for step, start in enumerate(range(0, len(windows), MINIBATCH), 1):
        part = slice(start, start + MINIBATCH)
        if work is None or work.n != len(windows[part]):
            work = _Pass(len(windows[part]), flat.dtype)
        for name, gradient in work.run(w, windows[part], classes[part], pad)[0].items():
            parts[name][...] = gradient
        # The means without their factors 0.1 and 0.01, which ``root`` and the rate bring in.
        m *= 0.9
        m += g
        g *= g
        v *= 0.99
        v += g
        root = math.sqrt(0.01 / (1 - 0.99**step))
        np.sqrt(v, out=step_by)
        step_by += 1e-8 / root
        np.divide(m, step_by, out=step_by)
        step_by *= RATE * 0.1 / (1 - 0.9**step) / root
        flat -= step_by
    return flat


def segments_of(ids: np.ndarray) -> Iterator[tuple[int, bool, bool, np.ndarray]]:
    """``number, first, last, ids`` of the parts of a text; later ones begin with what their first window sees before."""
    n, size = len(ids) + 1, SEGMENT * BLOCK
    for start in range(0, n, size):
        end = min(start + size, n)
        yield start // size, start == 0, end == n, ids[max(0, start - BLOCK - 1) : min(end, n - 1)]


def segment_windows(ids: np.ndarray, first: bool, last: bool, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and target classes of all windows of a segment."""
    return windows_of([ids], np.array([first]), np.array([last]), subwords)


def windows_of(segments: list[np.ndarray], first: np.ndarray, last: np.ndarray, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and target classes of all windows of many segments, one segment after another."""
    ids = np.concatenate(segments)
    n = np.fromiter(map(len, segments), np.int64, len(segments))
    # A first segment has a block of padding and the start before its ids; of a later one the first id is no target.
    before = np.where(first, BLOCK + 1, 0)
    blocks = -(-(n + before - 1 + last) // BLOCK)
    ends = np.cumsum(blocks * BLOCK)
    starts = ends - blocks * BLOCK
    x = np.full(ends[-1], subwords.pad, np.int32)
    y = np.full(ends[-1], -1, np.int32)
    x[starts[first] + BLOCK] = subwords.start
    place = np.repeat(starts + before - (np.cumsum(n) - n), n) + np.arange(len(ids))
    seen = place < np.repeat(ends, n)  # the last id of a segment that another follows is a target alone
    x[place[seen]] = subwords.slot[ids[seen]]
    wanted = place > np.repeat(starts, n)
    y[place[wanted] - 1] = subwords.klass[ids[wanted]]
    y[(starts + before - 1 + n)[last]] = subwords.klass[-1]
    x, y = x.reshape(-1, BLOCK), y.reshape(-1, BLOCK)
    own = np.ones(len(x), bool)
    own[starts // BLOCK] = False
    own = np.flatnonzero(own)
    return np.concatenate([x[own - 1], x[own]], axis=1), y[own]


def _segments(dtype: str):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, number, first, last, ids.tobytes())
                for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for number, first, last, ids in segments_of(np.frombuffer(data, dtype))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _SEGMENTS)], schema=_SEGMENTS
            )

    return segments


def _train_task(flat: np.ndarray, subwords: Subwords, dtype: str):
    def step(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "number", "ids"])
        segments = [np.frombuffer(ids, dtype) for ids in frame["ids"]]
        x, y = windows_of(segments, frame["first"].to_numpy(bool), frame["last"].to_numpy(bool), subwords)
        order = np.random.default_rng(len(x)).permutation(len(x))
        new = train_group(flat.astype(np.float32), x[order], y[order], subwords.pad).astype(np.float64)
        return pd.DataFrame({"weights": [(new * len(x)).tobytes()], "n": [len(x)]})

    return step


def _sum_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of the groups of a task, added up: one line per weight."""
    total, n = None, 0
    for batch in batches:
        for weights, windows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            weights = np.frombuffer(weights)
            total = weights if total is None else total + weights
            n += windows
    if total is not None:
        yield pa.RecordBatch.from_pydict(
            {"at": np.arange(len(total), dtype=np.int32), "total": total, "n": np.full(len(total), n, np.int64)}
        )


def train(training: DataFrame, subwords: Subwords, dtype: str) -> np.ndarray:
    """Weights from every block of all texts: rounds of groups, each averaged by windows."""
    flat = pack(first_weights(subwords))
    size = np.dtype(dtype).itemsize * BLOCK
    n = training.agg(F.sum(F.floor(F.octet_length("ids") / size) + 1)).first()[0] or 0
    n_groups = max(1, -(-n // GROUP_WINDOWS))
    segments = training.select("doc_id", "ids").mapInArrow(
        _segments(dtype), "doc_id long, number int, first boolean, last boolean, ids binary"
    )
    for round_ in range(ROUNDS if n else 0):
        # By id, place and content: copies of a text under other ids go to other groups.
        key = F.xxhash64("doc_id", "number", "ids", F.lit(round_))
        with shuffles_dropped(training.sparkSession):
            moved = (
                segments.select(key.alias("key"), "number", "first", "last", "ids")
                .groupBy(F.pmod("key", F.lit(n_groups)).alias("group"))
                .applyInPandas(_train_task(flat, subwords, dtype), "weights binary, n long")
                .mapInArrow(_sum_groups, "at int, total double, n long")
                .groupBy("at")
                .agg((F.sum("total") / F.sum("n")).alias("value"))
                .toPandas()  # one line per weight
            )
        flat = np.zeros_like(flat)
        flat[moved["at"].to_numpy()] = np.round(moved["value"].to_numpy(), 9)
    return flat


class Scorer:
    """log probability of texts, windows in batches; keys, queries and values are looked up by slot."""

    def __init__(self, flat: np.ndarray, subwords: Subwords) -> None:
        w = unpack(flat)
        self._subwords = subwords
        e = w["e"]
        self._x = e.astype(np.float32)
        self._q = (e @ w["q"] / np.sqrt(WIDTH)).astype(np.float32)
        self._k = (e @ w["k"]).astype(np.float32)
        self._v = (e @ w["v"] @ w["o"]).astype(np.float32)
        self._u, self._b = w["u"].astype(np.float32), w["b"].astype(np.float32)
        bias = np.where(_LATER, _BLOCKED, w["r"][np.maximum(_DISTANCE, 0)]).astype(np.float32)
        self._bias_before, self._bias_own = bias[:, :BLOCK], bias[:, BLOCK:]

    def _blocks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log probability sum of each block of ``x`` but the first, each with the block before it."""
        keys, values = self._k.take(x, axis=0), self._v.take(x, axis=0)
        queries = self._q.take(x[1:], axis=0)
        before = np.matmul(queries, keys[:-1].transpose(0, 2, 1))
        before += self._bias_before
        before[x[:-1, -1] == self._subwords.pad] = _BLOCKED
        own = np.matmul(queries, keys[1:].transpose(0, 2, 1))
        own += self._bias_own
        for s in (before, own):
            np.exp(np.minimum(s, _TOP, out=s), out=s)
        h = np.matmul(before, values[:-1])
        h += np.matmul(own, values[1:])
        ones = np.ones(BLOCK, np.float32)
        h /= (before @ ones + own @ ones)[:, :, None]
        h += self._x.take(x[1:], axis=0)
        z = h.reshape(-1, WIDTH) @ self._u
        z += self._b
        np.clip(z, -_TOP, _TOP, out=z)
        ids = y[1:].reshape(-1)
        valid = ids >= 0
        at = z[np.arange(len(z)), np.where(valid, self._subwords.klass[ids], 0)]
        np.exp(z, out=z)
        log_p = at - np.log(z @ np.ones(CLASSES, np.float32)) + self._subwords.log_share[ids]
        return np.where(valid, log_p, 0.0).reshape(-1, BLOCK).sum(axis=1)

    def log_probabilities(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text, given its ids, with the end."""
        if not texts:
            return np.zeros(0)
        made = [blocks_of(ids, self._subwords) for ids in texts]
        x = np.concatenate([m[0] for m in made])
        y = np.concatenate([m[1] for m in made])
        sizes = np.array([len(m[0]) for m in made])
        first = np.cumsum(sizes) - sizes  # the padding block of each text
        sums = np.zeros(len(x))  # blocks of padding have no targets, so they add nothing
        for start in range(1, len(x), _WORK_BLOCKS):
            end = min(start + _WORK_BLOCKS, len(x))
            sums[start:end] = self._blocks(x[start - 1 : end], y[start - 1 : end])
        return np.add.reduceat(sums, first)


def _score_task(flat: np.ndarray, subwords: Subwords, dtype: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(flat, subwords)
        for batch in batches:
            scores, run, size = [], [], 0
            for data in batch.column(2).to_pylist():
                run.append(np.frombuffer(data, dtype))
                size += len(run[-1])
                if size > _WORK_BLOCKS * BLOCK:
                    scores.append(scorer.log_probabilities(run))
                    run, size = [], 0
            scores.append(scorer.log_probabilities(run))
            log10 = np.concatenate(scores) * _LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log10)], ["chunk", "place", "score"])

    return score


def score_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: id, fold, tokens, known tokens, training tokens, base score and score of the model."""
    spark = docs.sparkSession
    n_ids = encoder(tokenizer).vocab_size
    dtype = encoder(tokenizer).dtype.str
    path = fresh_path(spark, "lm-corpus")
    fold = held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD)
    docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), "text").mapInArrow(
        _encode(tokenizer), _ENCODED_SQL
    ).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    corpus = spark.read.schema(_ENCODED_SQL).parquet(path)
    texts, words = corpus.filter("kind = 0"), corpus.filter("kind = 1")

    with shuffles_dropped(spark):
        counted = write_table(_counted_words(words), "lm-words")
    sums = counted.agg(
        F.sum("n_train").alias("n"), F.sum(F.when(F.col("first") & (F.col("n") > 0), 1).otherwise(0)).alias("types")
    ).first()
    n_end = texts.filter(~F.col("held_out")).count()
    n_tokens = (sums["n"] or 0) + n_end
    n_types = (sums["types"] or 0) + (n_end > 0)
    base = (
        texts.select("chunk", "place", "doc_id", "held_out", "n_tokens", "word_ids", "word_tf")
        .groupBy("chunk")
        .cogroup(counted.select("chunk", "place", "n").groupBy("chunk"))
        .applyInArrow(
            _baseline(n_tokens, n_types, n_end),
            "chunk long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double",
        )
    )

    training = texts.filter(~F.col("held_out"))
    counts = np.zeros(n_ids + 1, np.int64)
    per_id = training.select("ids").mapInArrow(_count_ids(n_ids, dtype), "id int, n long").groupBy("id").agg(F.sum("n"))
    for row in per_id.toLocalIterator():  # one line per id of the vocabulary
        counts[row[0]] = row[1]
    subwords = subword_classes(counts)
    flat = train(training, subwords, dtype)
    scores = texts.select("chunk", "place", "ids").mapInArrow(
        _score_task(flat, subwords, dtype), "chunk long, place int, score double"
    )
    return base.join(scores, ["chunk", "place"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
