"""Product codes against plain Lloyd rounds over all distances."""

import hashlib
import math

import numpy as np
import pytest

from rowloom.llm import product_codes as pc

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, rounds=pc.ROUNDS):
    """vec_id, code, error, label_error, digest of rows (vec_id, vector, label); vectors of equal length."""
    rows = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    size = max(len(r[1]) for r in rows)
    width = max(1, -(-size // 16))
    ints = [[math.floor(256 * v) for v in r[1]] + [0] * (16 * width - len(r[1])) for r in rows]
    x = np.array(ints, object).reshape(len(rows), 16, width)
    book = x[:64].transpose(1, 0, 2).copy()

    def nearest():
        gap = x[:, :, None, :] - book[None]
        d = (gap * gap).sum(3)
        return np.argmin(d, 2), np.min(d, 2)

    for _ in range(rounds):
        entry, _ = nearest()
        for p in range(16):
            for e in range(book.shape[1]):
                mine = x[entry[:, p] == e, p]
                if len(mine):
                    book[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    entry, d = nearest()
    digest = hashlib.sha256(",".join(str(v) for v in book.ravel()).encode()).hexdigest()
    error = [int(e) for e in d.sum(1)]
    labels = {}
    for row, e in zip(rows, error):
        labels[row[2]] = labels.get(row[2], 0) + e
    return sorted(
        ((r[0], "".join(f"{e:02x}" for e in es), err, labels[r[2]], digest) for r, es, err in zip(rows, entry, error)), key=repr
    )


def got(df, **options):
    return sorted(map(tuple, pc.with_errors(pc.quantise(df, **options)).collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert got(df) == by_hand(rows)
    assert got(df, near=2) == got(df, near=64) == by_hand(rows)


@pytest.mark.parametrize("kind", ["random", "ties", "huge", "few"])
def test_tables_of_many_kinds(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 20 if kind == "few" else 400
    size = 21 if kind == "few" else 32
    x = rng.normal(size=(n, size)).astype(np.float32)
    if kind == "ties":  # few values, so that many distances are equal
        x = np.round(x)
    if kind == "huge":  # squared distances beyond 53 bits
        x *= 2.0 ** rng.integers(0, 15, size=(n, 1))
    rows = [(int(i), [float(v) for v in row], int(i % 3) if i % 5 else None) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == by_hand(rows)
    assert got(df, rounds=5) == by_hand(rows, rounds=5)


def test_odd_rows(spark):
    vector = [float(i % 7) - 3 for i in range(32)]
    rows = [
        (None, vector, None),
        (1, None, 1),
        (2, [float("nan"), *vector[1:]], 1),
        (3, [*vector[1:], float("inf")], 1),
        (4, [*vector[1:], None], 1),
        (5, vector, 1),
        (5, vector, 1),
        (5, vector[::-1], None),
        (6, [0.5], 2),
        (7, [], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as error", "'x' as x", "2 as entries", "3 as b", "'y' as _label")
    assert got(df) == by_hand(rows)
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id between 1 and 4")) == []


@pytest.mark.parametrize("seed", range(20))
def test_bounds_lose_no_nearer_entry(seed):
    """Entries wander for ten rounds; kept bounds stay below the distances and the nearest entry is found."""
    rng = np.random.default_rng(seed)
    width, k, b = 4, int(rng.integers(2, 64)), int(rng.integers(1, 9))
    scale = 10 ** int(rng.integers(0, 7))
    x = rng.integers(-scale, scale + 1, (300, width))
    shape = pc.Shape(width, 1 << 27, -scale, scale)
    cast = lambda a: a.astype(shape.exact)
    book = rng.integers(-scale, scale + 1, (k, width))
    entry, _, near, bounds, outer = pc.search(cast(x), cast(book), min(b, k), shape)
    measured = 0
    for _ in range(10):
        before = book
        book = np.clip(book + rng.integers(-1 - scale // 20, 2 + scale // 20, book.shape), -scale, scale)
        gap = book - before
        moved = shape.up((gap * gap).sum(1))
        entry, best, near, bounds, outer, needed = pc.revise(cast(x), cast(book), moved, entry, near, bounds, outer, shape)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all() and (best == d.min(1)).all()
        assert (near[:, 0] == entry).all()
        distance = np.sqrt(d)
        assert (bounds * shape.unit <= np.take_along_axis(distance, near, 1) + 1e-9).all()
        left = distance.copy()
        np.put_along_axis(left, near, np.inf, 1)
        assert (outer * shape.unit <= left.min(1) + 1e-9).all()
        measured += (needed <= near.shape[1]).sum()
        shorter = pc.adapted(needed[:, None], near.shape[1])
        near, bounds, outer = (a[:, 0] for a in pc.shorten(near[:, None], bounds[:, None], outer[:, None], shorter))
    if k > 8 and b > 4:
        assert measured > 0  # lists spare full searches
