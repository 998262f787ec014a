"""A seeded permutation of 0..n-1 as a formula: the place of a row, and the row of a place.

A number is a pair of remainders ``x = left * b + right``; rounds add a keyed mix of one half to the
other, which can be undone. The pairs are up to ``sqrt(n)`` more than the rows: a
result that is no row goes through the rounds again until it is one. How often that can be
is worked out from those few pairs, so the columns below are exact.

Nothing is counted, sorted or exchanged. A run is taken up at batch k by asking for the rows
of the places from there on.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 2_147_483_647
ROUNDS = 8


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


@dataclass(frozen=True)
class KeyedOrder:
    """The permutation of ``n`` rows that belongs to a seed; each epoch has its own."""

    n: int
    seed: int | str = 42
    epochs: int | None = None

    @property
    def a(self) -> int:
        root = math.isqrt(max(self.n, 1))
        return root if root * root == max(self.n, 1) else root + 1

    @property
    def b(self) -> int:
        return -(-max(self.n, 1) // self.a)

    def _seeds(self) -> list[str]:
        return [str(self.seed)] if self.epochs is None else [f"{self.seed}:{epoch}" for epoch in range(self.epochs)]

    def keys(self, seed: str) -> list[tuple[int, int, int]]:
        return [tuple(_number(f"{seed}:{i}:{name}") for name in "abc") for i in range(ROUNDS)]

    # --- numbers -------------------------------------------------------------

    def _once(self, x: np.ndarray, seed: str, back: bool = False) -> np.ndarray:
        left, right = x // self.b, x % self.b
        rounds = list(enumerate(self.keys(seed)))
        for i, (mul, add, more) in reversed(rounds) if back else rounds:
            mixed = ((right if i % 2 == 0 else left) * mul + add) % PRIME
            mixed = (mixed * mixed + more) % PRIME
            if back:
                mixed = -mixed
            if i % 2 == 0:
                left = (left + mixed) % self.a
            else:
                right = (right + mixed) % self.b
        return left * self.b + right

    @cached_property
    def walks(self) -> int:
        """How often the rounds are applied at most until a row is met; the same in both directions."""
        most = 1
        outside = np.arange(self.n, self.a * self.b, dtype=np.int64)
        for seed in self._seeds():
            # Only pairs that follow a row are ever met.
            met = outside[self._once(outside, seed, back=True) < self.n]
            again = 1
            while len(met):
                again += 1
                met = self._once(met, seed)
                met = met[met >= self.n]
            most = max(most, again)
        return most

    # --- columns -------------------------------------------------------------

    def _constant(self, round_: int, which: int) -> Column:
        values = [F.lit(self.keys(seed)[round_][which]).cast("bigint") for seed in self._seeds()]
        return values[0] if self.epochs is None else F.get(F.array(*values), F.col("epoch"))

    def _mapped(self, rows: DataFrame, source: str, name: str, back: bool) -> DataFrame:
        names = rows.columns
        a, b, prime = (F.lit(v).cast("bigint") for v in (self.a, self.b, PRIME))
        rows = rows.withColumn("_x", F.col(source).cast("bigint"))
        for walk in range(self.walks):
            halves = {"_l": F.call_function("div", F.col("_x"), b), "_r": F.col("_x") % b}
            rows = rows.withColumns(halves)
            order = range(ROUNDS)
            for i in reversed(order) if back else order:
                from_, to, size = ("_r", "_l", a) if i % 2 == 0 else ("_l", "_r", b)
                rows = rows.withColumn("_m", (F.col(from_) * self._constant(i, 0) + self._constant(i, 1)) % prime)
                mixed = (F.col("_m") * F.col("_m") + self._constant(i, 2)) % prime
                rows = rows.withColumn(to, F.pmod(F.col(to) - mixed if back else F.col(to) + mixed, size))
            found = F.col("_l") * b + F.col("_r")
            if walk:
                found = F.when(F.col("_x") < self.n, F.col("_x")).otherwise(found)
            rows = rows.withColumn("_x", found)
        # Filters on the result stop at the one-element array; pushed further they would copy every round.
        return rows.select(*names, F.explode(F.array("_x")).alias(name))

    def places(self, rows: DataFrame, key: str = "row_id", name: str = "ord") -> DataFrame:
        """Add the place of each row; ``key`` is 0..n-1, and ``epoch`` is there if there are epochs."""
        return self._mapped(rows, key, name, back=False)

    def rows_at(self, places: DataFrame, key: str = "ord", name: str = "row_id") -> DataFrame:
        """Add the row of each place."""
        return self._mapped(places, key, name, back=True)


def _cut(plan: DataFrame, batch_size: int) -> DataFrame:
    size = F.lit(batch_size).cast("bigint")
    return plan.withColumns({"batch_id": F.call_function("div", F.col("ord"), size), "pos": F.col("ord") % size}).drop("ord")


def keyed_permutation(
    rows: DataFrame, batch_size: int, n_rows: int, *, seed: int | str = 42, epochs: int | None = None, drop_last: bool = True
) -> DataFrame:
    """Rows 0..n-1 in batches of a seeded permutation, without an exchange; each row stays where it is read."""
    if epochs is not None:
        rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = KeyedOrder(n_rows, seed, epochs).places(rows)
    if drop_last:
        placed = placed.filter(F.col("ord") < n_rows // batch_size * batch_size)
    return _cut(placed, batch_size)


def keyed_batches(
    spark: SparkSession,
    n_rows: int,
    batch_size: int,
    *,
    first_batch: int = 0,
    n_batches: int | None = None,
    seed: int | str = 42,
    drop_last: bool = True,
) -> DataFrame:
    """``row_id``, ``batch_id`` and ``pos`` of some batches of the same permutation; other rows are not looked at."""
    start = first_batch * batch_size
    end = n_rows // batch_size * batch_size if drop_last else n_rows
    if n_batches is not None:
        end = min(end, start + n_batches * batch_size)
    places = spark.range(min(start, end), end).withColumnRenamed("id", "ord")
    return _cut(KeyedOrder(n_rows, seed).rows_at(places), batch_size)
