"""Quality classifier: a sparse ensemble of rules, fitted on labels and run as Spark columns.

Statistics of a text are column expressions. Boosted shallow trees on the
statistics of a bounded, labelled sample give paths; each path is a rule, a
conjunction of thresholds. Logistic regression with an L1 penalty keeps few
rules and weighs them. The rules are compiled to one column expression, so
scoring needs no Python and no shuffle.

``SAMPLE_ROWS`` bounds the labelled rows (by md5 of the id, then by id); statistics and scores cover all
documents. Labels that are null count as absent; several labels of one id are
averaged. Without labels of both classes the score is the share of label 1, one half without any.

Defined results: null and empty texts are scored like others (all statistics
zero); repeated rows each give a row; an empty table gives none; ``keep_good``
passes all columns through whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import held_out

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT_FOLD = 3, 1
N_TREES, DEPTH, BINS, SHRINKAGE = 40, 3, 24, 0.2
MIN_LEAF = 8
PENALTY, STEPS = 2e-4, 400

# Frequent function words of the languages in use (fixed values).
_FUNCTION_WORDS = "the|and|of|to|in|is|that|for|it|was|on|are|as|with|at|de|la|le|les|et|des|en|un|du|que|el|los|del|der|die|das|und|ein|zu|den|nicht|mit"


class Rule(NamedTuple):
    """Weight of the conjunction of ``(statistic, above, threshold)``."""

    weight: float
    terms: tuple[tuple[int, bool, float], ...]


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name, all doubles and never null."""
    t = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    chars = F.length(t).cast("double")
    words = count(r"\S+")
    lines = count(r"[^\n]+")
    some = F.greatest(words, F.lit(1.0))
    different = F.size(F.array_distinct(F.split(F.lower(t), r"\s+"))).cast("double")
    return {
        "log_words": F.log1p(words),
        "word_length": (chars - words + 1) / some,
        "different_words": different / some,
        "repeats": count(r"(?<!\S)(\S+)(?= \1(?!\S))") / some,
        "capitals": count(r"\p{Lu}") / some,
        "capital_words": count(r"(?<!\S)\p{Lu}{2,}") / some,
        "digits": count(r"[0-9]") / some,
        "marks": count(r"[!?]") / some,
        "stops": count(r"[.,;:]") / some,
        "symbols": count(r"[#*$%&|<>{}=~^\\]") / some,
        "bars": count(r"(?<!\S)\|(?!\S)") / some,
        "function_words": count(rf"(?i)(?<!\S)(?:{_FUNCTION_WORDS})(?!\S)") / some,
        "words_a_line": words / F.greatest(lines, F.lit(1.0)),
    }


def _thresholds(values: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 2)[1:-1]))


def _best_split(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int, int] | None:
    """Statistic and bin of the split that gains most, by second-order sums over bins."""
    best = None
    total_g, total_h = gradient.sum(), hessian.sum()
    for k in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[:, k], gradient, BINS + 1))[:-1]
        h = np.cumsum(np.bincount(bins[:, k], hessian, BINS + 1))[:-1]
        n = np.cumsum(np.bincount(bins[:, k], minlength=BINS + 1))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        gain[(n < MIN_LEAF) | (len(bins) - n < MIN_LEAF)] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
            best = (float(gain[at]), k, at)
    return best


def _grow(bins, gradient, hessian, rows, path, depth, paths, step):
    """Depth-first tree: notes the path of each node and adds leaf steps."""
    if path:
        paths.append(path)
    split = _best_split(bins[rows], gradient[rows], hessian[rows]) if depth and len(rows) >= 2 * MIN_LEAF else None
    if split is None:
        step[rows] = -gradient[rows].sum() / (hessian[rows].sum() + 1)
        return
    _, k, at = split
    above = bins[rows, k] > at
    for side in (False, True):
        _grow(bins, gradient, hessian, rows[above == side], (*path, (k, side, at)), depth - 1, paths, step)


def _tree_paths(bins: np.ndarray, label: np.ndarray) -> list[tuple]:
    """Paths of boosted trees, each on the logistic gradient left by those before."""
    paths: list[tuple] = []
    share = label.mean()
    score = np.full(len(label), np.log(share / (1 - share)))
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(label))
        _grow(bins, p - label, p * (1 - p), np.arange(len(label)), (), DEPTH, paths, step)
        score += SHRINKAGE * step
    return list(dict.fromkeys(tuple(sorted(path)) for path in paths))


def _lasso(x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal steps; the intercept is free."""
    n = len(label)
    mean = x.mean(axis=0, dtype=np.float64)
    share = label.mean()

    # Products with the centred matrix, which is never built; ``x`` holds zeros and ones in 32 bits.
    def times(weights: np.ndarray) -> np.ndarray:
        return (x @ weights.astype(np.float32)).astype(np.float64) - mean @ weights

    def turned(rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float32) @ x).astype(np.float64) - mean * rows.sum()

    # Lipschitz bound of the gradient, by power iteration.
    v = np.ones(x.shape[1], np.float64) / np.sqrt(max(1, x.shape[1]))
    norm = 1.0
    for _ in range(20):
        v = turned(times(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate = 1 / (0.25 * (norm / n + 1))
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(times(w_ahead) + b_ahead)))
        error = (p - label) / n
        raw = w_ahead - rate * turned(error)
        w_new = np.sign(raw) * np.maximum(np.abs(raw) - rate * PENALTY, 0)
        b_new = b_ahead - rate * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_ahead, b_ahead = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b - float(mean @ w), w


def fit_rules(x: np.ndarray, label: np.ndarray) -> Model:
    """Rules for ``label`` (0 or 1) from statistics ``x``, one row per text."""
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or len(label) < 4 * MIN_LEAF:
        share = (share * len(label) + 0.5) / (len(label) + 1)
        return Model(float(np.log(share / (1 - share))), ())
    cuts = [_thresholds(x[:, k]) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cut, x[:, k], side="left") for k, cut in enumerate(cuts)], axis=1)
    paths = [p for p in _tree_paths(bins, label) if all(at < len(cuts[k]) for k, _, at in p)]
    met = np.zeros((len(label), len(paths)), np.float32)
    for column, path in enumerate(paths):
        met[:, column] = np.all([(bins[:, k] > at) == above for k, above, at in path], axis=0)
    intercept, weights = _lasso(met, label)
    rules = tuple(
        Rule(float(w), tuple((k, above, float(cuts[k][at])) for k, above, at in path))
        for path, w in zip(paths, weights)
        if abs(w) > 1e-6
    )
    return Model(intercept, rules)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """The same score in numpy, to check the compiled one."""
    z = np.full(len(x), model.intercept)
    for rule in model.rules:
        z += rule.weight * np.all([(x[:, k] > cut) == above for k, above, cut in rule.terms], axis=0)
    return 1 / (1 + np.exp(-z))


def compiled(model: Model, names: list[str]) -> Column:
    """The score in [0, 1] over columns that hold the statistics."""
    total = F.lit(model.intercept)
    for rule in model.rules:
        met = F.lit(True)
        for k, above, cut in rule.terms:
            column = F.col(names[k])
            met = met & ((column > F.lit(cut)) if above else (column <= F.lit(cut)))
        total = total + F.when(met, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label of at most ``rows`` labelled documents outside the held-out fold."""
    usable = labels.filter(
        F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD)
    )
    chosen = (
        usable.groupBy("doc_id")
        .agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
        .limit(rows)
    )
    matched = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` lines at most
    stats = F.struct("_label", *(c.alias(n) for n, c in statistics(F.col("text")).items()))
    # One row per id, the least where an id repeats: never more than ``rows``.
    return matched.groupBy("doc_id").agg(F.min(stats).alias("s")).select("s.*")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    sample = training_sample(docs, labels, target).toPandas()
    sample = sample.sort_values(list(sample.columns))  # the same model however rows arrive
    return fit_rules(sample.drop(columns="_label").to_numpy(np.float64), sample["_label"].to_numpy(np.float64))


def _scored(docs: DataFrame, model: Model, payload: list[Column]) -> DataFrame:
    stats = statistics(F.col("text"))
    named = {f"_stat_{name}": column for name, column in stats.items()}
    return docs.select(*payload, *(c.alias(n) for n, c in named.items())).withColumn(
        "_score", compiled(model, list(named))
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: id, fold, score and class."""
    scored = _scored(docs, model, [F.col("doc_id")])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT_FOLD).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns."""
    scored = _scored(docs, model, [F.struct("*").alias("_row")])
    # A filter is not pushed below a column that is no function of its row: pushed, it would hold each
    # statistic once for every term of every rule, too large to compile.
    placed = scored.withColumn("_place", F.monotonically_increasing_id())
    return placed.filter((F.col("_score") >= threshold) & (F.col("_place") >= 0)).select("_row.*")
