"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of the whole text are Spark expressions. Shallow trees are boosted over the statistics of
labelled rows; every path from a root to a node is a rule, a conjunction of bounds on statistics. An
L1-penalized logistic regression over the rules keeps few of them. The fitted ensemble is a list of
bounds and weights, turned into one column expression: scoring is a projection with no Python.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of their id (a
documented bound; what is fitted does not depend on how the table is partitioned).

Defined cases: a null text counts as empty and gets a score like any other; labels with null id or
null quality are ignored; several labels of one document count by majority, 1 at a tie; repeated
documents are all scored; without labelled rows, or with one class only, the score is the smoothed
share of label 1; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.columns import set_aside

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF, RATE = 40, 3, 48, 20, 0.3
# The strong penalty chooses the rules, the weak one sets the weights of those chosen.
L1, WEAK_L1, STEPS = 0.003, 0.0003, 300
THRESHOLD = 0.7


# What is counted in a text, as patterns; \S+ are words.
_COUNTED = {
    "words": r"\S+",
    "upper": "[A-Z]",
    "digits": "[0-9]",
    "symbols": r"[#$%&*|@^~=+<>{}\[\]\\/_]",
    "shouts": "[!?]",
    "stops": "[.,;:]",
    "lines": "\n",
}
NAMES = (
    "chars words word_length upper digits symbols shouts stops lines distinct distinct_root distinct_lines".split()
)


def with_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` plus a double column ``__s_<name>`` for each of ``NAMES``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counts = {f"__{k}": F.regexp_count(text, F.lit(v)) for k, v in _COUNTED.items()}
    counts["__chars"] = F.length(text)
    counts["__distinct"] = F.size(F.array_distinct(F.split(text, r"\s+")))
    counts["__distinct_lines"] = F.size(F.array_distinct(F.split(text, "\n")))
    chars, words = (F.greatest(F.col(c), F.lit(1)) for c in ("__chars", "__words"))
    stats = {
        "chars": F.col("__chars"),
        "words": F.col("__words"),
        "word_length": F.col("__chars") / words,
        "upper": F.col("__upper") / chars,
        "digits": F.col("__digits") / chars,
        "symbols": F.col("__symbols") / chars,
        "shouts": F.col("__shouts") / chars,
        "stops": F.col("__stops") / words,
        "lines": F.col("__lines") / words,
        "distinct": F.col("__distinct") / words,
        "distinct_root": F.col("__distinct") / F.sqrt(words),
        "distinct_lines": F.col("__distinct_lines") / (F.col("__lines") + 1),
    }
    return df.withColumns(counts).withColumns({f"__s_{k}": F.coalesce(stats[k].cast("double"), F.lit(0.0)) for k in NAMES}).drop(*counts)


# A rule: for each statistic that it bounds, (low, high): low < value <= high.
Rule = tuple[tuple[int, float, float], ...]


@dataclass
class Ensemble:
    """Score = logistic(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, low, high in rule:
                value = F.col(f"__s_{NAMES[name]}")
                if low > -np.inf:
                    holds = holds & (value > low)
                if high < np.inf:
                    holds = holds & (value <= high)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> list[tuple[Rule, np.ndarray, float]]:
    """A regression tree of bounded depth by second-order gain: (path, rows, leaf value) of every node
    but the root; the value is nan where the node is split."""
    out: list[tuple[Rule, np.ndarray, float]] = []

    def split(rows: np.ndarray, path: dict[int, tuple[float, float]], depth: int) -> None:
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
            g, h = grad[rows].sum(), hess[rows].sum()
            for f in range(x.shape[1]):
                n = len(edges[f]) + 1
                at = bins[rows, f]
                gl = np.cumsum(np.bincount(at, grad[rows], n))[:-1]
                hl = np.cumsum(np.bincount(at, hess[rows], n))[:-1]
                nl = np.cumsum(np.bincount(at, minlength=n))[:-1]
                if not len(gl):
                    continue
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, i)
        leaf = best[1] < 0
        if path:
            rule = tuple((f, low, high) for f, (low, high) in sorted(path.items()))
            out.append((rule, rows, -grad[rows].sum() / (hess[rows].sum() + 1) if leaf else np.nan))
        if not leaf:
            _, f, i = best
            low, high = path.get(f, (-np.inf, np.inf))
            cut = float(edges[f][i])
            left = bins[rows, f] <= i
            split(rows[left], {**path, f: (low, cut)}, depth + 1)
            split(rows[~left], {**path, f: (cut, high)}, depth + 1)

    split(np.arange(len(x)), {}, 0)
    return out


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees."""
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        edges.append(np.unique(np.quantile(middle, np.linspace(0, 1, BINS), method="nearest")) if len(middle) else middle)
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    raw = np.full(len(y), base)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        nodes = _grow(x, bins, edges, p - y, np.maximum(p * (1 - p), 1e-6))
        if not nodes:
            break
        for rule, rows, value in nodes:
            rules.setdefault(rule)
            if not np.isnan(value):
                raw[rows] += RATE * value
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, low, high in rule:
        out &= (x[:, f] > low) & (x[:, f] <= high)
    return out


def lasso(z: np.ndarray, y: np.ndarray, l1: float, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalized logistic regression, by accelerated proximal steps."""
    n, m = z.shape
    full = np.concatenate([np.ones((n, 1), dtype=z.dtype), z], axis=1)
    step = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w, v, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = v[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(full @ v)))
        new = v - step * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Fit to statistics (columns in the order of ``NAMES``) and labels 0 and 1."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules, columns, seen = [], [], set()
    for rule in extract_rules(x, y):
        column = holds(rule, x)
        key = column.tobytes()
        if 0 < column.sum() < len(y) and key not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(column)
    if not rules:
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    z = np.stack(columns, axis=1).astype(np.float32)
    chosen = np.flatnonzero(np.abs(lasso(z, y, L1)[1]) > 1e-3)
    intercept, weights = lasso(z[:, chosen], y, WEAK_L1)
    return Ensemble(intercept, [(rules[i], float(w)) for i, w in zip(chosen, weights) if abs(w) > 1e-3])


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS
) -> Ensemble:
    """Fit on the documents named in ``labels`` (at most ``rows`` of them)."""
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("double").alias("__y")).where(
        "__id IS NOT NULL AND __y IS NOT NULL"
    )
    known = known.groupBy("__id").agg((F.avg("__y") >= 0.5).cast("int").alias("__y"))
    known = known.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(rows)
    # At most ``rows`` small rows, so the broadcast is bounded.
    some = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__t")).join(F.broadcast(known), "__id")
    # A document id that repeats gives one row, so that rows stay bounded.
    one = with_statistics(some, "__t").groupBy("__id", "__y").agg(*(F.max(f"__s_{n}").alias(n) for n in NAMES))
    table = one.toPandas().sort_values("__id", kind="stable")
    return fit_rules(table[NAMES].to_numpy(float), table["__y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``."""
    base = docs.drop("score", "predicted")
    scored = with_statistics(base, text_col).withColumn("score", model.column())
    scored = scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return scored.select(*(F.col(f"`{c}`") for c in base.columns), "score", "predicted")


def keep_good(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their own columns."""
    # The row number keeps the filter above the score; pushed down, it would count each statistic anew
    # for every rule.
    given, own = set_aside(docs, text_col)
    scored = score_quality(given, model, text_col).withColumn("__row", F.monotonically_increasing_id())
    return scored.where((F.col("predicted") == 1) & (F.col("__row") >= 0)).select(own)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may be used for measuring only: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
