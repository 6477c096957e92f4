"""Isolation forest (Liu, Ting, Zhou 2008) fitted and applied as Spark jobs."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetsight.operators.scaling import CONTAMINATION, contamination_offset
from fleetsight.plans.kept import settled
from fleetsight.plans.quantiles import BUFFER_ROWS

TREES = 100
SAMPLE = 256
SEED = 42

_NODES = "tree INT, node INT, feature INT, cut DOUBLE, left INT, right INT, depth DOUBLE"
_HASH_RANGE = 1 << 40
_EULER = 0.5772156649015329


def constant_array(values: Sequence | np.ndarray, of: str = "double") -> Column:
    """A long array as one constant: the text is parsed when the plan is optimized, not per row."""
    return F.from_json(F.lit(json.dumps(np.asarray(values).tolist())), f"array<{of}>")


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n items."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def sample_per_tree(
    df: DataFrame,
    feats: Sequence[str],
    id_cols: Sequence[str],
    n_rows: int,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """At most ``sample`` rows per tree, chosen by hashes of the row identity.

    A pure function of row content: a re-run task draws the same rows. Each tree takes a row with
    the same chance, about twice what it needs; the exact cut is a per-tree rank, limited map side
    first. One hash first tells whether any tree may take the row at all, so a large table costs one
    hash per row; only rows that pass are asked tree by tree. Trees can share rows at every size.
    """
    ident = [F.col(c) for c in id_cols]
    # wide enough that falling short of ``sample`` is next to impossible
    share = min(1.0, (2.0 * sample + 64.0) / max(n_rows, 1))
    some = min(1.0, share * trees)

    def chance(*salt: Column) -> Column:
        return F.pmod(F.xxhash64(*ident, *salt), F.lit(_HASH_RANGE)) / F.lit(float(_HASH_RANGE))

    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: chance(t, F.lit(seed)) < share / some,
    )
    feats_v = F.array(*[F.col(f).cast("double") for f in feats]).alias("x")
    drawn = (
        df.where(chance(F.lit(seed + 1)) < some)
        .select(*id_cols, feats_v, F.explode(chosen).alias("tree"))
        .select("tree", F.xxhash64(*ident, F.col("tree"), F.lit(seed + 2)).alias("_h"), "x")
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "x"))
    return drawn.withColumn("rn", rank).where(F.col("rn") <= sample).drop("_h")


def _grow(pdf: pd.DataFrame, seed: int, sample: int) -> pd.DataFrame:
    """One isolation tree from at most ``sample`` rows, as a node table."""
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf.sort_values("rn")["x"].to_numpy()).astype(float)
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(sample, 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "l" else 5] = me
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(wide) == 0:
            nodes.append([tree, me, -1, 0.0, me, me, depth + average_path(len(rows))])
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(lo[f], hi[f]))
        goes_left = part[:, f] < cut
        if goes_left.all() or not goes_left.any():  # the cut fell on the edge
            goes_left = part[:, f] < hi[f]
            cut = float(hi[f])
        nodes.append([tree, me, f, cut, -1, -1, 0.0])
        todo.append((rows[~goes_left], depth + 1, me, "r"))
        todo.append((rows[goes_left], depth + 1, me, "l"))
    cols = ["tree", "node", "feature", "cut", "left", "right", "depth"]
    return pd.DataFrame(nodes, columns=cols)


def fit_forest_nodes(
    df: DataFrame,
    feats: Sequence[str],
    id_cols: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> tuple[DataFrame, int, int]:
    """Node table of the forest, rows per tree and training rows. The table has at most
    trees * (2 * sample - 1) rows, whatever the input."""
    usable = df.select(*dict.fromkeys([*id_cols, *feats])).dropna(subset=list(feats))
    n_rows = usable.count()
    drawn = sample_per_tree(usable, feats, id_cols, n_rows, trees, sample, seed)
    size = min(sample, n_rows)
    nodes = drawn.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, seed, size), _NODES)
    return nodes, size, n_rows


class Forest:
    """Node arrays of a fitted forest, small and of fixed size, shipped inside the scoring UDF."""

    def __init__(self, nodes: pd.DataFrame, feats: Sequence[str], sample: int, offset: float = 0.0):
        self.feats = tuple(feats)
        self.sample = sample
        self.offset = offset
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        first = nodes.groupby("tree").cumcount().eq(0).to_numpy()
        start = np.flatnonzero(first)
        base = np.repeat(start, np.diff(np.append(start, len(nodes))))
        self.roots = start.astype(np.int32)
        self.feature = np.maximum(nodes["feature"].to_numpy(), 0).astype(np.int32)
        leaf = nodes["feature"].to_numpy() < 0
        self.cut = np.where(leaf, np.inf, nodes["cut"].to_numpy())
        sides = nodes[["left", "right"]].to_numpy() + base[:, None]
        self.child = sides.astype(np.int32).ravel()  # child of n: [2n] left, [2n + 1] right
        self.depth = nodes["depth"].to_numpy(dtype=float)
        self.levels = math.ceil(math.log2(max(sample, 2)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean depth / c) - offset for a block of rows; lower is more anomalous."""
        out = np.empty(len(x))
        norm = average_path(self.sample) or 1.0
        for a in range(0, len(x), 2048):  # keeps the (rows, trees) index block in cache
            block = np.ascontiguousarray(x[a : a + 2048])
            flat = block.ravel()
            line = (np.arange(len(block), dtype=np.int32) * block.shape[1])[:, None]
            at = np.broadcast_to(self.roots, (len(block), len(self.roots)))
            for _ in range(self.levels):
                value = flat.take(line + self.feature.take(at))
                at = self.child.take(2 * at + (value >= self.cut.take(at)))
            depth = self.depth.take(at).mean(axis=1)
            out[a : a + 2048] = -np.exp2(-depth / norm) - self.offset
        return out

    def score_column(self) -> Column:
        forest = self

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in parts:
                x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
                yield pd.Series(forest.decision(x))

        return score(*[F.col(f).cast("double") for f in self.feats])

    def score_expression(self) -> Column:
        """The same score as a column of built-in functions, without Python workers: the nodes are folded
        constants, and one walk moves all trees down a level at a time. Rows that lack a feature score null.
        Per tree and row it costs more than ``score_column``, whose start-up and transfer it saves."""
        feature, cut = constant_array(self.feature, "int"), constant_array(np.where(np.isinf(self.cut), 0.0, self.cut))
        child, depth = constant_array(self.child, "int"), constant_array(self.depth)
        roots = constant_array(self.roots, "int")
        norm = average_path(self.sample) or 1.0

        def score(x: Column) -> Column:
            def below(at: Column) -> Column:
                value = F.get(x, F.get(feature, at))
                right = (value >= F.get(cut, at)) & ~F.isnan(value)
                return F.get(child, 2 * at + right.cast("int"))  # both children of a leaf are itself

            levels = F.sequence(F.lit(1), F.lit(max(self.levels, 1)))
            leaves = F.aggregate(levels, roots, lambda at, _: F.transform(at, below))
            total = F.aggregate(leaves, F.lit(0.0), lambda s, at: s + F.get(depth, at))
            return -F.pow(F.lit(2.0), -(total / float(len(self.roots)) / norm)) - self.offset

        features = F.array(*[F.col(f).cast("double") for f in self.feats])
        known = ~F.exists(features, F.isnull)
        return F.when(known, F.get(F.transform(F.array(features), score), F.lit(0)))  # binds the features once


def _collect_nodes(nodes: DataFrame) -> pd.DataFrame:
    return nodes.toPandas()  # trees * (2 * sample - 1) rows at most


def fit_iforest(
    df: DataFrame,
    feats: Sequence[str],
    id_cols: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> Forest:
    """Fit on standard-scaled columns; the offset makes ``contamination`` of the training rows
    score below zero."""
    forest, _ = fit_and_score_iforest(df, feats, id_cols, (), trees, sample, contamination, seed)
    return forest


def fit_and_score_iforest(
    df: DataFrame,
    feats: Sequence[str],
    id_cols: Sequence[str],
    keep: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> tuple[Forest, DataFrame]:
    """The fitted forest, and the training rows (columns ``keep``) with the ``score`` it gives them.

    The offset is found on the raw scores, so each row walks the trees once: what is stored is
    shifted, not scored again."""
    nodes, size, n_rows = fit_forest_nodes(df, feats, id_cols, trees, sample, seed)
    forest = Forest(_collect_nodes(nodes), feats, size)
    raw = settled(score_iforest(df, forest).select(*keep, "score"))
    found = contamination_offset(raw, contamination, at_most=n_rows if n_rows <= BUFFER_ROWS else None)
    forest.offset = found.first()["offset"]
    return forest, raw.withColumn("score", F.col("score") - forest.offset)


def score_iforest(df: DataFrame, forest: Forest, out: str = "score", native: bool = False) -> DataFrame:
    """Score rows in Arrow batches, or by built-in functions (``native``); rows lacking a feature are
    dropped, as they cannot be scored."""
    score = forest.score_expression() if native else forest.score_column()
    return df.dropna(subset=list(forest.feats)).withColumn(out, score)


def forest_tables(spark: SparkSession, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """(nodes, meta) frames for saving."""
    roots = np.zeros(len(forest.cut), dtype=int)
    roots[forest.roots] = 1
    base = forest.roots[np.cumsum(roots) - 1]
    leaf = np.isinf(forest.cut)
    nodes = pd.DataFrame(
        {
            "tree": np.cumsum(roots) - 1,
            "node": np.arange(len(forest.cut)) - base,
            "feature": np.where(leaf, -1, forest.feature),
            "cut": np.where(leaf, 0.0, forest.cut),
            "left": forest.child[0::2] - base,
            "right": forest.child[1::2] - base,
            "depth": forest.depth,
        }
    )
    meta = [(list(forest.feats), int(forest.sample), float(forest.offset))]
    return (
        spark.createDataFrame(nodes, _NODES),
        spark.createDataFrame(meta, "feats ARRAY<STRING>, sample INT, offset DOUBLE"),
    )


def forest_from_tables(nodes: DataFrame, meta: DataFrame) -> Forest:
    m = meta.first()
    return Forest(_collect_nodes(nodes), m["feats"], m["sample"], m["offset"])
