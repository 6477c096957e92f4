"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan of probed lists.

Index: a number next to the vector gives all the same length (the longest norm), so the largest inner
product is the smallest distance. Lists are the cells of about sqrt(N) centroids, fitted on a bounded
sample (``SAMPLE`` vectors, those with the smallest hash of their id); every vector is in one list.
Lists are cut into blocks of about ``BLOCK`` vectors by a hash of the id, so a list of any size is
spread.

Search: vectors are rotated at random and looked at in blocks of ``COLUMNS`` dimensions. After each
block a hypothesis test compares the partial distance, scaled to all dimensions, with the query's bound
(its k-th best so far), and candidates that are too far with high confidence are abandoned; the rest
go on. Survivors are scored exactly, in double precision, on the vectors as given. The bound comes from
the query's first few lists; a second pass visits its other probed lists, without those that cannot hold
anything better than the bound by their radius.

Recall is measured in the tests. Data without structure needs most of its lists probed; the share is a
parameter.

Defined cases: vectors that are null or zero, hold a null or a non-finite component, have no id, or
have another length than most vectors take no part; ties go to the smaller id; repeated rows of an id
count once, with their best score; a query finds all candidates if there are fewer than k; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm.store import stored

K = 20
SAMPLE = 40_000
MAX_LISTS = 2_048
ROUNDS = 8
# Lists of the first pass, and the share of all lists that a query may probe.
FIRST = 4
PROBED = 0.75
BLOCK = 2_048
QUERIES = 4_096
COLUMNS = 16
# Width of the hypothesis test in standard deviations.
SURE = 2.1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, whatever their length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _padded(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm, started from the first rows of the sample."""
    centroids = sample[:n_lists].copy()
    for _ in range(rounds):
        owner = _closest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        n = np.bincount(owner, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids**2).sum(axis=1)
    return np.concatenate(
        [(x[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)]
    )


def rotation(size: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _assign(sent):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, centroids = sent.value["norm"], sent.value["centroids"]
        for batch in batches:
            x = _padded(_matrix(batch.column(1)), norm)
            owner = _closest(x, centroids)
            far = np.sqrt(((x - centroids[owner]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner.astype(np.int32)), pa.array(far), batch.column(0), batch.column(1)], names=["list", "far", "vec_id", "v"]
            )

    return assign


def _probe(sent, k: int, first_pass: bool):
    """(vec_id, v, bound) -> (list, query_id, v, bound) for the lists of this pass."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        centroids, sizes, radius = index["centroids"], index["sizes"], index["radius"]
        half = 0.5 * (centroids**2).sum(axis=1)
        share = math.ceil(PROBED * len(centroids))
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                q = _matrix(part.column(1))
                bound = part.column(2).to_numpy(zero_copy_only=False)
                inner = q @ centroids[:, :-1].T
                order = np.argsort(half - inner, axis=1, kind="stable")
                # Lists in order until they hold enough vectors beside the query itself.
                held = np.cumsum(sizes[order], axis=1)
                enough = 1 + (held < k + 1).sum(axis=1)
                first = np.minimum(np.maximum(enough, FIRST), len(centroids))
                last = np.minimum(np.maximum(first, share), len(centroids))
                place = np.arange(len(centroids))[None, :]
                if first_pass:
                    chosen = place < first[:, None]
                else:
                    best = inner + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
                    possible = np.take_along_axis(best, order, axis=1) >= bound[:, None] - 1e-9
                    chosen = (place >= first[:, None]) & (place < last[:, None]) & possible
                row, at = np.nonzero(chosen)
                for a in range(0, len(row), 20_000):
                    r = row[a : a + 20_000]
                    rows = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(order[r, at[a : a + 20_000]].astype(np.int32)),
                            part.column(0).take(rows),
                            part.column(1).take(rows),
                            part.column(2).take(rows),
                        ],
                        names=["list", "query_id", "v", "bound"],
                    )

    return probe


def surviving(q: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) not abandoned. ``q`` and ``x`` are rotated; ``limit`` is the largest
    squared distance of interest of each query."""
    size = q.shape[1]
    partial = np.zeros((len(q), len(x)), dtype=np.float32)
    alive = np.ones(partial.shape, dtype=bool)
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    known = np.zeros(0, dtype=np.float32)
    for d in range(0, size, COLUMNS):
        a, b = q[:, d : d + COLUMNS], x[:, d : d + COLUMNS]
        done = min(d + COLUMNS, size)
        # Full distances only leave room for rounding; partial ones for chance.
        slack = 1.0001 if done == size else (1 + SURE / math.sqrt(done)) ** 2
        most = limit * slack * done / size + 1e-5
        if pairs is None:
            partial += (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
            alive &= partial <= most[:, None]
            if alive.mean() < 0.2:
                pairs = np.nonzero(alive)
                known = partial[pairs]
        else:
            known = known + ((a[pairs[0]] - b[pairs[1]]) ** 2).sum(axis=1)
            keep = known <= most[pairs[0]]
            pairs, known = (pairs[0][keep], pairs[1][keep]), known[keep]
    return np.nonzero(alive) if pairs is None else pairs


def _scan(sent, k: int):
    """Vectors of a block and queries that probe it -> each query's best ones there."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        norm, turn = sent.value["norm"], sent.value["rotation"]
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks())
        # Smaller ids first, so that of equal scores the first ones win.
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        qids, q = right.column("query_id").to_numpy(), _matrix(right.column("v").combine_chunks())
        bound = right.column("bound").to_numpy()
        turned = (_padded(x, norm) @ turn).astype(np.float32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for begin in range(0, len(q), 512):
            some, own, low = q[begin : begin + 512], qids[begin : begin + 512], bound[begin : begin + 512]
            asked = (np.concatenate([some, np.zeros((len(some), 1))], axis=1) @ turn).astype(np.float32)
            limit = ((some**2).sum(axis=1) + norm**2 - 2 * low).astype(np.float32)
            row, at = surviving(asked, turned, limit)
            other = own[row] != ids[at]
            row, at = row[other], at[other]
            score = np.einsum("ij,ij->i", some[row], x[at])
            # An id on several rows counts once, with its best score.
            by = np.lexsort((-score, ids[at], row))
            row, at, score = row[by], at[by], score[by]
            once = np.append(True, (row[1:] != row[:-1]) | (ids[at[1:]] != ids[at[:-1]])) if len(row) else by > 0
            row, at, score = row[once], at[once], score[once]
            by = np.lexsort((ids[at], -score, row))
            row, at, score = row[by], at[by], score[by]
            start = np.searchsorted(row, np.arange(len(some)))
            keep = np.arange(len(row)) - start[row] < k
            out.append((own[row[keep]], ids[at[keep]], score[keep]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return scan


def _grid(vectors: DataFrame, probes: DataFrame, sizes: DataFrame, scan) -> DataFrame:
    """Every probe meets every block of its list. Lists that many queries probe are met in chunks."""
    asked = probes.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    plan = sizes.join(asked, "list").select(
        "list", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks"), F.expr(f"cast(ceil(asked / {QUERIES}) as int)").alias("chunks")
    )
    plan = F.broadcast(plan)  # one row per list, at most MAX_LISTS
    left = vectors.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "block", "chunk", "vec_id", "v")
    right = probes.join(plan, "list").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "chunk", "query_id", "v", "bound")
    key = ["list", "block", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scan, "query_id LONG, vec_id LONG, score DOUBLE")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """At most ``SAMPLE`` rows, those with the smallest hash of their id. A threshold on the hash goes first, so
    that hardly more rows than are wanted reach the final cut, however many partitions there are."""
    key = F.md5(F.col("vec_id").cast("string"))
    if n > SAMPLE:
        share = min(1.0, (SAMPLE + 6 * SAMPLE**0.5) / n)  # short of SAMPLE once in a billion draws, by a few rows
        rows = rows.where(F.conv(F.left(key, F.lit(8)), 16, 10).cast("long") < int(share * (1 << 32)))
    return rows.orderBy(key, "vec_id").limit(SAMPLE)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector of ``queries`` the k nearest ones of ``vectors``
    found, but for those with its own id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id LONG, rank INT, vec_id LONG, score DOUBLE")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return empty
    rows = rows.where(F.size("v") == common.d)
    queries = usable(queries, id_col, vector_col).where(F.size("v") == common.d)
    norm = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first().m ** 0.5
    sample = _sample(rows, common.n).toArrow().column("v").combine_chunks()
    n_lists = min(MAX_LISTS, max(1, round(common.n**0.5)), len(sample))
    centroids = fit_centroids(_padded(_matrix(sample), norm), n_lists)
    index = {"norm": norm, "centroids": centroids}
    sent = spark.sparkContext.broadcast(index)
    assigned = stored(rows.mapInArrow(_assign(sent), "list INT, far DOUBLE, vec_id LONG, v ARRAY<DOUBLE>"), "lists")
    sizes = stored(assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")), "sizes")
    n, radius = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids))
    for r in sizes.collect():  # one row per list
        n[r.list], radius[r.list] = r.n, r.far
    sent = spark.sparkContext.broadcast({**index, "sizes": n, "radius": radius, "rotation": rotation(common.d + 1)})

    probe = "list INT, query_id LONG, v ARRAY<DOUBLE>, bound DOUBLE"
    vectors = assigned.select("list", "vec_id", "v")
    asked = queries.select("vec_id", "v", F.lit(float("-inf")).alias("bound"))
    near = stored(asked.mapInArrow(_probe(sent, k, True), probe), "probes")
    first = stored(_ranked(_grid(vectors, near, sizes, _scan(sent, k)), k), "first")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("low"))
    asked = queries.join(bound, "vec_id", "left").select("vec_id", "v", F.coalesce("low", F.lit(float("-inf"))).alias("bound"))
    far = stored(asked.mapInArrow(_probe(sent, k, False), probe), "probes")
    second = _grid(vectors, far, sizes, _scan(sent, k))
    found = first.select("query_id", "vec_id", "score").unionByName(second)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
