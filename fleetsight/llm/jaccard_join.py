"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share, exactly.

Words are maximal runs of bytes that are no ASCII white space, A-Z lower-cased. A document's set has
its distinct shingles of ``K`` consecutive words, as 64-bit hashes; with fewer words, the whole
sequence as one shingle. Two documents link when 100 * intersection >= 80 * union. The result names
each document's component: the smallest id reachable by links.

Method:

1. Equal sets are one class, represented by its smallest id.
2. Tiles. Linked sets share one of their ``size - ceil(0.8 size) + 1`` first shingles in any fixed
   order. The order puts frequent shingles last: those counted often are listed (at most ``HOT_LIMIT``
   of them, a bounded broadcast). The order only decides how much work there is, never the result.
   Sizes are cut into bands. The representatives of one band that share a first shingle are a tile.
3. Candidates within a tile are compared by size, then by bitmaps of hashed shingles, whose bit counts
   bound the overlap from above, then by exact intersection of the sorted arrays.
4. First every member is compared with its tile's pivot (the smallest id): linear in the tile. The
   links are joined into components. Then members of different components of a tile are compared by
   size and bitmap; a tile reports only as many pairs of components as connect those that may link.
   The clusters of components so connected get their members' sets, and members of different components
   are compared exactly; as soon as two components link they count as one, so again only as many links
   are reported as connect them. Large tiles and clusters are cut into blocks; the members outside the
   largest component visit every block.

Defined cases: null and empty texts have an empty set and link with nothing; equal texts always link;
rows without an id link with nothing and get a null component; rows with the same id count as one
document when links are followed; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm.components import connected_components
from fleetsight.llm.store import stored
from fleetsight.llm.text import Words, distinct, gram_hashes, text_slices
from fleetsight.plans.sizing import broadcast_if_small

K = 5
# The similarity at which documents link, as a fraction.
NUMERATOR, DENOMINATOR = 80, 100
# Shingles counted at a time by a task, and how often one must occur there to be reported.
COUNTED, REPORTED = 3_000_000, 2
# Shingles in at least so many sets are frequent; the list holds at most so many.
HOT, HOT_LIMIT = 8, 250_000
BLOCK = 2_000
# Shingles that a block of a cluster holds at once.
BLOCK_SHINGLES = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of every text of a slice."""
    words = Words(data, offsets)
    grams = words.grams(K)
    out = []
    for a, b in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        if b - a >= K:
            out.append(distinct(grams[a : b - K + 1]))
        else:
            out.append(gram_hashes(words.hashes[a:b], b - a) if b > a else grams[:0])
    return out


def required(n_a: int, n_b: int) -> int:
    """Smallest intersection with which sets of these sizes link."""
    return -(-NUMERATOR * (n_a + n_b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per hashed shingle; twice as many bits as shingles, between 128 and 4096."""
    bits = min(4096, max(128, 1 << (2 * len(shingles) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[(shingles >> np.uint64(20)) % np.uint64(bits)] = 1
    return np.packbits(out).tobytes()


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """No intersection is larger than this: a bit that only one side has is a shingle the other lacks."""
    size = min(len(bits_a), len(bits_b))
    x, y = _folded(bits_a, size), _folded(bits_b, size)
    both = x & y
    return min(n_a - (x ^ both).bit_count(), n_b - (y ^ both).bit_count())


def _folded(bits: bytes, size: int) -> int:
    """A bitmap modulo a smaller power of two of bytes."""
    out = 0
    for i in range(0, len(bits), size):
        out |= int.from_bytes(bits[i : i + size], "big")
    return out


def _batch(names: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


_SCAN = "doc_id LONG, n_shingles LONG, digest BINARY, shingle LONG, n LONG"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> a row per document with the size and digest of its set, and rows of shingles
    that are frequent among some texts, each distinct set counted once."""
    waiting: list[np.ndarray] = []
    seen: set[bytes] = set()

    def frequent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(waiting), return_counts=True)
        often = counts >= REPORTED
        shingles = pa.array(values[often].view(np.int64))
        n = pa.array(counts[often].astype(np.int64))
        nothing = pa.nulls(len(n), pa.int64())
        waiting.clear()
        seen.clear()
        return _batch("doc_id n_shingles digest shingle n", nothing, nothing, pa.nulls(len(n), pa.binary()), shingles, n)

    for batch in batches:
        sizes, digests = [], []
        for _, data, offsets in text_slices(batch.column(1)):
            for s in shingle_sets(data, offsets):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                digests.append(digest)
                if digest not in seen:
                    seen.add(digest)
                    waiting.append(s)
            if sum(map(len, waiting)) >= COUNTED:
                yield frequent()
        nothing = pa.nulls(len(sizes), pa.int64())
        yield _batch(
            "doc_id n_shingles digest shingle n", batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), nothing, nothing
        )
    if waiting:
        yield frequent()


def frequent_shingles(scanned: DataFrame) -> np.ndarray:
    """The most frequent shingles in order of frequency, at most HOT_LIMIT: the least count that keeps to
    the limit is found from counts of counts."""
    counts = scanned.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    counts = stored(counts.withColumn("level", F.floor(F.log2("n")).cast("int")), "frequent")
    least, total = 1 << 62, 0
    for level, n in sorted(((r.level, r.c) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        total += n
        if total > HOT_LIMIT:
            break
        least = level
    table = counts.where(F.col("level") >= min(least, 1 << 30)).select("shingle", "n").toArrow()
    shingles = table.column("shingle").to_numpy().view(np.uint64)
    return shingles[np.lexsort((shingles, table.column("n").to_numpy()))]


_FEATURES = "doc_id LONG, digest BINARY, n LONG, bits BINARY, rare ARRAY<LONG>, frequent ARRAY<LONG>"


def _features(sent):
    """(doc_id, text) -> (doc_id, digest, size, bitmap, first shingles: rare ones, frequent ones)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        order = np.argsort(hot)
        hot_sorted = hot[order]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            seen: set[bytes] = set()
            for first, data, offsets in text_slices(batch.column(1)):
                for i, s in enumerate(shingle_sets(data, offsets)):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if not len(s) or ids[first + i] is None:
                        continue
                    length = prefix_length(len(s))
                    rank = np.zeros(len(s), dtype=np.int64)
                    if len(hot_sorted):
                        at = np.minimum(np.searchsorted(hot_sorted, s), len(hot_sorted) - 1)
                        rank = np.where(hot_sorted[at] == s, order[at] + 1, 0)
                    rare = s[rank == 0][:length]
                    frequent = s[rank > 0][np.argsort(rank[rank > 0])][: length - len(rare)]
                    rows.append((ids[first + i], digest, len(s), bitmap(s), rare.view(np.int64), frequent.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.binary()),
                        _lists([r[4] for r in rows]),
                        _lists([r[5] for r in rows]),
                    ],
                    names="doc_id digest n bits rare frequent".split(),
                )

    return features


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for _, data, offsets in text_slices(batch.column(1)):
            sets += [s.tobytes() for s in shingle_sets(data, offsets)]
        yield _batch("doc_id shingles", batch.column(0), pa.array(sets, pa.binary()))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for a link."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        good = [overlap_bound(na, xa, nb, xb) >= required(na, nb) for _, _, na, xa, nb, xb in zip(*columns)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _intersecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, by exact intersection of the sorted arrays."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            small, large = (s, t) if len(s) <= len(t) else (t, s)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            good.append(int((large[at] == small).sum()) >= required(len(s), len(t)))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sizes_fit(n_a: str, n_b: str):
    return F.expr(f"{DENOMINATOR} * least({n_a}, {n_b}) >= {NUMERATOR} * greatest({n_a}, {n_b})")


def _exact_links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Shingles are computed again for the documents in question only."""
    pairs = stored(pairs.distinct(), "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = docs.join(broadcast_if_small(ids, ids.count()), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(texts.mapInArrow(_sets, "doc_id LONG, shingles BINARY"), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_intersecting, "a LONG, b LONG"), "links")


def _bands(n: str) -> Column:
    """Bands of sizes by powers of two: a set's own, and the one that larger sets it may link with are in.
    So sets of linking sizes have a band in common, that of the larger one."""
    own, next_ = F.length(F.bin(n)), F.length(F.bin(F.expr(f"{n} * {DENOMINATOR} div {NUMERATOR}")))
    return F.array_distinct(F.array(own, next_))


def _banded(features: DataFrame, shingles: str) -> DataFrame:
    """(tile, node): a tile has the sets of one band with one shingle among their first ones."""
    rows = features.select("doc_id", F.explode(_bands("n")).alias("band"), shingles)
    rows = rows.select(F.col("doc_id").alias("node"), "band", F.explode(shingles).alias("shingle"))
    return rows.select(F.xxhash64("shingle", "band").alias("tile"), "node")


def _tiles(features: DataFrame) -> DataFrame:
    """(tile, node, members, pivot) of the tiles with two members or more."""
    rare = _banded(features, "rare")
    own = Window.partitionBy("tile")
    rare = rare.withColumn("members", F.count(F.lit(1)).over(own)).withColumn("pivot", F.min("node").over(own))
    # Tiles of frequent shingles may be large: their pivots come from a combined aggregation of bounded
    # size, so that their members stay where they are.
    frequent = _banded(features, "frequent")
    pivots = frequent.groupBy("tile").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot"))
    # At most HOT_LIMIT shingles in the bands there are.
    frequent = frequent.join(F.broadcast(pivots.where("members > 1")), "tile").select(*rare.columns)
    return stored(rare.unionByName(frequent).where("members > 1"), "tiles")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by their first two columns -> tables of whole groups, with the bounds of the groups."""
    rest: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        group, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        return np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        last = rest[-1].slice(rest[-1].num_rows - 1) if rest else None
        if last is not None and all(last.column(i)[0] == batch.column(i)[batch.num_rows - 1] for i in range(2)):
            rest.append(batch)
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        cuts = bounds(table)
        end = int(cuts[-1]) if len(cuts) else 0
        if end:
            yield table.slice(0, end), [0, *cuts.tolist()]
        rest = [b for b in table.slice(end).to_batches() if b.num_rows]
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, [0, *bounds(table).tolist(), table.num_rows]


class Classes:
    """Components of the members of a group. Joining two is reported once, so what a group reports has
    fewer rows than it has components."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1]

    def others(self, p: int, near: np.ndarray) -> np.ndarray:
        """Those of ``near`` that are not in the class of ``p``."""
        return near[self.of[near] != self.of[p]]

    def join(self, p: int, found: np.ndarray) -> np.ndarray:
        """Joins the classes of ``found`` with that of ``p``; returns one of ``found`` for each."""
        classes, at = np.unique(self.of[found], return_index=True)
        self.of[np.isin(self.of, classes)] = self.of[p]
        return found[at]


def _near(sizes: np.ndarray, n: int) -> slice:
    """Places, in sorted sizes, of those that may link with a set of ``n``."""
    low = np.searchsorted(sizes, -(-NUMERATOR * n // DENOMINATOR))
    return slice(int(low), int(np.searchsorted(sizes, DENOMINATOR * n // NUMERATOR, side="right")))


def _needed(n: int, sizes: np.ndarray) -> np.ndarray:
    return -(-NUMERATOR * (n + sizes) // (NUMERATOR + DENOMINATOR))


def _matrix(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the shortest."""
    size = min(map(len, bitmaps))
    rows = [np.bitwise_or.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, size // 8), axis=0) for b in bitmaps]
    return np.stack(rows)


def _room(matrix: np.ndarray, ones: np.ndarray, n: np.ndarray, p: int, near: np.ndarray) -> np.ndarray:
    """Those of ``near`` whose bitmaps leave room for a link with ``p`` (see ``overlap_bound``)."""
    both = np.bitwise_count(matrix[near] & matrix[p]).sum(axis=1, dtype=np.int64)
    bound = np.minimum(n[p] - (ones[p] - both), n[near] - (ones[near] - both))
    return near[bound >= _needed(int(n[p]), n[near])]


_GROUP = "tile block node n component bits probe".split()


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tile, block) -> pairs of components (a, b) that may link by what their members'
    sizes and bitmaps tell, as few as connect them."""
    for table, cuts in _runs(batches):
        node, n, component = (table.column(c).to_numpy() for c in ("node", "n", "component"))
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        bits = table.column("bits").to_pylist()
        out_a: list[int] = []
        out_b: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = component[a:b]
            if (own == own[0]).all():
                continue
            classes, size = Classes(own), n[a:b]
            members = np.flatnonzero(~probe[a:b])
            members = members[np.argsort(size[members], kind="stable")]
            sizes = size[members]
            matrix = ones = None
            for p in np.flatnonzero(probe[a:b]).tolist():
                near = classes.others(p, members[_near(sizes, int(size[p]))])
                if not len(near):
                    continue
                if len(near) <= 8:
                    m = int(size[p])
                    good = [q for q in near.tolist() if overlap_bound(m, bits[a + p], int(size[q]), bits[a + q]) >= required(m, int(size[q]))]
                    near = np.array(good, dtype=np.int64)
                else:
                    if matrix is None:
                        matrix = _matrix(bits[a:b])
                        ones = np.bitwise_count(matrix).sum(axis=1, dtype=np.int64)
                    near = _room(matrix, ones, size, p, near)
                if len(near):
                    for q in classes.join(p, near).tolist():
                        out_a.append(int(own[p]))
                        out_b.append(int(own[q]))
        if out_a:
            yield _batch("a b", pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()))


def _bits(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Bitmaps of ``size`` bits as rows of 64-bit words."""
    out = np.zeros((len(sets), size // 64), dtype=np.uint64)
    for row, s in zip(out, sets):
        at = (s >> np.uint64(20)) % np.uint64(size)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class _Block:
    """The members of one block of a cluster, and the classes that their components are joined into.
    Visitors come one by one and are not held."""

    def __init__(self):
        self.node: list[int] = []
        self.component: list[int] = []
        self.sets: list[np.ndarray] = []
        self.size: np.ndarray | None = None

    def add(self, node: int, component: int, shingles: bytes) -> None:
        self.node.append(node)
        self.component.append(component)
        self.sets.append(np.frombuffer(shingles, dtype=np.uint64))

    def close(self) -> None:
        order = sorted(range(len(self.sets)), key=lambda i: len(self.sets[i]))
        self.node, self.component, self.sets = ([x[i] for i in order] for x in (self.node, self.component, self.sets))
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.bits = max(128, 1 << (2 * int(self.size[-1]) - 1).bit_length()) if len(self.size) else 128
        self.matrix = _bits(self.sets, self.bits)
        self.ones = np.bitwise_count(self.matrix).sum(axis=1, dtype=np.int64)
        self.name: dict[int, int] = {}
        self.above: list[int] = []
        self.of = np.array([self._class(c) for c in self.component], dtype=np.int64)

    def _class(self, component: int) -> int:
        at = self.name.setdefault(component, len(self.above))
        if at == len(self.above):
            self.above.append(at)
        while self.above[at] != at:
            at = self.above[at]
        return at

    def visit(self, component: int, shingles: bytes) -> list[int]:
        """Nodes of members that a visitor links with, one of each class it is joined with."""
        if self.size is None:
            self.close()
        s = np.frombuffer(shingles, dtype=np.uint64)
        n, own = len(s), self._class(component)
        fit = _near(self.size, n)
        near = np.flatnonzero(self.of[fit] != own) + fit.start
        if not len(near):
            return []
        bits = _bits([s], self.bits)[0]
        both = np.bitwise_count(self.matrix[near] & bits).sum(axis=1, dtype=np.int64)
        ones = int(np.bitwise_count(bits).sum(dtype=np.int64))
        bound = np.minimum(n - (ones - both), self.size[near] - (self.ones[near] - both))
        near = near[bound >= _needed(n, self.size[near])]
        if not len(near):
            return []
        # All candidates' sorted arrays against that of the visitor.
        others = np.concatenate([self.sets[q] for q in near.tolist()])
        at = np.minimum(np.searchsorted(s, others), n - 1)
        begin = np.cumsum(self.size[near]) - self.size[near]
        common = np.add.reduceat(s[at] == others, begin, dtype=np.int64)
        near = near[common >= _needed(n, self.size[near])]
        classes, first = np.unique(self.of[near], return_index=True)
        for c in classes.tolist():
            self.above[c] = own
        self.of[np.isin(self.of, classes)] = own
        return [self.node[q] for q in near[first].tolist()]


def _verify_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, block, probe) -> links (a, b), exact, as few as connect the components. A
    block's members are held, its visitors stream past them."""
    key, block = None, _Block()
    for batch in batches:
        out_a: list[int] = []
        out_b: list[int] = []
        columns = [batch.column(c).to_pylist() for c in ("cluster", "block", "node", "component", "probe")]
        held = batch.column(batch.schema.get_field_index("shingles"))
        for i, (cluster, number, node, component, probe) in enumerate(zip(*columns)):
            if (cluster, number) != key:
                key, block = (cluster, number), _Block()
            if not probe:
                block.add(node, component, held[i].as_py())
            else:
                found = block.visit(component, held[i].as_buffer())
                out_a += [node] * len(found)
                out_b += found
        if out_a:
            yield _batch("a b", pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()))


def _dealt(members: DataFrame, group: str, blocks: Column, columns: list[str]) -> DataFrame:
    """Members of a group in blocks by hash; those outside its largest component visit every block."""
    members = members.withColumn("blocks", blocks.cast("int"))
    build = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("probe", F.lit(False))
    probes = members.where("component <> largest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = build.select(*columns).unionByName(probes.withColumn("probe", F.lit(True)).select(*columns))
    return rows.repartition(group, "block").sortWithinPartitions(group, "block", "probe")


def _open_groups(named: DataFrame, group: str, *more: Column) -> DataFrame:
    """(group, largest, ...) of the groups with several components."""
    shares = named.groupBy(group, "component").agg(F.count(F.lit(1)).alias("c"), *more)
    sums = [F.sum(c).alias(c) for c in shares.columns[3:]]
    tops = shares.groupBy(group).agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("components"), F.sum("c").alias("held"), *sums)
    return tops.where("components > 1").select(group, F.col("top.component").alias("largest"), "held", *[s for s in shares.columns[3:]])


def _unsettled(tiles: DataFrame, features: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs of components (a, b) with members in one tile that may link. A tile of two is settled by its
    pivot."""
    named = tiles.where("members > 2").join(components, "node", "left")
    named = stored(named.select("tile", "node", F.coalesce("component", "node").alias("component")), "named")
    open_tiles = _open_groups(named, "tile")
    size = features.select(F.col("doc_id").alias("node"), "n", "bits")
    members = named.join(open_tiles, "tile").join(size, "node")
    dealt = _dealt(members, "tile", F.ceil(F.col("held") / BLOCK), _GROUP)
    return stored(dealt.mapInArrow(_compare_groups, "a LONG, b LONG"), "unsettled")


def _settle(pairs: DataFrame, features: DataFrame, components: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that ``pairs`` connect. Each connected cluster of components is looked at
    as a whole, band by band, with the sets of its members at hand."""
    clusters = stored(connected_components(pairs), "clusters").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    named = features.select(F.col("doc_id").alias("node"), "n").join(components, "node", "left")
    named = named.select("node", "n", F.coalesce("component", "node").alias("component")).join(clusters, "component")
    banded = named.select("node", "n", "component", "cluster", F.explode(_bands("n")).alias("band"))
    named = stored(banded.select("node", "n", "component", F.xxhash64("cluster", "band").alias("cluster")), "clustered")
    members = named.join(_open_groups(named, "cluster", F.sum("n").alias("shingles_held")), "cluster")
    ids = stored(members.select(F.col("node").alias("doc_id")).distinct(), "ids")
    texts = docs.join(broadcast_if_small(ids, ids.count()), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(_sets, "doc_id LONG, shingles BINARY").where("octet_length(shingles) > 0")
    sets = stored(sets.withColumnRenamed("doc_id", "node").distinct(), "sets")
    blocks = F.ceil(F.greatest(F.col("held") / BLOCK, F.col("shingles_held") / BLOCK_SHINGLES))
    columns = ["cluster", "block", "node", "component", "shingles", "probe"]
    dealt = _dealt(members.join(sets, "node"), "cluster", blocks, columns)
    return stored(dealt.mapInArrow(_verify_groups, "a LONG, b LONG"), "more-links")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    scanned = stored(docs.mapInArrow(_scan, _SCAN), "scan")
    sets = scanned.where("shingle IS NULL").select("doc_id", "n_shingles", "digest")
    classes = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(classes, "classes")
    hot = spark.sparkContext.broadcast(frequent_shingles(scanned))
    features = docs.mapInArrow(_features(hot), _FEATURES).join(classes, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    features = stored(features.select("doc_id", "n", "bits", "rare", "frequent"), "features")
    tiles = _tiles(features)

    light = features.select("doc_id", "n", "bits")
    pairs = tiles.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(light.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    pairs = pairs.join(light.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    pairs = pairs.where(_sizes_fit("n_a", "n_b")).select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    links = _exact_links(pairs.mapInArrow(_bounded, "a LONG, b LONG"), docs)
    components = stored(connected_components(links), "components")

    unsettled = _unsettled(tiles, light, components)
    more = _settle(unsettled, light, components, docs) if unsettled.head(1) else unsettled
    if more.head(1):
        components = stored(connected_components(links.unionByName(more)), "components")
    named = classes.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("digest", F.coalesce("component", "doc_id").alias("component"))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return sets.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )
