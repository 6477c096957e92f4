"""Phrase collocations by relational mining over sorted occurrence relations (SETM).

Texts (A-Z lower-cased) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into
words. Everything is counted per group (the language). Phrases of 2 to ``max_words`` words with at least
``min_count`` occurrences are candidates; a candidate's score is that of its weakest cut into two
phrases, floor(1000 * a * n / (l * r)). Candidates that a longer one explains wholly are dropped.

Method:

1. Words are counted; the frequent ones get numbers. The occurrence relation R1 (piece, position, word)
   of frequent words is written, sorted.
2. For k = 2, 3, ...: R(k-1) and R1 are merge-joined by piece and adjacent position, the pairs
   (phrase, next word) are counted, and the frequent pairs get numbers. Semi-joined with them the joined
   relation becomes R(k), which is written; R1 keeps only what R(k) can still be extended by.
3. Counts of all frequent phrases meet by their words for the scores. Products are exact decimals.

A row of a relation table is a block: the sorted occurrences of whole pieces of one group, packed, so
that both relations of a block are joined where they lie. Piece and position are one number
(place): words side by side in a piece have consecutive ones, other words never. Pairs are told apart
by their numbers, not by hashes.

The frequent groups of a step are broadcast where they are counted to be at most ``BROADCAST``; beyond
that the semi-join is a shuffled join of the single occurrences, and blocks are put together again.

Defined cases: a null text is empty, a null group ``und``; other columns are not looked at; repeated
rows all count; an empty table gives an empty result; a text of any length is handled in stretches that
end at the end of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm.store import fresh_path, stored
from fleetsight.llm.text import LOWER, text_slices

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2_000
# Frequent groups that are sent to every task at once: some 30 bytes each.
BROADCAST = 2_000_000
# Bytes of text in a block.
BLOCK_BYTES = 500_000
# Words, and occurrences of pairs, that a task combines before it sends counts.
COMBINED, COMBINED_PAIRS = 300_000, 1_000_000
# A task decodes the blocks of one row group at a time. Their bytes alone would not end one: the writer
# looks at them after a hundred rows at the earliest.
ROW_GROUP_BLOCKS = 8

# Products of counts may pass 64 bits.
SCORE = (
    "CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(n AS DECIMAL(38,0)) "
    "div (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"
)

_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_GAPS = np.isin(np.arange(256), [ord(c) for c in " \t"])


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice of texts, or the stretches of one long text, each up to the end of a piece."""
    if len(offsets) != 2 or len(data) <= 2 * BLOCK_BYTES:
        yield data, offsets
        return
    begin = 0
    while begin < len(data):
        end = min(begin + BLOCK_BYTES, len(data))
        while end < len(data):
            stops = np.flatnonzero(_ENDS[data[end : end + BLOCK_BYTES]])
            if len(stops):
                end += int(stops[0]) + 1
                break
            end = min(end + BLOCK_BYTES, len(data))
        yield data[begin:end], np.array([0, end - begin])
        begin = end


def words_and_places(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts in order, and the place of each."""
    folded = LOWER[data]
    ends = _ENDS[folded]
    inside = ~(ends | _GAPS[folded])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] |= inside[heads]
    last[tails] |= inside[tails]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    piece = np.cumsum(ends, dtype=np.int64)[starts] + np.searchsorted(offsets, starts, side="right")
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(folded[inside])))
    return words, np.arange(len(starts)) + piece


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(group, text) rows -> (group, words, places) of one group's texts at a time."""
    for batch in batches:
        groups = batch.column(0)
        for group in pc.unique(groups).to_pylist():
            texts = batch.column(1).filter(pc.equal(groups, group))
            for _, data, offsets in text_slices(texts, BLOCK_BYTES):
                for some in _stretches(data, offsets):
                    words, places = words_and_places(*some)
                    if len(words):
                        yield group, words, places


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.Table] = []

    def combined() -> Iterator[pa.RecordBatch]:
        if waiting:
            total = pa.concat_tables(waiting).group_by(["grp", "word"]).aggregate([("n", "sum")])
            waiting.clear()
            pa.default_memory_pool().release_unused()
            total = total.select(["grp", "word", "n_sum"]).rename_columns(["grp", "word", "n"])
            yield from total.cast(pa.schema([("grp", pa.string()), ("word", pa.string()), ("n", pa.int64())])).to_batches(200_000)

    for group, words, _ in _blocks(batches):
        encoded = words.dictionary_encode()
        n = np.bincount(encoded.indices.to_numpy(zero_copy_only=False), minlength=len(encoded.dictionary))
        names = pa.array([group] * len(n), pa.large_string())
        waiting.append(pa.table({"grp": names, "word": encoded.dictionary, "n": n}))
        if sum(map(len, waiting)) > COMBINED:
            yield from combined()
    yield from combined()


# One block: R1 as gaps between places and word numbers; R(k) likewise (none: R1 itself). All are packed
# integers: of 4 bytes, or of 8 where a number needs them.
_RELATION = "grp STRING, places BINARY, words BINARY, at BINARY, items BINARY"
_NAMES = ["grp", "places", "words", "at", "items"]


def _gaps(places: np.ndarray) -> bytes:
    return np.diff(places, prepend=0).astype("<i4").tobytes()


def _ids(numbers: np.ndarray) -> bytes:
    return numbers.astype("<i4" if not len(numbers) or numbers.max() < 1 << 31 else "<i8").tobytes()


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), pa.int64()))


def _relation(rows: list[tuple]) -> pa.RecordBatch:
    group, *packed = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(group, pa.string()), *(pa.array(c, pa.binary()) for c in packed)], names=_NAMES)


def _numbers(cell) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


def _read(batch: pa.RecordBatch, first: int) -> Iterator[tuple]:
    """(places, words, at, items) of each block, decoded."""

    def pair(i: int, column: int) -> tuple[np.ndarray, np.ndarray]:
        places = np.cumsum(np.frombuffer(batch.column(column)[i].as_buffer(), dtype="<i4"), dtype=np.int64)
        numbers = batch.column(column + 1)[i].as_buffer()
        wide = numbers.size > 4 * len(places)
        return places, np.frombuffer(numbers, dtype="<i8" if wide else "<i4").astype(np.int64)

    for i in range(batch.num_rows):
        known = pair(i, first)
        yield *known, *(pair(i, first + 2) if batch.column(first + 2)[i].is_valid else known)


def adjacent(places: np.ndarray, words: np.ndarray, at: np.ndarray, items: np.ndarray, k: int) -> tuple:
    """Merge-join of phrases of k - 1 words with the words behind them: (at, phrase, word)."""
    if not len(places) or not len(at):
        return at[:0], items[:0], words[:0]
    want = at + (k - 1)
    j = np.minimum(np.searchsorted(places, want), len(places) - 1)
    hit = places[j] == want
    return at[hit], items[hit], words[j[hit]]


def _pruned(places: np.ndarray, words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that phrases of k words can be extended by."""
    keep = np.isin(places, at + k, assume_unique=True)
    return places[keep], words[keep]


def _count_pairs(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> pa.RecordBatch:
            prefix, word = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            if max(prefix.max(), word.max()) < 1 << 31:
                key, n = np.unique(prefix << 32 | word, return_counts=True)
                prefix, word = key >> 32, key & 0xFFFFFFFF
            else:
                order = np.lexsort((word, prefix))
                prefix, word = prefix[order], word[order]
                new = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])))
                n = np.diff(np.append(new, len(prefix)))
                prefix, word = prefix[new], word[new]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (prefix, word, n)], names=["prefix", "word", "n"])

        held = 0
        for batch in batches:
            for block in _read(batch, 0):
                _, prefix, word = adjacent(*block, k)
                if len(prefix):
                    waiting.append((prefix, word))
                    held += len(prefix)
                if held > COMBINED_PAIRS:
                    yield combined()
                    held = 0
        if waiting:
            yield combined()

    return count


class Frequent:
    """The numbers of frequent pairs, for look-ups in tasks."""

    def __init__(self, prefix: np.ndarray, word: np.ndarray, ids: np.ndarray):
        self.prefixes, p = np.unique(prefix, return_inverse=True)
        self.words, w = np.unique(word, return_inverse=True)
        keys = p.astype(np.int64) * len(self.words) + w
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def look_up(self, prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of each pair, or -1."""
        if not len(self.keys) or not len(prefix):
            return np.full(len(prefix), -1)
        p = np.minimum(np.searchsorted(self.prefixes, prefix), len(self.prefixes) - 1)
        w = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = (self.prefixes[p] == prefix) & (self.words[w] == word)
        key = p * len(self.words) + w
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(known & (self.keys[at] == key), self.ids[at], -1)


def _semi_join(k: int, sent):
    """R(k-1), R1 -> R(k), R1, with the frequent pairs at hand."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            rows = []
            for group, (places, words, at, items) in zip(batch.column(4).to_pylist(), _read(batch, 0)):
                at, prefix, word = adjacent(places, words, at, items, k)
                ids = frequent.look_up(prefix, word)
                at, ids = at[ids >= 0], ids[ids >= 0]
                places, words = _pruned(places, words, at, k)
                if len(places):
                    rows.append((group, _gaps(places), _ids(words), _gaps(at), _ids(ids)))
            if rows:
                yield _relation(rows)

    return join


def _pairs(k: int):
    """(block, relation) -> (block, at, prefix, word), for the shuffled semi-join."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [adjacent(*block, k) for block in _read(batch, 1)]
            columns = [_lists([f[i] for f in found]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["block", "at", "prefix", "word"])

    return pairs


def _settled(k: int):
    """(relation, found places and numbers) -> R(k), R1."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (places, words, _, _) in enumerate(_read(batch, 0)):
                at, ids = _numbers(batch.column(5)[i]), _numbers(batch.column(6)[i])
                places, words = _pruned(places, words, at, k)
                if len(places):
                    rows.append((batch.column(4)[i].as_py(), _gaps(places), _ids(words), _gaps(at), _ids(ids)))
            if rows:
                yield _relation(rows)

    return settle


def _first_relation(sent):
    """(group, text) -> R1 of the frequent words, with their numbers at hand."""

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for group, words, places in _blocks(batches):
            known, ids = frequent.get(group, (None, None))
            if known is None:
                continue
            encoded = words.dictionary_encode()
            at = pc.fill_null(pc.index_in(encoded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
            found = np.where(at >= 0, ids[at], -1)[encoded.indices.to_numpy(zero_copy_only=False)]
            places, found = places[found >= 0], found[found >= 0]
            if len(places):
                yield _relation([(group, _gaps(places), _ids(found), None, None)])

    return relate


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, text) -> (group, places, words as text), for the shuffled semi-join."""
    for group, words, places in _blocks(batches):
        said = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.string()), _lists([places]), said], names=["grp", "places", "said"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, places, numbers) -> R1."""
    for batch in batches:
        rows = [(batch.column(0)[i].as_py(), _gaps(_numbers(batch.column(1)[i])), _ids(_numbers(batch.column(2)[i])), None, None) for i in range(batch.num_rows)]
        if rows:
            yield _relation(rows)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A relation table, written once. Its numbers pack well."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_BLOCKS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(frequent: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Frequent groups with dense numbers ``id``, and how many there are. Only row counts per partition
    come to the driver."""
    spark = frequent.sparkSession
    place = F.monotonically_increasing_id()
    held = stored(frequent.withColumn("mark", place), name)
    sizes = sorted((r.p, r.c) for r in held.groupBy(F.shiftright("mark", 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    begins, total = [], 0
    for p, c in sizes:
        begins.append((p, total))
        total += c
    begin = spark.createDataFrame(begins, "p LONG, begin LONG")
    ids = held.join(F.broadcast(begin), F.shiftright("mark", 33) == F.col("p"))
    low = F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.select(*frequent.columns, (F.col("begin") + low).alias("id")), total


def _regrouped(single: DataFrame, frequent: DataFrame, on: list[str], block: list[str]) -> DataFrame:
    """Shuffled semi-join of single occurrences; the blocks are put together again, in order."""
    found = single.join(frequent.select(*on, "id"), on)
    whole = found.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("o"))
    return whole.select(*block, F.col("o.place").alias("found_at"), F.col("o.id").alias("found"))


def _relate_words(texts: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    if total <= BROADCAST:
        table = frequent.select("grp", "word", "id").toArrow()
        sets = {}
        for group in pc.unique(table.column("grp")).to_pylist():
            own = table.filter(pc.equal(table.column("grp"), group)).combine_chunks()
            sets[group] = own.column("word").cast(pa.large_string()).combine_chunks(), own.column("id").to_numpy()
        sent = texts.sparkSession.sparkContext.broadcast(sets)
        return _kept(texts.mapInArrow(_first_relation(sent), _RELATION), "setm-1")
    said = _kept(texts.mapInArrow(_spoken, "grp STRING, places ARRAY<LONG>, said ARRAY<STRING>").withColumn("block", F.monotonically_increasing_id()), "said")
    single = said.select("block", "grp", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("said").alias("word"))))
    blocks = _regrouped(single, frequent, ["grp", "word"], ["block", "grp"])
    return _kept(blocks.select("grp", "found_at", "found").mapInArrow(_packed, _RELATION), "setm-1")


def _extend(relation: DataFrame, frequent: DataFrame, total: int, k: int) -> DataFrame:
    packed = ["places", "words", "at", "items"]
    if total <= BROADCAST:
        table = frequent.select("prefix", "word", "id").toArrow()
        sent = relation.sparkSession.sparkContext.broadcast(Frequent(*(table.column(c).to_numpy() for c in ("prefix", "word", "id"))))
        return _kept(relation.select(*packed, "grp").mapInArrow(_semi_join(k, sent), _RELATION), f"setm-{k}")
    named = _kept(relation.withColumn("block", F.monotonically_increasing_id()), f"setm-{k}-blocks")
    pairs = named.select("block", *packed).mapInArrow(_pairs(k), "block LONG, at ARRAY<LONG>, prefix ARRAY<LONG>, word ARRAY<LONG>")
    single = pairs.select("block", F.inline(F.arrays_zip(F.col("at").alias("place"), "prefix", "word")))
    blocks = _regrouped(single, frequent, ["prefix", "word"], ["block"])
    joined = named.join(blocks, "block").select(*packed, "grp", "found_at", "found")
    return _kept(joined.mapInArrow(_settled(k), _RELATION), f"setm-{k}")


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", group_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, k, phrase, f) of all phrases of 1 to ``max_words`` words that occur at
    least ``min_count`` times in their group, and (lang, n), the words of each group."""
    group, text = F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")), F.col(f"`{text_col}`")
    texts = docs.select(group.alias("grp"), text.alias("text"))
    words = texts.mapInArrow(_count_words, "grp STRING, word STRING, n LONG").groupBy("grp", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    totals = words.groupBy(F.col("grp").alias("lang")).agg(F.sum("n").alias("n"))
    first, count = _numbered(words.where(F.col("n") >= min_count), "frequent-1")
    spoken = first.select(F.col("id").alias("word"), F.col("word").alias("last"))
    named = first.select("id", F.col("grp").alias("lang"), F.lit(1).alias("k"), F.col("word").alias("phrase"), F.col("n").alias("f"))
    levels = [named]
    relation = _relate_words(texts, first, count) if count and max_words > 1 else None
    for k in range(2, max_words + 1):
        if relation is None:
            break
        pairs = relation.select("places", "words", "at", "items").mapInArrow(_count_pairs(k), "prefix LONG, word LONG, n LONG")
        # Tasks have combined what they can: a second map of their pairs in the JVM would hold most of them again.
        pairs = pairs.repartition("prefix", "word")
        pairs = pairs.groupBy("prefix", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        frequent, count = _numbered(pairs, f"frequent-{k}")
        if not count:
            break
        before = named.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"))
        longer = frequent.join(before, "prefix").join(spoken, "word")
        named = longer.select("id", "lang", F.lit(k).alias("k"), F.concat_ws(" ", "head", "last").alias("phrase"), F.col("n").alias("f"))
        named = stored(named, f"phrases-{k}")
        levels.append(named)
        relation = _extend(relation, frequent, count, k) if k < max_words else None
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    return stored(phrases.drop("id"), "phrases"), totals


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    group_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's ``top`` collocations."""
    phrases, totals = frequent_phrases(docs, text_col, group_col, min_count, max_words)
    long = phrases.where("k > 1")
    # A phrase inside a longer one of any length is inside one that is longer by a word, as frequent or more.
    one = F.col("phrase")
    within = long.where("k > 2").select(
        "lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)"))).alias("phrase"), "f"
    )
    within = within.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = long.join(within, ["lang", "phrase"], "left").where("most IS NULL OR most < f").drop("most")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    parts = kept.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut"))
    parts = parts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)"))
    parts = parts.withColumn("right", F.substring(one, F.length("left") + 2, F.length(one)))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    parts = parts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(F.broadcast(totals) if _few(totals) else totals, "lang")
    weakest = F.min(F.struct(F.expr(SCORE).alias("score"), "cut", "l", "r")).alias("w")
    scored = parts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _few(groups: DataFrame) -> bool:
    return len(groups.head(10_001)) <= 10_000
