"""Benchmark decontamination by winnowed fingerprints.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII.
A benchmark item's windows are its runs of ``window`` consecutive words; an item with fewer words,
but not none, is one window. A document word inside any occurrence of a window is hit.

Method: both sides keep, of every ``window`` words, the smallest hash of ``k`` consecutive words
(winnowing), so each shared span of ``window`` words has a fingerprint that both sides kept. Document
fingerprints are joined with those of the benchmark; each hit is extended over all windows around it,
which are then looked up. Items shorter than a window have no such guarantee; their exact word runs
are looked up at every position. Windows are held against each other by two independent hashes of
their words, 128 bits in all.

Tasks make the benchmark's fingerprints and windows, as rows of a table. Up to ``BROADCAST_ROWS`` of them,
counted, are broadcast and looked up where the documents are. Beyond that both look-ups are shuffled
joins, and what was found comes back to the documents.

Defined cases: a null or empty text has no words and is not contaminated; an item without an id hits
like any other and counts as one item, but has no name to be listed; items without words are ignored;
equal items all count; repeated documents each get their row; ``item_ids`` are sorted as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.llm.store import stored
from fleetsight.llm.text import ALNUM, Words, distinct, gram_hashes, sliding_min, text_slices, word_hashes

WINDOW = 10
K = 5
# Fingerprints and windows of the benchmark that are sent to every task: some 30 bytes each.
BROADCAST_ROWS = 1_000_000

_FOUND = "n_words LONG, n_hit LONG, n_items LONG, items ARRAY<STRING>"
# A kept fingerprint of the benchmark (length 0), or a window of an item.
_INDEX = "length INT, hash LONG, check LONG, item STRING"


def winnow(grams: np.ndarray, firsts: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of the smallest gram (the last, of equal ones) in every ``window`` words of a text."""
    width = window - k + 1
    low = sliding_min(grams, width)
    if not len(low):
        return np.zeros(0, dtype=np.int64)
    at = np.zeros(len(low), dtype=np.int64)
    for j in range(width):
        np.copyto(at, np.arange(j, j + len(low)), where=grams[j : j + len(low)] == low)
    inside = np.zeros(len(low), dtype=bool)
    for a, b in zip(firsts[:-1], firsts[1:]):
        inside[a : max(a, b - window + 1)] = True
    return np.unique(at[inside])


def _batch(names: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))


def _indexer(window: int, k: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, text) -> fingerprints and windows."""
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                second = word_hashes(words.folded, words.starts, words.ends, second=True)
                grams = words.grams(k)
                parts = [(0, h := distinct(grams[winnow(grams, words.firsts, k, window)]), np.zeros(len(h), dtype=np.uint64), None)]
                for i, (a, b) in enumerate(zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist())):
                    n = min(window, b - a)
                    if n:
                        item = batch.column(0)[first + i].as_py()
                        parts.append((n, gram_hashes(words.hashes[a:b], n), gram_hashes(second[a:b], n), item))
                sizes = [len(h) for _, h, *_ in parts]
                lengths = pa.array(np.repeat([n for n, *_ in parts], sizes), pa.int32())
                items = pa.array([p[3] for p in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
                hashes, checks = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
                yield _batch("length hash check item", lengths, _signed(hashes), _signed(checks), items)

    return index


def _arranged(table: pa.Table, window: int, k: int) -> dict:
    """The index as sorted arrays: the fingerprints, and for each length of window its hashes with the
    entries ``begin[i]:begin[i + 1]`` of their second hashes and items."""
    length, hashes, checks = (table.column(c).to_numpy() for c in ("length", "hash", "check"))
    hashes, checks = hashes.view(np.uint64), checks.view(np.uint64)
    items = table.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
    owners = items.indices.to_numpy()
    windows = {}
    for n in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == n)
        own = own[np.lexsort((checks[own], hashes[own]))]
        keys, begin = np.unique(hashes[own], return_index=True)
        windows[n] = keys, np.append(begin, len(own)), checks[own], owners[own]
    return {"window": window, "k": k, "prints": distinct(hashes[length == 0]), "windows": windows, "ids": items.dictionary.to_pylist()}


def _lookup(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in ``sorted_values``, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def _hits(words: Words, index: dict) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Hit flag of every word, and the items found in each text."""
    n = len(words.hashes)
    delta = np.zeros(n + 1, dtype=np.int64)
    items: dict[int, set[int]] = {}

    def record(starts: np.ndarray, length: int) -> None:
        text_of = np.searchsorted(words.firsts, starts, side="right") - 1
        inside = starts + length <= words.firsts[text_of + 1]
        starts, text_of = starts[inside], text_of[inside]
        hashes, begin, checks, owners = index["windows"][length]
        which = _lookup(hashes, gram_hashes_at(words.hashes, starts, length))
        starts, text_of, which = starts[which >= 0], text_of[which >= 0], which[which >= 0]
        # Every entry of the hash, by its second hash.
        size = begin[which + 1] - begin[which]
        row = np.repeat(np.arange(len(which)), size)
        entry = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(len(row))
        same = checks[entry] == second_hashes(words, starts, length)[row]
        row, entry = row[same], entry[same]
        good = np.unique(starts[row])
        np.add.at(delta, good, 1)
        np.add.at(delta, good + length, -1)
        pairs = np.unique(np.stack([text_of[row], owners[entry]], axis=1), axis=0)
        for text, owner in pairs.tolist():
            items.setdefault(text, set()).add(owner)

    for length in index["windows"]:
        if length == index["window"]:
            grams = words.grams(index["k"])
            kept = winnow(grams, words.firsts, index["k"], index["window"])
            hit = kept[_lookup(index["prints"], grams[kept]) >= 0]
            around = hit[:, None] - np.arange(index["window"] - index["k"] + 1)[None, :]
            record(np.unique(around[around >= 0]), length)
        elif n >= length:
            grams = gram_hashes(words.hashes, length)
            record(np.flatnonzero(_lookup(index["windows"][length][0], grams) >= 0), length)
    return np.cumsum(delta[:-1]) > 0, items


def gram_hashes_at(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """gram_hashes(hashes, k)[starts], for few starts; those must have k words."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return gram_hashes(hashes[starts[:, None] + np.arange(k)[None, :]].ravel(), k)[::k]


def second_hashes(words: Words, starts: np.ndarray, k: int) -> np.ndarray:
    """Second hashes of the windows of ``k`` words that begin at ``starts``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    at = (starts[:, None] + np.arange(k)[None, :]).ravel()
    return gram_hashes(word_hashes(words.folded, words.starts[at], words.ends[at], second=True), k)[::k]


def _scanner(sent):
    """Looks up everything in the index that was sent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            counts, hits, n_items, names = [], [], [], []
            for _, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                words = Words(data, offsets, ALNUM)
                flags, items = _hits(words, index)
                counts.extend(words.counts.tolist())
                for i in range(words.n):
                    found = [index["ids"][x] for x in items.get(i, ())]
                    hits.append(int(flags[words.firsts[i] : words.firsts[i + 1]].sum()) if found else 0)
                    n_items.append(len(found))
                    names.append(sorted(x for x in found if x is not None))
            numbers = [pa.array(c, pa.int64()) for c in (counts, hits, n_items)]
            columns = [*batch.columns[:-1], *numbers, pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "n_hit", "n_items", "items"])

    return scan


def _prints(window: int, k: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, text) -> kept fingerprints (uid, hash, at)."""
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for first, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                grams = words.grams(k)
                at = winnow(grams, words.firsts, k, window)
                text = np.searchsorted(words.firsts, at, side="right") - 1
                yield _batch("uid hash at", pa.array(uid[first + text]), _signed(grams[at]), pa.array(at - words.firsts[text]))

    return prints


def _windows(window: int, k: int, short: list[int]):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, text, hits) -> the windows around hits and the runs of the short lengths at every place:
        (uid, at, length, hash, check)."""
        for batch in batches:
            uid, hits = batch.column(0).to_numpy(), batch.column(2)
            for first, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                for i, (a, b) in enumerate(zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist())):
                    found = hits[first + i].as_py() or []
                    around = np.unique(np.array(found, dtype=np.int64)[:, None] - np.arange(window - k + 1)[None, :])
                    starts = {window: around[(around >= 0) & (around <= b - a - window)]}
                    starts |= {n: np.arange(max(0, b - a - n + 1)) for n in short}
                    for n, own in starts.items():
                        if len(own):
                            hashes, checks = gram_hashes_at(words.hashes, own + a, n), second_hashes(words, own + a, n)
                            same = pa.array(np.full(len(own), uid[first + i]))
                            yield _batch("uid at length hash check", same, pa.array(own), pa.array(np.full(len(own), n, dtype=np.int32)), _signed(hashes), _signed(checks))

    return windows


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., hit windows, text) -> (..., n_words, n_hit)."""
    for batch in batches:
        spans, counts, hits = batch.column(batch.num_columns - 2), [], []
        for first, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
            words = Words(data, offsets, ALNUM)
            for i, n in enumerate(words.counts.tolist()):
                hit = np.zeros(n, dtype=bool)
                for s in spans[first + i].as_py() or ():
                    hit[s["at"] : s["at"] + s["length"]] = True
                counts.append(n)
                hits.append(int(hit.sum()))
        columns = [*batch.columns[:-2], pa.array(counts, pa.int64()), pa.array(hits, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "n_words", "n_hit"])


def _joined(source: DataFrame, index: DataFrame, window: int, k: int) -> DataFrame:
    """The look-ups as shuffled joins. ``source``: the columns to keep, then the text."""
    docs = stored(source.withColumn("__uid", F.monotonically_increasing_id()), "documents")
    texts = docs.select("__uid", "__text")
    kept = index.where("length = 0").select("hash").distinct()
    hits = texts.mapInArrow(_prints(window, k), "uid LONG, hash LONG, at LONG").join(kept, "hash")
    hits = hits.groupBy(F.col("uid").alias("__uid")).agg(F.collect_list("at").alias("hits"))
    windows = index.where("length > 0").distinct()
    short = [r.length for r in windows.where(F.col("length") < window).select("length").distinct().collect()]
    asked = texts.join(hits, "__uid", "left" if short else "inner").select("__uid", "__text", "hits")
    asked = asked.mapInArrow(_windows(window, k, short), "uid LONG, at LONG, length INT, hash LONG, check LONG")
    found = stored(asked.join(windows, ["length", "hash", "check"]).select("uid", "at", "length", "item").distinct(), "found")
    spans = found.groupBy(F.col("uid").alias("__uid")).agg(
        F.collect_set(F.struct("at", "length")).alias("__spans"), F.collect_set(F.struct("item")).alias("__items")
    )
    keep = source.columns[:-1]
    both = docs.join(spans, "__uid", "left").select(*[F.col(f"`{c}`") for c in keep], "__items", "__spans", "__text")
    schema = T.StructType([*both.schema.fields[:-2], *T.StructType.fromDDL("n_words LONG, n_hit LONG").fields])
    names = F.sort_array(F.filter(F.transform("__items", lambda x: x["item"]), lambda x: x.isNotNull()))
    counted = both.mapInArrow(_covered, schema)
    return counted.withColumn("n_items", F.coalesce(F.size("__items"), F.lit(0)).cast("long")).withColumn("items", names)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = K,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), plus ``n_words``, ``n_hit``, ``n_items`` and
    ``item_ids`` (of the items found). Columns of ``docs`` named like the added ones are replaced.
    """
    if not 0 < k <= window:
        raise ValueError("k must lie between 1 and window")
    gone = {"n_words", "n_hit", "item_ids", "n_items", "items", *(() if keep_text else (text_col,))}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in gone]
    source = docs.select(*keep, F.col(f"`{text_col}`").alias("__text"))
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    index = stored(items.mapInArrow(_indexer(window, k), _INDEX), "benchmark")
    if index.count() <= BROADCAST_ROWS:
        sent = docs.sparkSession.sparkContext.broadcast(_arranged(index.toArrow(), window, k))
        schema = T.StructType([*source.schema.fields[:-1], *T.StructType.fromDDL(_FOUND).fields])
        found = source.mapInArrow(_scanner(sent), schema)
    else:
        found = _joined(source, index, window, k)
    return found.select(*keep, "n_words", "n_hit", "n_items", F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"))
