"""Exact removal of repeated byte strings, by prefix-free parsing.

Texts are UTF-8 bytes; matches never cross documents. Every byte goes that is covered by a string of
``LENGTH`` bytes which also starts in a document with a smaller id. Overlaps count, and strings are
judged on the input.

Method:

1. Parsing. A rolling hash over ``GRAM`` bytes sets triggers: the smallest hash of a string's grams (the
   first, of equal ones) is its trigger. Consecutive strings with the same trigger make a phrase.
   Phrases overlap by ``LENGTH - 1`` bytes, so that every string lies inside exactly one, and equal
   strings always have equal triggers. A document is its list of phrases.
2. Dictionary. Equal phrases meet by the hash of their trigger, and one entry with the smallest id is
   left of them. Each task first combines the phrases of its own documents. A phrase known from a
   smaller id is covered whole: this settles copies, however many, without looking into them.
3. Suffixes. Only where one trigger has several different phrases, their texts are fetched (one text per
   dictionary entry), and the suffixes of at least ``LENGTH`` bytes are sorted by their first
   ``LENGTH`` bytes; equal ones get the smallest id. So the sort is over the dictionary, not the corpus.
4. What was found goes back to the documents by phrase; each is parsed again and cut.

Hashes have 64 bits; within one trigger phrases are told apart by 48 more.

Defined cases: null and empty texts have 0 bytes and lose none; texts shorter than ``LENGTH`` lose
none; rows with the same id are not smaller than each other, so each keeps what only they have; rows
without an id come after all others and keep their text whole among themselves; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.store import shuffle_partitions, stored
from fleetsight.llm.text import mix, powers, prefix_hashes, sliding_min, span_hashes, text_slices

LENGTH = 50
GRAM = 19
WIDTH = LENGTH - GRAM + 1
# Text whose phrases a task combines before it sends them, and at most so many documents.
COMBINED_BYTES, COMBINED_DOCS = 6_000_000, 60_000
_LOW48 = np.uint64((1 << 48) - 1)
_LAST = (1 << 63) - 1


# Bits of a key that hold a gram's place. Their number is fixed, so that equal strings choose equal
# triggers wherever they stand; longer texts are looked at in overlapping stretches.
_PLACE_BITS = 20


def _triggers(grams: np.ndarray) -> np.ndarray:
    """For every ``WIDTH`` consecutive grams the place of the smallest, the first of equal ones."""
    place = np.uint64((1 << _PLACE_BITS) - 1)
    out = [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(grams) - WIDTH + 1, (1 << _PLACE_BITS) - WIDTH + 1):
        some = grams[a : a + (1 << _PLACE_BITS)]
        keys = (some & ~place) | np.arange(len(some), dtype=np.uint64)
        out.append((sliding_min(keys, WIDTH) & place).astype(np.int64) + a)
    return np.concatenate(out)


class Phrases:
    """The phrases of a slice of texts: ``doc`` (row in the slice), ``start`` and ``end`` (bytes in the
    slice), ``trigger`` and ``content`` hashes. ``first`` is where the first of its strings starts,
    which is ``start``; the last starts at ``end - LENGTH``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        none = np.zeros(0, dtype=np.int64)
        self.doc = self.start = self.end = none
        self.trigger = self.content = none.astype(np.uint64)
        lengths = np.diff(offsets)
        if len(data) < LENGTH or not (lengths >= LENGTH).any():
            return
        prefix = prefix_hashes(data)
        n = len(data) - GRAM + 1
        grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix), inverse=True)[:n])
        at = _triggers(grams)
        # Starts of strings inside one text.
        owner = np.repeat(np.arange(len(lengths)), lengths)
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        long = lengths >= LENGTH
        np.add.at(edge, offsets[:-1][long], 1)
        np.add.at(edge, offsets[1:][long] - LENGTH + 1, -1)
        valid = np.cumsum(edge[:-1]) > 0
        starts = np.flatnonzero(valid)
        triggers = at[starts]
        docs = owner[starts]
        change = np.flatnonzero((triggers[1:] != triggers[:-1]) | (docs[1:] != docs[:-1])) + 1
        begin, last = np.append(0, change), np.append(change, len(starts)) - 1
        self.doc = docs[begin]
        self.start = starts[begin]
        self.end = starts[last] + LENGTH
        self.trigger = grams[triggers[begin]]
        self.content = span_hashes(prefix, self.start, self.end) & _LOW48


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


# A parcel holds the phrases of some documents that fall into one range of trigger hashes.
_PARCEL = "part INT, triggers BINARY, contents BINARY, owners BINARY, docs BINARY"


def _parse(parts: int):
    """(doc_id, text) -> parcels. A phrase that several of the documents have goes out once, with their
    smallest id; the others learn that it is covered from rows with part = -1 (docs = one id, contents =
    its covered phrases)."""

    def send(docs: np.ndarray, owner: np.ndarray, trigger: np.ndarray, content: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs[owner], content, trigger))
        owner, trigger, content = owner[order], trigger[order], content[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1])
        lowest = docs[owner[np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))]]
        known = docs[owner] > lowest
        rows: list[tuple] = []
        if known.any():
            key = np.stack([docs[owner[known]].view(np.uint64), trigger[known] ^ content[known]])
            by = np.argsort(key[0], kind="stable")
            ids, phrases = key[0][by].view(np.int64), key[1][by]
            cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(ids)).tolist()):
                rows.append((-1, b"", np.unique(phrases[a:b]).tobytes(), b"", ids[a : a + 1].tobytes()))
        owner, trigger, content = owner[new], trigger[new], content[new]
        part = (trigger % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        owner, trigger, content, part = owner[by], trigger[by], content[by], part[by]
        cut = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(part)).tolist()):
            if b > a:
                used, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(part[a]), _pack(trigger[a:b], 8), _pack(content[a:b], 6), _pack(local.astype(np.uint64), 2), docs[used].tobytes()))
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names="part triggers contents owners docs".split(),
            )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_docs = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_docs, size
            if held:
                yield from send(np.concatenate(docs), *(np.concatenate(c) for c in zip(*held)))
            docs.clear()
            held.clear()
            n_docs = size = 0

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch.column(1)):
                for a in range(0, len(offsets) - 1, COMBINED_DOCS):
                    some = offsets[a : a + COMBINED_DOCS + 1]
                    if n_docs + len(some) - 1 > COMBINED_DOCS or size + int(some[-1] - some[0]) > COMBINED_BYTES:
                        yield from flush()
                    p = Phrases(data[some[0] : some[-1]], some - some[0])
                    docs.append(ids[first + a : first + a + len(some) - 1])
                    held.append((p.doc + n_docs, p.trigger, p.content))
                    n_docs += len(some) - 1
                    size += int(some[-1] - some[0])
        yield from flush()

    return parse


# found: a document's phrases that are covered whole. wanted: dictionary entries to be looked into.
_LOOKED = "doc_id LONG, kind INT, phrases BINARY"
FOUND, WANTED = 0, 1


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All parcels of some ranges -> what is known of each document from whole phrases."""
    trigger: list[np.ndarray] = []
    content: list[np.ndarray] = []
    doc: list[np.ndarray] = []

    def rows(ids: np.ndarray, kind: int, phrases: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(ids, kind="stable")
        ids, phrases = ids[by], phrases[by]
        cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        bounds = np.append(np.append(0, cut), len(ids))
        blobs = [phrases[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]
        heads = ids[bounds[:-1]] if len(ids) else ids
        return pa.RecordBatch.from_arrays(
            [pa.array(heads, pa.int64()), pa.array(np.full(len(heads), kind), pa.int32()), pa.array(blobs, pa.binary())],
            names="doc_id kind phrases".split(),
        )

    for batch in batches:
        for part, t, c, o, d in zip(*(batch.column(i).to_pylist() for i in range(5))):
            ids = np.frombuffer(d, dtype=np.int64)
            if part < 0:
                yield rows(np.repeat(ids, len(c) // 8), FOUND, np.frombuffer(c, dtype=np.uint64))
            else:
                trigger.append(_unpack(t, 8))
                content.append(_unpack(c, 6))
                doc.append(ids[_unpack(o, 2).astype(np.int64)])
    if not trigger:
        return
    t, c, d = np.concatenate(trigger), np.concatenate(content), np.concatenate(doc)
    trigger.clear(), content.clear(), doc.clear()
    order = np.lexsort((d, c, t))
    t, c, d = t[order], c[order], d[order]
    new_trigger = np.ones(len(t), dtype=bool)
    new_trigger[1:] = t[1:] != t[:-1]
    new = new_trigger.copy()
    new[1:] |= c[1:] != c[:-1]
    lowest = d[np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))]
    covered = d > lowest
    yield rows(d[covered], FOUND, (t ^ c)[covered])
    # Entries of the dictionary whose trigger has several phrases, of different documents.
    et, ec, ed = t[new], c[new], d[new]
    group = np.cumsum(new_trigger[new]) - 1
    several = (np.bincount(group) > 1)[group]
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    several &= np.maximum.reduceat(ed, firsts)[group] > np.minimum.reduceat(ed, firsts)[group]
    yield rows(ed[several], WANTED, (et ^ ec)[several])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, wanted phrases) -> (trigger, doc_id, phrase, its text)."""
    for batch in batches:
        ids, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        for first, data, offsets in text_slices(batch.column(1)):
            p = Phrases(data, offsets)
            name = p.trigger ^ p.content
            bounds = np.searchsorted(p.doc, np.arange(len(offsets)))
            take = []
            for i in range(len(offsets) - 1):
                want = np.frombuffer(wanted[first + i].as_buffer(), dtype=np.uint64)
                own = name[bounds[i] : bounds[i + 1]]
                distinct, at = np.unique(own, return_index=True)
                take.append(bounds[i] + at[np.isin(distinct, want)])
            at = np.concatenate(take) if take else np.zeros(0, dtype=np.int64)
            texts = [data[a:b].tobytes() for a, b in zip(p.start[at].tolist(), p.end[at].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p.trigger[at].view(np.int64)),
                    pa.array(ids[first + p.doc[at]], pa.int64()),
                    pa.array(name[at].view(np.int64)),
                    pa.array(texts, pa.binary()),
                ],
                names="trigger doc_id phrase bytes".split(),
            )


# Starts of covered strings in a phrase: first and last of each run, relative to the phrase.
_RUNS = "doc_id LONG, phrase LONG, low INT, high INT"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary entries, those of a trigger together -> runs of strings known from smaller ids."""
    held: list[pa.RecordBatch] = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    trigger = table.column("trigger").to_numpy()
    order = np.argsort(trigger, kind="stable")
    doc, phrase = table.column("doc_id").to_numpy(), table.column("phrase").to_numpy()
    texts = table.column("bytes").combine_chunks().cast(pa.large_binary())
    step = 20_000
    cuts = np.flatnonzero(trigger[order][1:] != trigger[order][:-1]) + 1
    begin = 0
    while begin < len(order):
        # Whole triggers, some thousand entries at a time.
        later = cuts[np.searchsorted(cuts, begin + step) :]
        end = int(later[0]) if len(later) else len(order)
        rows = order[begin:end]
        begin = end
        some = texts.take(pa.array(rows))
        bounds = np.frombuffer(some.buffers()[1], dtype=np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        count = np.diff(bounds) - LENGTH + 1
        entry = np.repeat(np.arange(len(rows)), count)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        starts = bounds[:-1][entry] + place
        # Suffixes are sorted by a hash of their first bytes: equal ones stand together.
        prefix = prefix_hashes(data)
        key = span_hashes(prefix, starts, starts + LENGTH)
        ids = doc[rows][entry]
        by = np.lexsort((ids, key))
        new = np.ones(len(by), dtype=bool)
        new[1:] = key[by][1:] != key[by][:-1]
        lowest = np.empty(len(by), dtype=np.int64)
        lowest[by] = ids[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        covered = ids > lowest
        run = np.flatnonzero(covered & np.append(True, ~covered[:-1] | (entry[1:] != entry[:-1])))
        stop = np.flatnonzero(covered & np.append(~covered[1:] | (entry[1:] != entry[:-1]), True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc[rows][entry[run]], pa.int64()),
                pa.array(phrase[rows][entry[run]], pa.int64()),
                pa.array(place[run].astype(np.int32)),
                pa.array(place[stop].astype(np.int32)),
            ],
            names="doc_id phrase low high".split(),
        )


_RESULT = "doc_id LONG, n_bytes LONG, n_removed LONG, spans ARRAY<STRUCT<start: LONG, end: LONG>>, kept_sha256 STRING"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, covered phrases, runs) -> the result per document."""
    for batch in batches:
        found, runs = batch.column(2), batch.column(3)
        sizes, removed, spans, digests = [], [], [], []
        for first, data, offsets in text_slices(batch.column(1)):
            touched = any(found[first + i].is_valid or runs[first + i].is_valid for i in range(len(offsets) - 1))
            p = Phrases(data, offsets) if touched else None
            name = p.trigger ^ p.content if touched else None
            bounds = np.searchsorted(p.doc, np.arange(len(offsets))) if touched else None
            for i in range(len(offsets) - 1):
                begin, end = int(offsets[i]), int(offsets[i + 1])
                edge = np.zeros(end - begin + 1, dtype=np.int32)
                if touched:
                    own = name[bounds[i] : bounds[i + 1]]
                    start = p.start[bounds[i] : bounds[i + 1]] - begin
                    stop = p.end[bounds[i] : bounds[i + 1]] - begin
                    if found[first + i].is_valid:
                        blobs = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in found[first + i].values]
                        full = np.isin(own, np.concatenate(blobs)) if blobs else np.zeros(len(own), dtype=bool)
                        np.add.at(edge, start[full], 1)
                        np.add.at(edge, stop[full], -1)
                    if runs[first + i].is_valid:
                        fields = runs[first + i].values.flatten()
                        phrase, low, high = (np.asarray(f) for f in fields)
                        by = np.argsort(phrase.view(np.uint64), kind="stable")
                        ordered = phrase.view(np.uint64)[by]
                        left, right = np.searchsorted(ordered, own), np.searchsorted(ordered, own, side="right")
                        for k in np.flatnonzero(right > left).tolist():
                            for r in by[left[k] : right[k]].tolist():
                                edge[start[k] + low[r]] += 1
                                edge[start[k] + high[r] + LENGTH] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                text = data[begin:end]
                sizes.append(end - begin)
                removed.append(int(gone.sum()))
                step = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in step.reshape(-1, 2)])
                digests.append(hashlib.sha256(text[~gone].tobytes() if removed[-1] else text.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(digests, pa.string()),
            ],
            names="doc_id n_bytes n_removed spans kept_sha256".split(),
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256), one row per row of ``docs``."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # A row without an id is later than any other.
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text")
    parts = shuffle_partitions(docs.sparkSession)
    # Parcels are dealt by the range they name; what tasks know by themselves goes anywhere.
    parcels = rows.mapInArrow(_parse(parts), _PARCEL)
    place = F.when(F.col("part") < 0, F.pmod(F.xxhash64("docs"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    looked = stored(parcels.repartitionById(parts, place).mapInArrow(_dictionary, _LOOKED), "looked")

    wanted = looked.where(F.col("kind") == WANTED).groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("phrases")), "").alias("w"))
    asked = rows.join(wanted.select("doc_id", F.unhex("w").alias("wanted")), "doc_id")
    entries = asked.mapInArrow(_fetch, "trigger LONG, doc_id LONG, phrase LONG, bytes BINARY")
    runs = stored(entries.repartition(parts, "trigger").mapInArrow(_suffixes, _RUNS), "runs")

    found = looked.where(F.col("kind") == FOUND).groupBy("doc_id").agg(F.collect_list("phrases").alias("found"))
    partly = runs.groupBy("doc_id").agg(F.collect_list(F.struct("phrase", "low", "high")).alias("runs"))
    known = found.join(partly, "doc_id", "full")
    cut = rows.join(known, "doc_id", "left").select("doc_id", "text", "found", "runs").mapInArrow(_cut, _RESULT)
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))
