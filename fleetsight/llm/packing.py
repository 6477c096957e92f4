"""Packing of token sequences with neighbours found by lexical retrieval.

A document is the ids of its text under a byte-level BPE vocabulary (``tokenizers`` file), then ``END_ID``.
Its full windows of ``WINDOW`` ids are sequences of their own; what is left over, its tail, shares a
window with tails like it.

Method:

1. Tokens. Texts are cut before single spaces between words, where the vocabulary's pre-tokens always
   end; each distinct segment is encoded once per task by the library, and ids are gathered. With the
   same vocabulary at hand as ``ranks`` for ``tiktoken``, segments of Latin-1 characters are encoded by
   that, which gives the same ids in a third of the time.
2. Statistics. Term counts per tail, the number of tails and their length come from all documents; terms
   are ids, so that what is broadcast is at most as large as the vocabulary.
3. Index. Tails are dealt by hash into shards of about ``SHARD_TAILS``, each with an inverted index of BM25
   weights, so a task holds one bounded index. The longest unused tail is a seed; its neighbours are the
   unused tails of its shard in order of their score for the seed's terms. They fill the window greedily.
   The one that does not fit is cut; its rest is the next seed. So every window is full but the last of a
   shard, which is cut into sequences whose lengths are powers of two: no padding at all.

Defined cases: a null text is empty, a document of ``END_ID`` alone; repeated rows are documents of their
own; ids may repeat or be null; special strings inside a text are handled as the library does by
itself; a text of any length is encoded in stretches; columns that are not asked for are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.llm.store import stored
from fleetsight.llm.text import text_slices

WINDOW, END_ID = 1024, 0
SHARD_TAILS = 1_024
K1, B = 1.2, 0.75
# Text handled at once.
SLICE_BYTES = 8_000_000

_WHITE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def segment_starts(data: np.ndarray) -> np.ndarray:
    """Places of spaces between two characters that are no white space: a pre-token begins there. Near
    characters beyond ASCII that could be white space a place may be left out."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    good = (before > 0x20) & (after > 0x20) & ~_WHITE_LEADS[after]
    beyond = before >= 0x80
    near = (data[np.maximum(at - 2, 0)] == 0xC2) | _WHITE_LEADS[data[np.maximum(at - 3, 0)]]
    return at[good & ~(beyond & near)]


def _inner(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Segments that begin and end as those between two of ``segment_starts`` do."""
    padded = np.concatenate([np.zeros(3, dtype=np.uint8), data, np.zeros(2, dtype=np.uint8)])
    head, tail = bounds[:-1] + 3, bounds[1:] + 2
    after, before = padded[head + 1], padded[tail]
    near = (padded[tail - 1] == 0xC2) | _WHITE_LEADS[padded[tail - 2]]
    good = (padded[head] == 0x20) & (after > 0x20) & ~_WHITE_LEADS[after] & (before > 0x20)
    return good & (tail > head) & ~((before >= 0x80) & near)


class ByteBPE:
    """A byte-level vocabulary file of ``tokenizers``, and perhaps the same vocabulary as a file of ranks
    with its pattern. Loaded where it is used; only paths travel."""

    def __init__(self, path: str, ranks: tuple[str, str] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.size = self.model.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        special = [t["content"] for t in made.get("added_tokens", [])]
        # Else whole texts are encoded.
        self.separable = (
            cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not made.get("normalizer")
            and not any(" " in t for t in special)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in made.get("added_tokens", []))
        )
        self.special = [t.encode() for t in special]
        self.ranked = None
        if ranks is not None and self.separable:
            import tiktoken

            with open(ranks[0], "rb") as f:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=merges, special_tokens={})
            self.lengths = np.zeros(max(merges.values()) + 1, dtype=np.int64)
            self.lengths[list(merges.values())] = [len(token) for token in merges]

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some segments, and where each one's begin and how many they are. Segments that begin
        and end as those inside a text do stand side by side in one call, and are told apart by the bytes
        that each id stands for."""
        n = len(bounds) - 1
        begin, size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        parts: list[np.ndarray] = []
        done, held = np.zeros(n, dtype=bool), 0
        if self.ranked is not None:
            latin = np.add.reduceat(data >= 0xC4, bounds[:-1], dtype=np.int64) == 0
            whole = data.tobytes()
            if any(x in whole for x in self.special):
                cells = zip(bounds[:-1].tolist(), bounds[1:].tolist())
                latin &= [not any(x in whole[a:b] for x in self.special) for a, b in cells]
            side = latin & _inner(data, bounds)
            ids = self._ranked(data[np.repeat(side, np.diff(bounds))].tobytes())
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.diff(bounds)[side])) + 1
            size[side] = np.diff(ends, prepend=0)
            begin[side] = ends - size[side]
            parts.append(ids)
            held, done = len(ids), side
            for i in np.flatnonzero(latin & ~side).tolist():
                ids = self._ranked(whole[bounds[i] : bounds[i + 1]])
                begin[i], size[i] = held, len(ids)
                parts.append(ids)
                held += len(ids)
            done = latin
        rest = np.flatnonzero(~done).tolist()
        texts = [data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in rest]
        for i, e in zip(rest, self.model.encode_batch(texts, add_special_tokens=False)):
            begin[i], size[i] = held, len(e.ids)
            parts.append(np.array(e.ids, dtype=np.uint32))
            held += len(e.ids)
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32), begin, size

    def _ranked(self, text: bytes) -> np.ndarray:
        return self.ranked.encode_to_numpy(text.decode(), disallowed_special=())

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        inner = segment_starts(data) if self.separable else heads[:0]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[heads] = begins[inner] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data)).astype(np.int64)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        encoded = column.dictionary_encode()
        which = encoded.indices.to_numpy(zero_copy_only=False)
        distinct = encoded.dictionary
        _, places, held = distinct.buffers()
        limits = np.frombuffer(places, dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        flat, begin, sizes = self._encode(np.frombuffer(held, dtype=np.uint8)[limits[0] : limits[-1]], limits - limits[0])
        counts = sizes[which]
        before = np.cumsum(counts) - counts
        out = flat[np.repeat(begin[which] - before, counts) + np.arange(int(counts.sum()))]
        # Segments of a text stand together.
        totals = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.searchsorted(starts, offsets)
        return out, np.diff(totals[cuts])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, and their counts. One long text is cut at segments."""
        if len(offsets) != 2 or len(data) <= 2 * SLICE_BYTES or not self.separable:
            return self._segments(data, offsets)
        parts, begin = [], 0
        while begin < len(data):
            size = SLICE_BYTES
            while True:
                end = min(begin + size, len(data))
                cuts = segment_starts(data[begin:end])
                if end == len(data) or len(cuts):
                    break
                size *= 2
            if end < len(data):
                end = begin + int(cuts[-1])
            parts.append(self._segments(data[begin:end], np.array([0, end - begin]))[0])
            begin = end
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


# One document: the CRC-32 of each full window and the ids of its tail. Rows of counts have no ``tail``.
_CUT = "doc_tokens LONG, crcs ARRAY<LONG>, tail BINARY, terms ARRAY<INT>, counts ARRAY<LONG>"


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _cutter(path: str, ranks: tuple[str, str] | None, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, uid, text) -> rows of documents, and at the end the task's term counts."""
        model = ByteBPE(path, ranks)
        width = _width(model.size)
        counts = np.zeros(model.size, dtype=np.int64)
        place, order = np.zeros(model.size, dtype=np.int64), np.arange(WINDOW)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2), SLICE_BYTES):
                ids, sizes = model.encode(data, offsets)
                ends = np.cumsum(sizes)
                tokens, crcs, tails = [], [], []
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    whole = np.append(ids[a:b], np.uint32(END_ID))
                    full = len(whole) // WINDOW * WINDOW
                    tokens.append(len(whole))
                    crcs.append([crc(whole[i : i + WINDOW]) for i in range(0, full, WINDOW)])
                    tail = whole[full:]
                    place[tail] = order[: len(tail)]  # each distinct id keeps one place
                    counts[tail[place[tail] == order[: len(tail)]]] += 1
                    tails.append(tail.astype(width).tobytes())
                n = len(tokens)
                rows = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).cast(schema.field(0).type),
                        rows.column(1),
                        pa.array(tokens, pa.int64()),
                        pa.array(crcs, pa.list_(pa.int64())),
                        pa.array(tails, pa.binary()),
                        pa.nulls(n, pa.list_(pa.int32())),
                        pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )
        terms = np.flatnonzero(counts)
        nothing = [pa.nulls(1, f.type) for f in list(schema)[:5]]
        yield pa.RecordBatch.from_arrays(
            [*nothing, pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([counts[terms].tolist()], pa.list_(pa.int64()))], schema=schema
        )

    return cut


class Index:
    """BM25 weights of some tails, by term."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        sizes = np.array([len(t) for t in tails], dtype=np.int64)
        owner = np.repeat(np.arange(self.n), sizes)
        keys, tf = np.unique(np.concatenate(tails).astype(np.int64) * self.n + owner, return_counts=True)
        terms, self.docs = np.divmod(keys, self.n)
        norm = K1 * (1 - B + B * sizes[self.docs] / mean)
        self.weights = idf[terms] * tf * (K1 + 1) / (tf + norm)
        self.begin = np.searchsorted(terms, np.arange(len(idf) + 1))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Score of every tail for the distinct terms of ``ids``."""
        terms = np.flatnonzero(np.bincount(ids, minlength=1))
        begin, size = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def fill(tails: list[np.ndarray], idf: np.ndarray, mean: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start, length). Every tail lies in them exactly once."""
    index = Index(tails, idf, mean)
    sizes = np.array([len(t) for t in tails])
    unused = sizes > 0
    seeds = np.argsort(-sizes, kind="stable").tolist()
    out: list[list[tuple[int, int, int]]] = []
    rest: tuple[int, int] | None = None
    turn = 0
    while True:
        if rest is None:
            while turn < len(seeds) and not unused[seeds[turn]]:
                turn += 1
            if turn == len(seeds):
                break
            rest = seeds[turn], 0
            unused[seeds[turn]] = False
        seed, start = rest
        rest = None
        now = [(seed, start, int(sizes[seed]) - start)]
        room = WINDOW - now[0][2]
        if room and unused.any():
            score = index.scores(tails[seed][start:])
            score[~unused] = -1.0
            for other in np.argsort(-score, kind="stable")[: int(unused.sum())].tolist():
                unused[other] = False
                size = int(sizes[other])
                now.append((other, 0, min(size, room)))
                if size > room:
                    rest = other, room
                room -= min(size, room)
                if not room:
                    break
        out.append(now)
    return out[:-1] + _powers(out[-1]) if out else out


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two, the longest first."""
    left = sum(length for *_, length in pieces)
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for tail, start, length in pieces:
        while length:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                out.append([])
            used = min(room, length)
            out[-1].append((tail, start, used))
            start, length, room = start + used, length - used, room - used
    return out


_PIECE = "start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, offset LONG"


def _packer(sent, width: str, schema: pa.Schema):
    def shard(table: pa.Table) -> pa.RecordBatch:
        idf, mean = sent.value
        number = table.column("shard")[0].as_py() << 32
        ids, tokens, crcs = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs"))
        tails = [np.frombuffer(t.as_buffer(), dtype=width) for t in table.column("tail")]
        rows: list[tuple] = []
        for doc, n, sums in zip(ids, tokens, crcs):
            for i, c in enumerate(sums):
                rows.append((doc, i * WINDOW, WINDOW, c, n, number, 0))
                number += 1
        for pieces in fill(tails, idf, mean):
            offset = 0
            for tail, start, length in pieces:
                own = crc(tails[tail][start : start + length])
                rows.append((ids[tail], len(crcs[tail]) * WINDOW + start, length, own, tokens[tail], number, offset))
                offset += length
            number += 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents sorted by shard -> pieces; one shard is held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cuts = np.append(np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(shards))
            begin = 0
            for end in cuts.tolist():
                if end > begin:
                    some = batch.slice(begin, end - begin)
                    if held and held[-1].column("shard")[0] != some.column("shard")[0]:
                        yield shard(pa.Table.from_batches(held))
                        held = []
                    held.append(some)
                    begin = end
        if held:
            yield shard(pa.Table.from_batches(held))

    return pack


def pack_documents(
    docs: DataFrame, model_path: str, ranks: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). ``start``
    and ``length`` are the piece's span in its document's ids, ``offset`` its place in the sequence.
    ``ranks``: path of the same vocabulary as ranks, and the pattern of its pre-tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").alias("text"))
    cut = T.StructType([*rows.schema.fields[:1], T.StructField("uid", T.LongType()), *T.StructType.fromDDL(_CUT).fields])
    found = stored(rows.mapInArrow(_cutter(model_path, ranks, to_arrow_schema(cut)), cut), "tails")
    tails = found.where("tail IS NOT NULL")

    model = ByteBPE(model_path)
    width = _width(model.size)
    n, size = tails.agg(F.count(F.lit(1)), F.sum(F.octet_length("tail"))).first()
    counts = found.where("terms IS NOT NULL").select(F.inline(F.arrays_zip("terms", "counts")))
    df = np.zeros(model.size)
    for term, c in counts.groupBy("terms").agg(F.sum("counts")).collect():  # at most the vocabulary
        df[term] = c
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((idf, (size or 0) / max(n, 1) / np.dtype(width).itemsize))

    shards = max(1, -(-n // SHARD_TAILS))
    dealt = tails.select("doc_id", "uid", "doc_tokens", "crcs", "tail", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "uid")
    piece = T.StructType([cut.fields[0], *T.StructType.fromDDL(_PIECE).fields])
    return dealt.mapInArrow(_packer(sent, width, to_arrow_schema(piece)), piece)
