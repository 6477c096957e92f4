"""Token counts of whole texts under a fixed vocabulary, without a shuffle of pre-tokens.

Method: a two-tier lookup inside each task. Texts are cut into pre-tokens at places that no token of
the vocabulary spans, so a text's count is the sum over its pre-tokens. The driver broadcasts the
counts of the most frequent pre-tokens (tier one, at most ``FREQUENT`` entries). They are found from all
texts: each task counts in a table of bounded size and reports its ``REPORTED`` most frequent ones, so
no pre-token of the corpus is shuffled; what tier one holds only saves work and never changes a count.
What is not in it is encoded once per task and kept in a bounded cache there (tier two).

Where a vocabulary has a token across the cutting places, or the library is not the piece model, whole
texts are encoded instead.

Defined cases: a null or empty text has 0 bytes and 0 tokens; nothing is truncated; repeated rows are
all counted; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.llm.store import stored
from fleetsight.llm.text import text_slices

FREQUENT = 100_000
# Pre-tokens that a task counts at a time and reports at its end.
COUNTED, REPORTED = 200_000, 10_000
# Entries of a task's cache; it is emptied when full.
CACHE = 300_000
# Bytes of text that are cut at once.
SLICE_BYTES = 2_000_000
# Characters encoded in one call of the library.
CALL_CHARS = 1_000_000

_SPACE = "▁"  # how the piece model writes a space


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most ``CALL_CHARS``, or of one longer text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > CALL_CHARS:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if texts[begin:]:
        yield texts[begin:]


class PieceModel:
    """A sentencepiece vocabulary. Loaded where it is used; only its path travels."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # A piece may start with spaces but not hold one further in, nor any line break; and the model
        # must take the text as it is (a few probes). Else pre-tokens would not add up.
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = (
            not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
            and self.model.decode(self.model.encode(" a  b\n\tc ")) in (" a  b\n\tc ", "a  b\n\tc ")
            and len(self.model.encode("  ")) > 0
        )
        # The model puts a space before every text. A word encoded after this line break has none.
        self.lead = len(self.model.encode("\n"))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        out: list[int] = []
        for some in _runs(texts):
            out += [len(ids) for ids in self.model.encode(some, num_threads=1)]
        return out

    def count_pre_tokens(self, tokens: list[str]) -> list[int]:
        """Tokens of pre-tokens as they stand inside a text."""
        bare = ["\n" + t for t in tokens]
        return [n - self.lead for n in self.count(bare)]


def _prepared(column: pa.Array) -> pa.Array:
    """Texts with the space that the model puts before each, and spaces written as such."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), _SPACE, " ")


def _starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: at a line break and behind it, and at the first of a run of spaces. No token
    of the vocabulary reaches across."""
    space, line = data == 0x20, data == 0x0A
    begin = space | line
    begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | (~space[1:] & line[:-1])
    begin[heads] = True
    return np.flatnonzero(begin)


def _cut(column: pa.Array) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    """(first row, rows, pre-tokens, bounds of the rows among them) of runs of texts. A long text comes in
    several stretches, each as a run of one row."""
    for first, data, offsets in text_slices(_prepared(column), SLICE_BYTES):
        begin = 0
        while begin < len(data):
            end = len(data)
            heads = offsets[:-1] if len(offsets) > 2 else np.zeros(1, dtype=np.int64)
            starts = None
            if len(offsets) == 2 and end - begin > 2 * SLICE_BYTES:
                size = SLICE_BYTES
                while begin + size < len(data):
                    starts = _starts(data[begin : begin + size], heads)
                    if len(starts) > 1:
                        end = begin + int(starts[-1])
                        starts = starts[:-1]
                        break
                    starts, size = None, size * 2
            part = np.ascontiguousarray(data[begin:end])
            starts = _starts(part, heads) if starts is None else starts
            bounds = np.append(starts, len(part)).astype(np.int64)
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(part)])
            rows = np.searchsorted(starts, offsets) if len(offsets) > 2 else np.array([0, len(starts)])
            yield first, len(offsets) - 1, tokens.dictionary_encode(), rows
            begin = end


class _Lengths:
    """Tokens of pre-tokens from both tiers; what neither has is encoded in one call."""

    def __init__(self, model: PieceModel, frequent: dict[bytes, int]):
        self.model, self.frequent, self.cache = model, frequent, {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        have = [self.frequent.get(t) for t in tokens]
        have = [self.cache.get(t) if n is None else n for t, n in zip(tokens, have)]
        missing = [i for i, n in enumerate(have) if n is None]
        for i, n in zip(missing, self.model.count_pre_tokens([tokens[i].decode() for i in missing])):
            have[i] = n
            if len(tokens[i]) <= 100:
                self.cache[tokens[i]] = n
        return np.array(have, dtype=np.int64)


def _counter(path: str, sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        lengths = _Lengths(model, sent.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).cast(pa.int64())
            if model.separable:
                totals = np.zeros(batch.num_rows, dtype=np.int64)
                for first, n, tokens, rows in _cut(column):
                    own = lengths.of(tokens.dictionary.to_pylist())[tokens.indices.to_numpy(zero_copy_only=False)]
                    totals[first : first + n] += np.diff(np.concatenate([[0], np.cumsum(own)])[rows])
                totals[sizes.to_numpy(zero_copy_only=False) == 0] = 0
            else:
                totals = np.array(model.count([t or "" for t in column.to_pylist()]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], sizes, pa.array(totals, pa.int64())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    return count


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> the most frequent pre-tokens of a task (token, n). Its table is cut to half when full."""
    held: list[pa.Table] = []

    def merged(limit: int) -> pa.Table:
        total = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
        return total.sort_by([("n", "descending"), ("token", "ascending")]).slice(0, limit)

    for batch in batches:
        for _, _, tokens, _ in _cut(batch.column(0)):
            n = np.bincount(tokens.indices.to_numpy(zero_copy_only=False), minlength=len(tokens.dictionary))
            held.append(pa.table({"token": tokens.dictionary, "n": n}).filter(pa.array(n > 1)))
            if sum(map(len, held)) > COUNTED:
                held[:] = [merged(COUNTED // 2)]
    if held:
        for out in merged(REPORTED).to_batches():
            yield pa.RecordBatch.from_arrays([out.column(0).cast(pa.binary()), out.column(1).cast(pa.int64())], names=["token", "n"])


def frequent_counts(texts: DataFrame, path: str, limit: int = FREQUENT) -> dict[bytes, int]:
    """Token counts of the most frequent pre-tokens of all texts. The least count that keeps to ``limit`` is
    found from counts of counts, so that at most ``limit`` of them come to the driver."""
    model = PieceModel(path)
    if not model.separable:
        return {}
    counts = texts.mapInArrow(_common, "token BINARY, n LONG").groupBy("token").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("level", F.floor(F.log2("n")).cast("int")), "pre-tokens")
    least, total = 1 << 30, 0
    for level, n in sorted(((r.level, r.c) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        total += n
        if total > limit:
            break
        least = level
    common = counts.where(F.col("level") >= least).select("token").toArrow().column(0).to_pylist()
    return dict(zip(common, model.count_pre_tokens([t.decode() for t in common])))


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_bytes`` and ``n_tokens``."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    text = F.col(f"`{text_col}`").alias("__text")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_counts(docs.select(text), model_path))
    source = docs.select(*keep, text)
    schema = T.StructType(
        [*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return source.mapInArrow(_counter(model_path, sent), schema)
