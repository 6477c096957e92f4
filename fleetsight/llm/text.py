"""Words, hashes and byte slices of text columns, vectorized over Arrow batches.

Texts are handled as UTF-8 bytes. A null text counts as an empty one. Hashes have 64 bits and are
the same on every machine. Those of words and of word sequences are mixed at every step, so that no
pattern of letters makes unlike words meet; words of up to 8 bytes and one length never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that one numpy pass handles; a longer single text is handled alone.
SLICE_BYTES = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


# Words as runs of bytes that are no ASCII white space.
NOT_SPACE = _table(lambda b: b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
# Words as runs of lower-case letters, digits and bytes beyond ASCII (after lower-casing A-Z).
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or the same of the base's inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        steps = np.full(max(n, SLICE_BYTES + 1), np.uint64(base & _MASK), dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times base^i, modulo 2^64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span [start, end), the same wherever its bytes stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _GOLDEN)


def text_slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most ``size`` bytes, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


# Words beyond this are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of every word, eight bytes at a time; or another one, independent of it."""
    sizes = ends - starts
    out = mix((sizes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D if second else 0)) * _GOLDEN)
    if not len(sizes):
        return out
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    for k in range(0, min(int(sizes.max()), LONG_WORD), 8):
        at = np.flatnonzero(sizes > k) if k else slice(None)
        left = np.minimum(sizes[at] - k, 8).astype(np.uint64)
        value = eights[starts[at] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        out[at] = mix((out[at] ^ value) * np.uint64(_BASE))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(whole[8:] if second else whole[:8], "little")
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])]


class Words:
    """The words of a slice of texts: ``hashes`` in order, ``counts`` per text, ``firsts`` (index of
    each text's first word, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE):
        n = len(offsets) - 1
        folded = LOWER[data]
        mask = inside[folded]
        before = np.zeros(len(mask), dtype=bool)
        before[1:] = mask[:-1]
        after = np.zeros(len(mask), dtype=bool)
        after[:-1] = mask[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        starts = np.flatnonzero(mask & ~before)
        ends = np.flatnonzero(mask & ~after) + 1
        self.folded, self.starts, self.ends = folded, starts, ends
        self.hashes = word_hashes(folded, starts, ends)
        self.firsts = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.firsts)
        self.n = n

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k consecutive words, also across texts: entry i starts at word i."""
        return gram_hashes(self.hashes, k)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        out ^= hashes[j : len(hashes) - k + 1 + j]
        out *= np.uint64(_BASE)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
