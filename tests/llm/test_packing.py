"""Packing: an exact round trip of ids, full windows, and neighbours against plain BM25."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, texts
from tokenizers import Tokenizer

from fleetsight.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def odd_texts():
    spaces = [" ", "  ", "\t", "\n", " ", " ", "　", "\u0085", "\x1c", "​", " \n "]
    marks = ["a", "Don't", "it's", "1234", "é", "中文", "かな", "ß—", "…", "<|endoftext|>", "x<|endoftext|>y", "😀", "à", "́", "Â", "ã", "_", "'s", "﻿"]
    rng = random.Random(6)
    return ["".join(rng.choice(marks) + rng.choice(spaces if rng.random() < 0.5 else [" "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_ids_equal_the_library(library, monkeypatch, ranks):
    latin = [" ".join(chr(a) + chr(b) for b in range(32, 256, 3)) for a in range(1, 256)]
    some = [t or "" for t in texts(3)] + odd_texts() + latin
    model = packing.ByteBPE(PATH, ranks)
    assert model.separable
    data = np.frombuffer("".join(some).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in some])
    ids, counts = model.encode(data, offsets)
    want = [ids_of(library, t)[:-1] for t in some]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)  # a long text in stretches
    long = "".join(some)
    one = np.frombuffer(long.encode(), dtype=np.uint8)
    assert model.encode(one, np.array([0, len(one)]))[0].tolist() == ids_of(library, long)[:-1]


def packed(spark, rows):
    got = packing.pack_documents(documents(spark, rows), PATH, RANKS)
    assert got.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    return got.collect()


def check_cover(library, rows, got):
    """Each document's ids lie in exactly one piece each; sequences have no gap and at most 1024 ids."""
    whole = Counter()
    for i, t in rows:
        whole[i, tuple(ids_of(library, t))] += 1
    spans = {}
    for r in got:
        spans.setdefault((r.doc_id, r.doc_tokens), Counter())[r.start, r.length, r.ids_crc32] += 1
    want = {}
    for (i, ids), n in whole.items():
        want.setdefault((i, len(ids)), []).extend([ids] * n)
    assert set(spans) == set(want)
    for key, copies in want.items():
        taken = np.zeros(key[1], dtype=int)
        for (start, length, own), n in spans[key].items():
            assert any(zlib.crc32(np.array(c[start : start + length], dtype="<u4").tobytes()) == own for c in copies)
            taken[start : start + length] += n
        assert (taken == len(copies)).all()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        size = own[-1].offset + own[-1].length
        assert size <= packing.WINDOW and size & (size - 1) == 0  # no padding
    return sequences


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TAILS", 20)
    rows = list(enumerate(texts(1) + odd_texts()[:60])) + [(500, "long text " * 3000), (None, "no id"), (7, "again"), (7, "again")]
    sequences = check_cover(library, rows, packed(spark, rows))
    short = sum(1 for own in sequences.values() if own[-1].offset + own[-1].length < packing.WINDOW)
    shards = len({s >> 32 for s in sequences})
    assert 1 < shards <= -(-len(rows) // 20) and short <= 10 * shards


def test_few_rows(spark, library):
    assert packed(spark, []) == []
    rows = [(1, None), (2, ""), (3, "a")]
    check_cover(library, rows, packed(spark, rows))


def test_neighbours_are_the_best_unused():
    rng = random.Random(2)
    topics = [[rng.randint(1, 900) for _ in range(40)] for _ in range(8)]
    tails = [np.array([rng.choice(topics[i % 8]) for _ in range(rng.randint(1, 700))] + [0], dtype=np.uint16) for i in range(120)]
    tails[5] = np.zeros(0, dtype=np.uint16)
    df = Counter(t for tail in tails for t in set(tail.tolist()))
    n, mean = len(tails), sum(map(len, tails)) / len(tails)
    idf = np.array([math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) for t in range(1000)])

    def bm25(query, tail):
        tf = Counter(tail.tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(tail) / mean)
        return sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(query.tolist()) if t in tf)

    sequences = packing.fill(tails, idf, mean)
    unused = {i for i, t in enumerate(tails) if len(t)}
    at = dict.fromkeys(unused, 0)
    same = 0
    for pieces in sequences:
        if sum(p[2] for p in pieces) < packing.WINDOW:
            break
        seed, start, length = pieces[0]
        assert start == at[seed] and length == len(tails[seed]) - start
        unused.discard(seed)
        query = tails[seed][start:]
        for other, begin, size in pieces[1:]:
            assert begin == 0 and other in unused
            best = max(bm25(query, tails[i]) for i in unused)
            assert bm25(query, tails[other]) == pytest.approx(best)
            same += other % 8 == seed % 8
            unused.discard(other)
            at[other] = size
    assert same > 10
    covered = Counter()
    for pieces in sequences:
        for tail, start, length in pieces:
            covered.update((tail, k) for k in range(start, start + length))
    assert covered == Counter((i, k) for i, t in enumerate(tails) for k in range(len(t)))


def test_segments_share_calls(library, monkeypatch):
    """Segments cost no call of the encoder each, and their ids are still the library's."""
    some = [t or "" for t in texts(4)] + odd_texts()
    model = packing.ByteBPE(PATH, RANKS)
    calls = Counter()
    for name in ("encode_ordinary", "encode_to_numpy"):
        whole = getattr(model.ranked, name)
        monkeypatch.setattr(model.ranked, name, lambda *a, _whole=whole, **kw: calls.update(n=1) or _whole(*a, **kw))
    data = np.frombuffer("".join(some).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in some])
    ids, _ = model.encode(data, offsets)
    assert ids.tolist() == [x for t in some for x in ids_of(library, t)[:-1]]
    # heads and ends of texts may stand alone; what lies inside them does not
    assert calls["n"] <= 2 * len(some) + 1 < len(np.unique("".join(some).split(" ")))
