"""Jaccard join, repeated strings and nearest neighbours against brute force."""

import hashlib
import random
import re
import string
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, texts

from fleetsight.llm import jaccard_join, nearest, suffix_dedup
from fleetsight.llm.components import connected_components
from fleetsight.llm.text import word_hashes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and 100 * len(a & b) >= 80 * len(a | b):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # frequent lists, blocks and probes of a few members
        monkeypatch.setattr(jaccard_join, "HOT", 3)
        monkeypatch.setattr(jaccard_join, "REPORTED", 1)
        monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    rows = list(enumerate(texts()))
    got = jaccard_join.link_documents(documents(spark, rows)).collect()
    want = components(rows)
    assert sorted(tuple(r) for r in got) == sorted((i, len(shingles(t)), want[i]) for i, t in rows)


def test_jaccard_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (None, None), (9, "")]
    got = jaccard_join.link_documents(documents(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == sorted(
        [("None", 2, "None"), ("7", 2, "3"), ("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("9", 0, "9")]
    )
    assert jaccard_join.link_documents(documents(spark, [])).count() == 0


def near_copies(count, seed=11):
    """Copies of one text of 60 words with a few words changed in each: most pairs are near 0.8."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(count):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(0, 2)):
            words[at] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_copies_are_not_listed_in_pairs(spark, monkeypatch):
    made = {}
    stored = jaccard_join.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    found = []
    for count in (200, 400, 800):
        made.clear()
        rows = near_copies(count)
        got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(documents(spark, rows)).collect()}
        if count == 200:
            assert got == components(rows)
        found.append(made.get("unsettled", 0) + made.get("more-links", 0))
        assert made.get("more-links", 0) < count
    assert all(n <= 60 * c for n, c in zip(found, (200, 400, 800)))  # a row per tile and member at most


def test_verification_reports_what_connects():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    rows = []
    for i in range(60):
        s = base.copy()
        s[rng.choice(100, rng.integers(0, 14), replace=False)] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        rows.append((i, jaccard_join.distinct(s)))
    want = {i: i for i, _ in rows}
    for (i, a), (j, b) in combinations(rows, 2):
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            low, high = sorted((want[i], want[j]))
            want = {k: low if v == high else v for k, v in want.items()}
    columns = {
        "cluster": [0] * 60, "block": [0] * 60, "node": [i for i, _ in rows], "component": [i for i, _ in rows],
        "shingles": [s.tobytes() for _, s in rows], "probe": [True] * 60,
    }
    table = pa.table({**columns, "shingles": pa.array(columns["shingles"], pa.binary())})
    # Visitors are members as well, which come first.
    table = pa.concat_tables([table.set_column(5, "probe", pa.array([False] * 60)), table])
    links = [x for b in jaccard_join._verify_groups(iter(table.to_batches())) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert len(links) == 60 - len(set(want.values()))
    got = {i: i for i, _ in rows}
    for i, j in links:
        low, high = sorted((got[i], got[j]))
        got = {k: low if v == high else v for k, v in got.items()}
    assert got == want


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_unlike_long_words_stay_apart(spark, n):
    a, b = thue_morse(n)
    rows = [(1, f"{a} x y z v"), (2, f"{b} x y z v"), (3, f"{a} x y z v w")]
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(documents(spark, rows)).collect()}
    assert got == components(rows) and got[2] == 2


def test_word_hashes_differ():
    words = [bytes(w) for n in range(1, 4) for w in combinations(range(97, 123), n)] + [b"a" * n for n in range(1, 300)]
    words += [t.encode() for n in (64, 65, 1024) for t in thue_morse(n)]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    hashes = word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    for i in (0, 5, len(words) - 1):  # the same wherever the word stands
        own = np.frombuffer(words[i], dtype=np.uint8)
        assert word_hashes(own, np.array([0]), np.array([len(own)]))[0] == hashes[i]


def test_bitmap_bounds_the_overlap():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for n, m in ((5, 6), (100, 120), (900, 1000), (3000, 2500)):
        a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
        bound = jaccard_join.overlap_bound(len(a), jaccard_join.bitmap(a), len(b), jaccard_join.bitmap(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(200, 7000), (5, 5)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a LONG, b LONG")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}, 7000: 100}
    assert connected_components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def cut(rows, length=suffix_dedup.LENGTH):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            g = data[k : k + length]
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("combined", [8_000_000, 3_000])
def test_repeated_spans(spark, monkeypatch, combined):
    monkeypatch.setattr(suffix_dedup, "COMBINED_BYTES", combined)
    rows = list(enumerate(texts(2)))
    # Long overlaps that start and end anywhere, and runs of one character.
    long = rows[3][1] + rows[4][1]
    rows += [(100 + i, long[i * 3 : 90 + i * 11] + "#" * i * 9 + long[5 * i : 60 + 5 * i]) for i in range(12)]
    got = [(r[0], r[1], r[2], [tuple(s) for s in r[3]], r[4]) for r in suffix_dedup.repeated_spans(documents(spark, rows)).collect()]
    assert sorted(got) == cut(rows)


def test_triggers_of_long_texts(monkeypatch):
    grams = np.random.default_rng(1).integers(0, 50, 700).astype(np.uint64) << np.uint64(40)
    width = suffix_dedup.WIDTH
    want = [i + int(np.argmin(grams[i : i + width])) for i in range(len(grams) - width + 1)]
    for bits in (20, 7):
        monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", bits)
        assert suffix_dedup._triggers(grams).tolist() == want
    assert suffix_dedup._triggers(grams[: width - 1]).tolist() == []


def test_repeated_spans_of_odd_rows(spark):
    long = "abcdefghij" * 8
    rows = [(4, long), (4, long), (None, long), (2, None), (1, "")]
    got = sorted((str(r[0]), r[1], r[2]) for r in suffix_dedup.repeated_spans(documents(spark, rows)).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("4", 80, 0), ("4", 80, 0), ("None", 80, 80)]
    assert suffix_dedup.repeated_spans(documents(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id LONG, embedding ARRAY<FLOAT>, score STRING, list STRING")


def neighbours(rows, k):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None}
    out = {}
    for q in (i for i in good if i % 20 == 0):
        found = sorted(((-(good[q] @ good[i]), i) for i in good if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def test_nearest_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 24))
    rows = [(i, (centers[i % 12] * rng.uniform(0.5, 2) + 0.4 * rng.standard_normal(24)).tolist()) for i in range(3000)]
    frame = vectors(spark, rows)
    got = nearest.nearest_neighbours(frame, frame.where("vec_id % 20 = 0")).collect()
    want = neighbours(rows, 20)
    assert len(got) == 20 * len(want)
    hits = sum((r.vec_id in dict(want[r.query_id])) for r in got)
    assert hits / len(got) >= 0.9
    near = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(abs(r.score - near[r.query_id] @ near[r.vec_id]) < 1e-9 for r in got)


def test_nearest_neighbours_of_odd_rows(spark):
    same = [(i, [1.0, 0.0]) for i in range(60)]
    odd = [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [float("nan"), 1.0]), (None, [1.0, 1.0]), (280, [1.0]), (3, [1.0, 0.0])]
    frame = vectors(spark, same + odd)
    got = nearest.nearest_neighbours(frame, frame.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {q: [i for i in range(21) if i != q][:20] for q in (0, 20, 40)}
    few = vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])])
    assert [tuple(r) for r in nearest.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 3.0), (0, 2, 2, -1.0)]
    none = vectors(spark, [])
    assert nearest.nearest_neighbours(none, none).count() == 0


def test_abandoned_candidates_are_far():
    rng = np.random.default_rng(8)
    q, x = rng.standard_normal((20, 65)).astype(np.float32), rng.standard_normal((400, 65)).astype(np.float32)
    exact = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    limit = np.sort(exact, axis=1)[:, 20]
    row, at = nearest.surviving(q, x, limit)
    kept = set(zip(row.tolist(), at.tolist()))
    want = set(zip(*np.nonzero(exact <= limit[:, None] * 0.9999)))
    assert len(want & kept) >= 0.98 * len(want) and len(kept) < 0.1 * exact.size
