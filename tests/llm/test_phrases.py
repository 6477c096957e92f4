"""Collocations against counting every phrase."""

import pathlib
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from fleetsight.llm import phrases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id LONG, text STRING, lang STRING, phrase STRING, n STRING, word STRING, grp STRING, id STRING"


def mined(rows, least, longest=5, top=2000):
    totals, counts = Counter(), {}
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", "x", "x", "x", "x") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)


def talk(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "中文", "Don't", "a-b"]
    stock = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(stock) if rng.random() < 0.4 else rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 30))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for p in parts)
        rows.append((text, rng.choice(["en", "de", None])))
    rows += [(None, "en"), ("", None), (" .,; \n", "xx"), ("go " * 500, "fr"), ("end", "en")]
    return rows


@pytest.mark.parametrize("broadcast", [phrases.BROADCAST, 0])
@pytest.mark.parametrize("least", [2, 9])
def test_against_counting(spark, monkeypatch, broadcast, least):
    monkeypatch.setattr(phrases, "BROADCAST", broadcast)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 200)
    monkeypatch.setattr(phrases, "COMBINED", 60)
    rows = talk()
    got = phrases.mine_phrases(frame(spark, rows), min_count=least)
    assert got.columns == "lang rank phrase a l r n score".split()
    want = mined(rows, least)
    assert len(want) > 20
    assert sorted(map(tuple, got.collect())) == want


def test_top_and_length(spark):
    rows = talk(2)
    got = phrases.mine_phrases(frame(spark, rows), min_count=3, max_words=3, top=4)
    assert sorted(map(tuple, got.collect())) == mined(rows, 3, 3, 4)


def test_nothing_frequent(spark):
    assert phrases.mine_phrases(frame(spark, [])).count() == 0
    assert phrases.mine_phrases(frame(spark, [("a b c", "en"), (None, None)])).count() == 0


def test_stretches_of_a_long_text(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 30)
    rng = random.Random(4)
    text = "".join(rng.choice(["ab ", "c. ", "déf ", "x" * 90 + " "]) for _ in range(300))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    parts = list(phrases._stretches(data, np.array([0, len(data)])))
    assert len(parts) > 20 and b"".join(d.tobytes() for d, _ in parts) == text.encode()
    assert all(d[-1] == ord(".") for d, _ in parts[:-1])
    said = [w for d, o in parts for w in phrases.words_and_places(d, o)[0].to_pylist()]
    assert said == re.findall("[^ .]+", text)


def test_exact_products(spark):
    """Counts whose product passes 64 bits."""
    a, n, left, right = 3_000_000_007, 9_000_000_000_011, 4_000_000_009, 5_000_000_029
    frame = spark.createDataFrame([(a, n, left, right)], "a LONG, n LONG, l LONG, r LONG")
    assert frame.selectExpr(f"{phrases.SCORE} AS s").first().s == 1000 * a * n // (left * right)


def test_relations_lie_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A task decodes one row group at a time, so it must not hold all blocks of the task before it."""
    paths = []
    monkeypatch.setattr(phrases, "fresh_path", lambda _, name: paths.append(str(tmp_path / name)) or paths[-1])
    rows = [("a b c d e f g h i j k, " * 12, f"l{i}") for i in range(61)]  # a block each
    phrases.mine_phrases(frame(spark, rows).coalesce(1), min_count=2)
    files = [f for p in paths if "setm" in p for f in pathlib.Path(p).glob("*.parquet")]
    groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) > 60 and max(groups) <= phrases.ROW_GROUP_BLOCKS


@pytest.mark.parametrize("shift", [0, 1 << 33])
def test_pairs_are_combined(monkeypatch, shift):
    """Numbers that fit 32 bits and larger ones give the same counts, whatever is combined at once."""
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 9, 400) + shift for _ in range(3)]
    block = [("en", phrases._gaps(np.arange(400)), phrases._ids(w), None, None) for w in words]
    want = Counter((int(a), int(b)) for w in words for a, b in zip(w[:-1], w[1:]))
    for most in (50, 10_000):
        monkeypatch.setattr(phrases, "COMBINED_PAIRS", most)
        got = Counter()
        for batch in phrases._count_pairs(2)(iter([phrases._relation(block).select(phrases._NAMES[1:])])):
            for r in batch.to_pylist():
                got[r["prefix"], r["word"]] += r["n"]
        assert got == want
