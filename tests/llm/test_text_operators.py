"""Token counts, decontamination and the quality classifier."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from helpers import documents, prose, texts

from fleetsight.llm import decontamination, quality, token_counts
from fleetsight.llm.text import sliding_min

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
MODEL = "piece_bpe_32k.model"


def test_sliding_min():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 99, 40)
    for width in (1, 2, 3, 7, 8, 31, 32, 40, 41):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_token_counts(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    monkeypatch.setattr(token_counts, "CACHE", 50)
    monkeypatch.setattr(token_counts, "COUNTED", 300)
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 400)  # long texts in stretches
    monkeypatch.setattr(token_counts, "CALL_CHARS", 500)
    path = public_tokenizers.path(MODEL)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "▁", "a", "the", "é", "ß", "中", "😀", "\t", "<s>", "</s>", "\x00", "The", "ing", ".", "\r\n", "   "]
    rows = texts(3) + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = token_counts.count_tokens(documents(spark, list(enumerate(rows))).withColumnRenamed("n_hit", "n_tokens"), path).collect()
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), len(plain.encode(t or ""))) for i, t in enumerate(rows)]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items, window=decontamination.WINDOW):
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(window, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("rows_sent", [decontamination.BROADCAST_ROWS, 0])
def test_contamination(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows_sent)
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 30, 60]))) for i in range(20)]
    items += [(50, items[5][1]), (51, None), (52, ""), (53, "one two three"), (7, prose(rng, 20))]
    rows = list(enumerate(texts(5)))
    for i in range(30):
        w = items[i % 20][1].split(" ")
        at = rng.randint(0, max(0, len(w) - 5))
        rows.append((100 + i, f"{prose(rng, 15)} {' '.join(w[at : at + rng.randint(5, 40)])}; {prose(rng, 5)} {items[(i * 7) % 20][1].upper()}"))
    rows += [(None, rows[-1][1]), rows[-2], rows[-2]]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = decontamination.find_contamination(documents(spark, rows), benchmark).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in got) == contamination(rows, items)


@pytest.mark.parametrize("rows_sent", [decontamination.BROADCAST_ROWS, 0])
def test_contamination_by_nameless_items_and_long_words(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows_sent)
    unlike = {n: ["".join(x[i.bit_count() % 2] for i in range(n)) for x in ("ab", "ba")] for n in (1024, 4096)}
    items = [(None, "one two three four"), (1, f"x {unlike[1024][0]} y z"), (2, f"x {unlike[4096][0]} y z")]
    rows = [(1, "0 one two three four 5"), (2, f"x {unlike[1024][1]} y z"), (3, f"x {unlike[4096][1]} y z"), (4, f"x {unlike[4096][0]} y z")]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = decontamination.find_contamination(documents(spark, rows), benchmark).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.item_ids) for r in got) == [(1, 4, 1, []), (2, 0, 0, []), (3, 0, 0, []), (4, 4, 1, ["2"])]


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert [r.n_hit for r in decontamination.find_contamination(documents(spark, [(1, "a b c")]), none).collect()] == [0]
    assert decontamination.find_contamination(documents(spark, []), none).count() == 0


def junk(rng, i):
    text = prose(rng, rng.randint(30, 200))
    return [text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), " ".join([text[:20]] * 60)][i % 3]


def test_quality_held_out_accuracy(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        good = i % 5 > 0
        rows.append((i, prose(rng, rng.randint(30, 250)) if good else junk(rng, i // 5)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (5, rows[5][1]), (None, rows[6][1])]
    labels += [(None, 1, 0), (3, None, 0)]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT")
    model = quality.train_quality(docs, known.where(~quality.held_out()))
    assert 0 < len(model.rules) < 80
    got = quality.score_quality(docs, model).withColumn("held_out", quality.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in labels if i is not None and q is not None}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) >= 0.97
    # The column expression scores as the rules do.
    stats = quality.with_statistics(docs.select("doc_id", "text"), "text").collect()
    x = np.array([[r[f"__s_{n}"] for n in quality.NAMES] for r in stats])
    raw = model.intercept + sum(w * quality.holds(rule, x) for rule, w in model.rules)
    by_text = {(r.doc_id, r.text): r.score for r in got}
    assert np.allclose([by_text[(r.doc_id, r.text)] for r in stats], 1 / (1 + np.exp(-raw)))
    kept = quality.keep_good(docs.drop("score"), model)
    assert kept.count() == sum(r.predicted for r in got) and kept.columns == docs.drop("score").columns


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id LONG, quality INT")
    docs = documents(spark, [(1, "a"), (2, None)])
    assert {r.score for r in quality.score_quality(docs, quality.train_quality(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id LONG, quality INT")
    assert {round(r.score, 6) for r in quality.score_quality(docs, quality.train_quality(docs, ones)).collect()} == {0.75}
    assert quality.score_quality(documents(spark, []), quality.train_quality(docs, ones)).count() == 0


def test_items_hash_is_of_sorted_ids(spark):
    benchmark = spark.createDataFrame([(10, "alpha beta"), (9, "beta gamma")], "item_id LONG, text STRING")
    row = decontamination.find_contamination(documents(spark, [(1, "x Alpha, BETA gamma")]), benchmark).first()
    assert (row.n_words, row.n_hit, row.item_ids) == (4, 3, ["10", "9"])
    assert hashlib.sha256(b"10,9").hexdigest() == hashlib.sha256(",".join(row.item_ids).encode()).hexdigest()
