"""Mixing, sharding, WARC archives and chat pairs."""

import gzip
import hashlib
import io
import math
import random

import pytest
from helpers import documents, texts
from pyspark.sql import functions as F

from fleetsight.llm import chat_pairs, mixing, sharding, warc
from fleetsight.llm.store import fresh_path


def targets(sizes, share=1.5, weights=(3, 1, 2), cap=2.0):
    """Shared out by rounds: what a full source leaves goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    given, left, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if given[s] + left * weight[s] / total >= cap * sizes[s]]
        if not full:
            for s in open_:
                given[s] += left * weight[s] / total
            break
        for s in full:
            left -= cap * sizes[s] - given[s]
            given[s] = cap * sizes[s]
            open_.discard(s)
    return given


@pytest.mark.parametrize("rows_per_range", [5_000, 7])
def test_mixing(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", rows_per_range)
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(900, None), (901, "")]
    docs = documents(spark, rows)
    docs = docs.withColumn("source", F.when(F.col("doc_id") < 150, "big").otherwise(F.col("source")))
    got = mixing.mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    assert sorted(mixing.mix_sources(docs.repartition(3)).collect(), key=str) == sorted(got, key=str)
    repeats = mixing.repeat_taken(mixing.mix_sources(docs))
    for s, n in repeats.groupBy("source").agg(F.sum(mixing.word_count("text"))).collect():
        assert abs(n - want[s]) <= 45


def test_mixing_of_odd_rows(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect()] == [(0, 0.0, 0)] * 2
    same = documents(spark, [(3, "a b c d e")] * 10 + [(4, "a")] + [(None, "a b")] * 2)
    got = mixing.mix_sources(same)
    assert got.count() == 13 and got.agg(F.sum("taken")).first()[0] <= 1.5 * 55
    assert {r.taken for r in got.where("doc_id = 3").collect()} == {got.where("doc_id = 3").first().taken}


def shards(rows, limit):
    """Split recursively on the next bit."""
    out = {}

    def split(some, prefix):
        if sum(n for _, n, _ in some) <= limit or len({h for *_, h in some}) < 2:
            for i, *_ in some:
                out[i] = prefix
            return
        bit = 1 << (sharding.BITS - 1 - len(prefix))
        split([r for r in some if not r[2] & bit], prefix + "0")
        split([r for r in some if r[2] & bit], prefix + "1")

    if rows:
        split(rows, "")
    return out


@pytest.mark.parametrize("limit", [400, 3_000, 10**9])
def test_sharding(spark, limit):
    docs = documents(spark)
    got = sharding.shard_rows(docs, limit=limit).collect()
    hashed = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), sharding.row_hash([F.col(c) for c in docs.columns if c != "part"]))
    want = shards([tuple(r) for r in hashed.collect()], limit)
    assert {r.doc_id: r.shard for r in got} == want
    held = {}
    for r in got:
        held[r.shard, r.part] = held.get((r.shard, r.part), 0) + r.n_bytes
    for r in got:
        assert r.shard_bytes == held[r.shard, r.part] and (r.shard_bytes <= limit or r.shard_bytes == r.n_bytes)


def test_equal_rows_overflow_in_parts(spark):
    docs = documents(spark, [(1, "x" * 100)] * 25 + [(2, "y" * 10)] * 4 + [(3, None)] * 3)
    got = sharding.shard_rows(docs, limit=300).collect()
    assert len(got) == 32
    held = {}
    for r in got:
        held.setdefault((r.shard, r.part), []).append(r.n_bytes)
    assert all(sum(v) <= 300 for v in held.values()) and sum(100 in v for v in held.values()) == 9
    ids = sharding.shard_ids(docs, limit=300)
    assert ids.columns == ["doc_id", "n_bytes", "shard", "part", "shard_bytes"] and ids.count() == 32
    assert sharding.shard_rows(documents(spark, [])).count() == 0


PAGES = "page_id LONG, url STRING, html STRING, digest STRING, n STRING"


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}?q=é x\r\nWARC-Type: revisit", t, "d", "n") for i, t in enumerate(texts(4))]
    rows += [(200 + i, None, rows[i % 7][2], "d", "n") for i in range(20)] + [(3, "u", rows[3][2], "d", "n"), (None, "u", rows[5][2], "d", "n")]
    rows += [(300, "u", "WARC/1.1\r\n\r\n" * 50, "d", "n"), (301, "u", "ü" * 3_000_000, "d", "n"), (None, "u", "only without id", "d", "n")]
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    manifest = warc.write_archives(pages, fresh_path(spark, "warc"), archive_bytes=4_000)
    assert manifest.count() > 4
    got = warc.read_archives(manifest).collect()
    low = {}
    for i, _, h, *_ in rows:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    want = []
    for i, _, h, *_ in rows:
        data, first = (h or "").encode(), low.get(h or "")
        again = first is not None and (i is None or i > first)
        want.append((str(i), len(data), warc.base32_sha1(data), "revisit" if again else "response", str(first if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all(r.verified for r in got)
    # Each offset begins a gzip member that holds one record.
    row = max(got, key=lambda r: r.offset)
    with open(row.archive.removeprefix("file:"), "rb") as f:
        f.seek(row.offset)
        assert gzip.GzipFile(fileobj=f).readline() == b"WARC/1.1\r\n"
    large = warc.write_archives(pages, fresh_path(spark, "warc"), min_revisit_bytes=1_000)
    types = {(r.page_id, r.payload_bytes): r.record_type for r in warc.read_archives(large).collect()}
    assert all(t == "response" for (_, n), t in types.items() if n < 1_000)
    none = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(none, fresh_path(spark, "warc"))).count() == 0


def test_damaged_archives_are_noticed():
    packed = [warc.member(warc.record(i, "u", b"payload %d" % i, None, False)) for i in range(3)]
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(b"".join(packed)))] == [0, 1, 2]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(b"".join(packed)[:-9])))
    changed = warc.record(0, "u", b"payload 0", None, False).replace(b"payload 0", b"payload 1")
    assert [r["verified"] for r in warc.read_records(io.BytesIO(warc.member(changed)))] == [False]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.member(b"no record\r\n\r\n"))))


TURNS = "id LONG, turn LONG, role STRING, text STRING, n INT, prompt STRING"


def test_preference_pairs(spark):
    chosen = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "good <|end|> one"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "x"), (4, 1, None, None), (4, None, "user", "last"),
        (6, 0, "user", "q"), (6, 0, "user", "q"), (None, 0, "user", "none"),
    ]
    rejected = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"), (1, 3, "user", "é"),
        (2, 0, "user", "A"), (3, 0, "user", "x"), (4, 1, None, None), (5, 0, "assistant", "alone"), (6, 0, "user", "q"),
    ]

    def frame(rows):
        return chat_pairs.conversations(spark.createDataFrame([(*r, 1, "p") for r in rows], TURNS).repartition(3), "id")

    got = {r.id: r for r in chat_pairs.format_preferences(frame(chosen), frame(rejected)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    one = got[1]
    assert one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 2
    assert one.chosen == "<|assistant|>\ngood < |end| > one<|end|>\n"
    assert one.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\né<|end|>\n"
    for text, mask in ((one.chosen, one.chosen_mask), (one.rejected, one.rejected_mask)):
        assert len(text) == len(mask)
    assert "".join(c for c, m in zip(one.rejected, one.rejected_mask) if m == "1") == "bad<|end|>"
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].rejected_mask.count("1")) == (0, "", 0)
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")
    assert got[4].prompt == "<|unknown|>\n<|end|>\n" and got[4].chosen == "<|user|>\nlast<|end|>\n" and got[4].rejected == ""
    assert (got[5].n_prompt_turns, got[5].chosen, got[5].rejected) == (0, "", "<|assistant|>\nalone<|end|>\n")
    assert got[6].n_prompt_turns == 1 and got[6].chosen == "<|user|>\nq<|end|>\n"
    assert chat_pairs.format_preferences(frame([]), frame([])).count() == 0
    assert hashlib.sha256(one.prompt.encode()).hexdigest()
