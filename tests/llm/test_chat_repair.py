"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from fleetsight.llm import chat_repair

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, cost STRING, audit STRING, head STRING"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def cheapest(rows):
    """Smallest (cost, audit) and the turns it leaves, by a shortest-path search."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, said = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, said
        if (i, last) in done:
            continue
        done.add((i, last))
        for r in ("user", "assistant"):
            if r[0] in follow[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (*said, f"{r}:")))
        if i < len(rows):
            role, text, lost, short = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, said))
            if not lost:
                if role[:1] in tuple(follow[last]):
                    heapq.heappush(heap, (cost + 3 * short, audit + "K", i + 1, role[0], (*said, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if r[0] in follow[last]:
                        heapq.heappush(heap, (cost + 3 + 3 * short, audit + "R", i + 1, r[0], (*said, f"{r}:{text}")))
    raise AssertionError


def brute(rows):
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:200], hashlib.md5(r[2].encode()).hexdigest()))
        counts, facts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = None if solid and solid[-1] in ".!?" else "truncated"
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else fault
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            facts.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        marks = [r[:1] for r, *_ in facts]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        turns = {t for t, *_ in own if t is not None}
        cost, audit, said = cheapest(facts)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def repaired(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(4)
    got = chat_repair.with_digests(*chat_repair.repair_conversations(turns, chat_repair.damage(turns)))
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    found = got.collect()
    assert len(found) == len({r[0] for r in rows})
    return {r[0]: tuple(r[1:]) for r in found}


def talks(seed, count=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        turn = rng.randint(0, 3)
        for i in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "umpire", "", None])
            text = rng.choice([f"say {rng.randint(0, 3)}.", "Why?", "no end", " \t\n", "", None, "ok! \n", f"é{i}。", "x" * 300 + rng.choice("ab") + "."])
            rows.append((conv, None if rng.random() < 0.08 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("fragment", [2_000, 2])
def test_against_search(spark, monkeypatch, fragment):
    monkeypatch.setattr(chat_repair, "FRAGMENT", fragment)
    rows = talks(1) + [(None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    assert repaired(spark, rows) == brute(rows)


def test_long_conversation_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "FRAGMENT", 50)
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["yes.", f"turn {i}.", "cut", ""])) for i in range(1500)]
    rows += [(8, 0, "user", "same."), *[(8, 5, "assistant", "same.")] * 300, (8, 6, "assistant", "z" * 2_000_000)]
    assert repaired(spark, rows) == brute(rows)


def test_empty_table_and_dropped_conversations(spark):
    gone = [(c, t, "user", "a.") for c in range(400) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone and set(repaired(spark, gone).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, []) == {}


def test_heads_merge_by_top_state():
    heads = chat_repair.Heads(0)
    for initial in "suuaxau":
        heads.row(initial, False, False)
        assert set(heads.best) <= set(chat_repair.STACKS)


def test_repaired_turns_are_sound(spark):
    turns = spark.createDataFrame([(*r, "x", "x", "x") for r in talks(5)], SCHEMA)
    _, rows = chat_repair.repair_conversations(turns, chat_repair.damage(turns))
    said = {}
    for r in sorted(rows.collect()):
        said.setdefault(r.conv_id, []).append((r.place, r.role[:1]))
    assert said
    for own in said.values():
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert re.fullmatch("s?(ua)+", "".join(x for _, x in own))
