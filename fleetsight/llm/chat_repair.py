"""Repair of damaged conversations by a generalised LR parser over the roles' grammar.

A conversation is sound where its roles' first letters read ``(s?(ua)+)?``. Rows have faults (blank,
duplicate, truncated); the cheapest edits that make a conversation sound are found:

    Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows),
    Insert an empty turn of user or assistant 3; a truncated row that stays costs 3 more.

The audit has the first letter of every edit, in order; of equally cheap audits the smallest wins.

Method: the grammar's LR automaton (``ACTIONS``) runs with a graph-structured stack. Heads that an edit
gives the same top state are merged, the smaller (cost, audit) stays: what may follow depends on the top
only, so nothing is lost, and there are four heads at most.

A conversation may be long. Its rows are range-sorted and cut into fragments; a fragment is parsed
from every top state it may meet, and fragments are then strung together by their (cost, audit) from
state to state. So the parsing of one conversation spreads over tasks. Only the chosen audit goes
through one task as a whole, and the repaired rows are streamed past it in order, holding none.

Order of rows: turn (missing first), role, first ``HEAD`` characters of the text, MD5 of the text.

Defined cases: a null role or text is one space, so such a row is blank or has a role outside the
grammar; a null conversation id is an id like any other; equal rows at one turn are duplicates but for
the first; a conversation without rows has cost 0 and an empty audit; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetsight.llm.store import stored

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
HEAD = 200
# Rows of one fragment.
FRAGMENT = 2_000

# The grammar: C -> | H;  H -> H E | O E;  O -> | s;  E -> u a.  Its automaton: a state with a next
# letter ("$" at the end) either shifts to a state, or reduces by (symbol, letters popped).
ACTIONS = {
    (0, "s"): 1,
    (0, "u"): ("O", 0),
    (0, "$"): "accept",
    (1, "u"): ("O", 1),
    (2, "u"): 3,
    (3, "a"): 4,
    (6, "u"): 3,
    (6, "$"): "accept",
}
# States that reduce whatever comes next.
REDUCED = {4: ("E", 2), 5: ("H", 2), 7: ("H", 2)}
GOTO = {(0, "O"): 2, (0, "H"): 6, (2, "E"): 5, (6, "E"): 7}
# A stack for each top state that can stand between two rows: (state, stack below).
ROOT = (0, None)
STACKS = {0: ROOT, 1: (1, ROOT), 3: (3, (2, ROOT)), 6: (6, ROOT)}


def _reduce(stack: tuple, symbol: str, popped: int) -> tuple:
    for _ in range(popped):
        stack = stack[1]
    return GOTO[stack[0], symbol], stack


@cache
def shift(stack: tuple, letter: str) -> tuple | None:
    """The stack after one more letter, or None where the grammar does not take it."""
    while True:
        act = ACTIONS.get((stack[0], letter))
        if act is None or act == "accept":
            return None
        if isinstance(act, int):
            stack = (act, stack)
            break
        stack = _reduce(stack, *act)
    while stack[0] in REDUCED:
        stack = _reduce(stack, *REDUCED[stack[0]])
    return stack


def accepts(top: int) -> bool:
    return ACTIONS.get((top, "$")) == "accept"


class Heads:
    """The heads of the graph-structured stack: by top state the smallest (cost, audit) and its stack."""

    def __init__(self, start: int):
        self.best: dict[int, tuple[int, str, tuple]] = {start: (0, "", STACKS[start])}
        self._insert()

    def _merge(self, into: dict, cost: int, audit: str, stack: tuple | None) -> bool:
        if stack is None:
            return False
        have = into.get(stack[0])
        if have is not None and (have[0], have[1]) <= (cost, audit):
            return False
        into[stack[0]] = (cost, audit, stack)
        return True

    def _insert(self) -> None:
        changed = True
        while changed:
            changed = False
            for cost, audit, stack in sorted(self.best.values(), key=lambda h: h[:2]):
                for letter in ROLES:
                    changed |= self._merge(self.best, cost + INSERT, audit + "I", shift(stack, letter))

    def row(self, initial: str, lost: bool, truncated: bool) -> None:
        """One row: ``lost`` ones can only be deleted."""
        after: dict[int, tuple[int, str, tuple]] = {}
        more = CUT_SHORT if truncated else 0
        for cost, audit, stack in self.best.values():
            self._merge(after, cost + DELETE, audit + "D", stack)
            if lost:
                continue
            self._merge(after, cost + KEEP + more, audit + "K", shift(stack, initial))
            for letter in ROLES:
                self._merge(after, cost + REROLE + more, audit + "R", shift(stack, letter))
        self.best = after
        self._insert()


def damage(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows of (conv_id, turn, role, text, copies), damaged by the CRC-32 of ``conv_id:turn`` modulo 20:
    0 dropped, 1 emptied, 2 without its ends of sentences, 3 twice, 4 said by the user."""
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select(F.col(f"`{id_col}`").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("h <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"),
    )


_KEY = ("turn", "role", "head", "digest")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.left("text", F.lit(HEAD))).withColumn("digest", F.md5("text"))


def _facts(rows: DataFrame) -> DataFrame:
    """What the parser needs of each row, without its text. ``later``: the same role and text stand at an
    earlier turn."""
    end = F.rtrim("text", F.lit(SPACE))
    facts = _keyed(rows).select(
        "conv_id",
        *_KEY,
        "copies",
        F.left("role", F.lit(1)).alias("initial"),
        (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    said = facts.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    # Only what was said at two places or more; repeats within a turn are seen when rows are in order.
    said = said.agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.coalesce(at != F.col("first"), F.lit(False))
    return facts.join(said, same, "left").select(*facts.columns, later.alias("later"))


def _fragment_schema(conv: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("conv_id", conv),
            *T.StructType.fromDDL(
                "turn LONG, role STRING, head STRING, digest STRING, n LONG, blank LONG, duplicate LONG, truncated LONG, illegal LONG, "
                "first_initial STRING, last_initial STRING, low LONG, high LONG, turns LONG, "
                "moves ARRAY<STRUCT<start: INT, top: INT, cost: LONG, audit: STRING>>"
            ).fields,
        ]
    )


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class _Fragment:
    def __init__(self, row: tuple, starts: tuple[int, ...]):
        self.key = row[:5]
        self.heads = {s: Heads(s) for s in starts}
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if self.n:
            self.illegal += not legal(self.last, initial)
        else:
            self.first = initial
        self.last = initial
        self.n += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.blank += blank
        self.duplicate += duplicate and not blank
        truncated = truncated and not blank and not duplicate
        self.truncated += truncated
        for heads in self.heads.values():
            heads.row(initial, blank or duplicate, truncated)

    def out(self) -> tuple:
        moves = [
            {"start": s, "top": top, "cost": cost, "audit": audit}
            for s, heads in self.heads.items()
            for top, (cost, audit, _) in heads.best.items()
        ]
        counts = (self.n, self.blank, self.duplicate, self.truncated, self.illegal)
        return (*self.key, *counts, self.first, self.last, self.low, self.high, self.turns, moves)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _send(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _parser(schema: pa.Schema):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range, in order -> fragments."""
        now: _Fragment | None = None
        first_conversation, before, ready = True, None, []
        for row in _rows(batches):
            conv, turn, role, head, digest, copies, initial, blank, truncated, later = row
            if now is not None and (conv != now.key[0] or now.n >= FRAGMENT):
                first_conversation &= conv == now.key[0]
                ready.append(now.out())
                # A conversation that begins in this range begins with an empty stack.
                now = _Fragment(row, tuple(STACKS) if conv == now.key[0] or first_conversation else (0,))
            elif now is None:
                now = _Fragment(row, tuple(STACKS))
            again = before == row[:5]
            for i in range(copies):
                now.add(turn, initial, blank, later or again or i > 0, truncated)
            before = row[:5]
            if len(ready) >= 200:
                yield _send(schema, ready)
                ready = []
        if now is not None:
            ready.append(now.out())
        if ready:
            yield _send(schema, ready)

    return parse


_REPORT = "gaps LONG, blank LONG, duplicate LONG, truncated LONG, illegal LONG, cost LONG, audit STRING"


class _Chain:
    """Fragments of one conversation, in order."""

    def __init__(self, conv):
        self.conv = conv
        self.best: dict[int, tuple[int, str]] = {0: (0, "")}
        self.counts = [0, 0, 0, 0]
        self.last = self.low = self.high = None
        self.turns = 0

    def add(self, row: tuple) -> None:
        n, *counts, first, last, low, high, turns, moves = row[5:]
        if not n:
            return
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last is not None:
            self.counts[3] += not legal(self.last, first)
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high
        after: dict[int, tuple[int, str]] = {}
        for m in moves:
            if m["start"] in self.best:
                cost, audit = self.best[m["start"]]
                have = after.get(m["top"])
                if have is None or cost + m["cost"] < have[0]:
                    after[m["top"]] = (cost + m["cost"], audit + m["audit"])
                elif cost + m["cost"] == have[0]:
                    after[m["top"]] = min(have, (have[0], audit + m["audit"]))
        self.best = after

    def out(self) -> tuple:
        cost, audit = min(v for top, v in self.best.items() if accepts(top))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts, cost, audit)


def _stringer(schema: pa.Schema):
    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments in order -> a report per conversation."""
        chain: _Chain | None = None
        ready = []
        for row in _rows(batches):
            if chain is None or row[0] != chain.conv:
                if chain is not None:
                    ready.append(chain.out())
                chain = _Chain(row[0])
            chain.add(row)
            if len(ready) >= 1_000:
                yield _send(schema, ready)
                ready = []
        if chain is not None:
            ready.append(chain.out())
        if ready:
            yield _send(schema, ready)

    return string


class _Replay:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.place, self.stack = conv, audit, 0, 0, ROOT

    def _turn(self, edit: str, role: str, text: str, turn: int | None) -> tuple:
        if edit != "K":
            letter = next(x for x in ROLES if shift(self.stack, x) is not None)
            role = ROLES[letter]
        self.stack = shift(self.stack, role[:1])
        self.place += 1
        return (self.conv, self.place, edit, turn, role, text)

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn("I", "", "", None)

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(edit, role, text, turn)


def _replayer(schema: pa.Schema):
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per conversation its audit, then its rows in order -> the repaired turns, in order."""
        now: _Replay | None = None
        for batch in batches:
            ready: list[tuple] = []
            for conv, audit, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if now is not None:
                        ready.extend(now.inserted())
                    now = _Replay(conv, audit)
                else:
                    for _ in range(copies):
                        ready.extend(now.row(turn, role, text))
            if ready:
                yield _send(schema, ready)
        if now is not None:
            ready = list(now.inserted())
            if ready:
                yield _send(schema, ready)

    return replay


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair_conversations(turns: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Repairs ``rows`` (conv_id, turn, role, text, copies), the turns of the conversations in ``turns``.

    Returns (reports, repaired): per conversation of ``turns`` its gaps, counts of first faults and of
    illegal neighbours, the cost and the audit; and the repaired turns (conv_id, place, edit, turn,
    role, text), a conversation's turns in order and in one partition.
    """
    conv = rows.schema["conv_id"].dataType
    facts = _facts(rows)
    dealt = facts.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", *_KEY)
    cut = _fragment_schema(conv)
    fragments = dealt.mapInArrow(_parser(_arrow(cut)), cut)
    # Every conversation has one empty fragment, so that those without rows are reported.
    known = turns.select(F.col(f"`{id_col}`").alias("conv_id")).distinct()
    empty = known.select("conv_id", *(F.lit(0).cast("long").alias(f.name) if f.name == "n" else F.lit(None).cast(f.dataType).alias(f.name) for f in cut.fields[1:]))
    ordered = fragments.unionByName(empty).repartition("conv_id").sortWithinPartitions("conv_id", *_KEY)
    report = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(_REPORT).fields])
    reports = stored(ordered.mapInArrow(_stringer(_arrow(report)), report), "repair-reports")

    shown = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("place LONG, edit STRING, turn LONG, role STRING, text STRING").fields])
    own = _keyed(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), *_KEY, "text", "copies")
    none = {"turn": "long", "role": "string", "head": "string", "digest": "string", "text": "string", "copies": "int"}
    first = reports.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    stream = own.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_KEY)
    repaired = stream.select("conv_id", "audit", "turn", "role", "text", "copies").mapInArrow(_replayer(_arrow(shown)), shown)
    return reports, repaired


def _digester(schema: pa.Schema):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repaired turns in order -> SHA-256 of a conversation's lines ``role:text``, as they stream by."""
        conv = hashed = None
        for batch in batches:
            ready = []
            for this, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if place == 1:
                    if hashed is not None:
                        ready.append((conv, hashed.hexdigest()))
                    conv, hashed = this, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            if ready:
                yield _send(schema, ready)
        if hashed is not None:
            yield _send(schema, [(conv, hashed.hexdigest())])

    return digest


def digest_turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns of ``repair_conversations``."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return repaired.mapInArrow(_digester(_arrow(schema)), schema)


def with_digests(reports: DataFrame, repaired: DataFrame) -> DataFrame:
    """``reports`` plus repaired_sha256; that of no turns is the digest of nothing."""
    digests = digest_turns(repaired).withColumnRenamed("conv_id", "c")
    sha: Column = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return reports.join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(*reports.columns, sha.alias("repaired_sha256"))
