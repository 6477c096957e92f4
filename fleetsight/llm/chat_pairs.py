"""Preference formatting: a chosen and a rejected conversation as one prompt and two completions.

Turns with equal role and text at the start of both conversations are the prompt, rendered once. What
follows is rendered for each side. Each completion comes with a mask of the same length, one
character of '0' or '1' for each of its characters: '1' where the loss counts, which is the text of an
assistant turn with its end mark.

A conversation is one output value, so its turns meet in one row; conversations are spread by id.

Defined cases: turns are ordered by (turn, role, text), a missing turn number last; a null role is
``unknown``, a null text empty; repeated turns stay; a pair found on one side only has an empty
completion on the other; turns without a pair id belong to no conversation and are left out; marks
inside a text or role are broken up by a space, so that no text can open or end a turn; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def _plain(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("< |")), F.lit(CLOSE), F.lit("| >"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(turn["role"]), F.lit(CLOSE + "\n"))


def _body(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    def one(t: Column) -> Column:
        body = F.when(t["role"] == "assistant", "1").otherwise("0")
        return F.concat(F.repeat(F.lit("0"), F.length(_head(t))), F.repeat(body, F.length(_body(t))), F.lit("0"))

    return F.array_join(F.transform(turns, one), "")


def conversations(turns: DataFrame, id_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): one row per conversation, its turns in order."""
    turn = F.col(f"`{turn_col}`")
    item = F.struct(
        turn.isNull().alias("last"),
        turn.alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(f"`{id_col}`").alias("id"), item.alias("t")).where("id IS NOT NULL")
    said = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("id").agg(said.alias("turns"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs of ``conversations`` by id: (id, n_prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask)."""
    none = F.lit(None).cast(chosen.schema["turns"].dataType)
    a, b = F.col("a"), F.col("b")
    pairs = chosen.select("id", F.col("turns").alias("a")).join(rejected.select("id", F.col("turns").alias("b")), "id", "full")
    empty = F.filter(F.coalesce(a, b, none), lambda t: F.lit(False))
    pairs = pairs.select("id", F.coalesce(a, empty).alias("a"), F.coalesce(b, empty).alias("b"))
    shorter = F.least(F.size("a"), F.size("b"))
    differ = F.array_position(F.zip_with(F.slice("a", F.lit(1), shorter), F.slice("b", F.lit(1), shorter), lambda x, y: x == y), False)
    pairs = pairs.withColumn("n", F.when(differ > 0, differ - 1).otherwise(shorter).cast("int"))
    rest = F.expr("slice(a, n + 1, size(a))"), F.expr("slice(b, n + 1, size(b))")
    return pairs.select(
        "id",
        F.col("n").alias("n_prompt_turns"),
        _render(F.expr("slice(a, 1, n)")).alias("prompt"),
        _render(rest[0]).alias("chosen"),
        _mask(rest[0]).alias("chosen_mask"),
        _render(rest[1]).alias("rejected"),
        _mask(rest[1]).alias("rejected_mask"),
    )


def swap_last_reply(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from plain ``conversations``: the chosen side is the conversation as
    it is; on the rejected side its last assistant turn is replaced by the last reply of the conversation
    whose id differs in the lowest bit (by nothing, where there is none). Turns behind the reply, of which
    none is an assistant's, stay on both sides. Without an assistant turn both sides are the same."""
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant") + 1
    marked = talks.withColumn("at", F.when(F.array_contains(F.transform("turns", lambda t: t["role"]), "assistant"), at.cast("int")))
    other = marked.where("at IS NOT NULL").select(F.expr("id ^ 1").alias("id"), F.expr("slice(turns, at, 1)").alias("reply"))
    both = marked.join(other, "id", "left")
    swapped = F.expr("concat(slice(turns, 1, at - 1), coalesce(reply, slice(turns, 1, 0)), slice(turns, at + 1, size(turns)))")
    return talks, both.select("id", F.when(F.col("at").isNull(), F.col("turns")).otherwise(swapped).alias("turns"))
