"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key from a hash of its id. Within a source the documents are ordered by
that key; a source's budget is met by whole passes (epochs) over it and a last pass up to the cut, the
place where the running number of words reaches the rest of the budget.

The order is cut into key ranges of about ``ROWS_PER_RANGE`` rows. Words are summed by source and
range (map-side combined), a prefix sum runs over those sums, and only the range in which a source's
cut lies is looked at row by row. So no task holds a source. The cut itself is one row per source,
joined back to the documents.

Targets: sources in code point order, null last, get ``weights`` in turn. They share ``share`` times
all words by weight; none gets more than ``max_epochs`` times its own words, and what that leaves over
is shared again by weight among the others (the common factor rises until all is given out).

Defined cases: a null or empty text has 0 words and is never taken; null and empty sources are sources
of their own; rows equal in key, id and size share the rest at the cut evenly, rounded down; a table
without words takes nothing; an empty table gives an empty result; columns of the input named like
the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight.llm.store import stored
from fleetsight.plans.sizing import broadcast_if_small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 5_000
SEED = "mix-1"

_WORD = r"[^\x20\x09-\x0D]+"
_ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash bits of the id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, target) from rows of (source, size). One small row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    rows = (
        by_source.withColumn("place", F.row_number().over(in_order))
        .withColumn("w", F.element_at(F.lit(list(weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("given", F.sum("cap").over(by_need) - F.col("cap"))
        .withColumn("open", F.sum("w").over(everything) - F.sum("w").over(by_need) + F.col("w"))
        .withColumn("level", (F.col("total") - F.col("given")) / F.col("open"))
    )
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(everything)
    rows = rows.withColumn("stop", level)
    capped = F.col("stop").isNull() | (F.struct("ratio", "place") < F.struct("stop.ratio", "stop.place"))
    target = F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), F.col("stop.level") * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"))


def source_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole epochs, and the key, id and size of the rows at the cut with what each of them
    gives. ``sized`` has doc_id, source, size and key and is read more than once."""
    n_rows = sized.count()
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / ROWS_PER_RANGE)))
    place = F.shiftright("key", 60 - bits)
    budget = F.floor("target")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)).withColumn(
        "rest", budget - F.col("epochs") * F.col("source_size")
    )
    ranges = sized.withColumn("range", place).groupBy("source", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("range")
    at = ranges.withColumn("before", F.sum("words").over(running) - F.col("words"))
    same = ranges["source"].eqNullSafe(plan["source"])
    at = at.join(plan, same).where("before <= rest AND rest < before + words").select(
        ranges["source"], "range", "before", "rest"
    )
    # The one range of each source that holds its cut, row by row; equal rows as one.
    rows = sized.withColumn("range", place)
    inside = rows.join(at, rows["source"].eqNullSafe(at["source"]) & (rows["range"] == at["range"])).select(
        rows["source"], "key", "doc_id", "size", "before", "rest"
    )
    inside = inside.groupBy("source", "key", "doc_id", "size", "before", "rest").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    inside = inside.withColumn("begin", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n"))
    cut = inside.where("begin <= rest AND rest < begin + size * n").select(
        F.col("source").alias("cut_source"), "key", "doc_id", "size", F.floor((F.col("rest") - F.col("begin")) / F.col("n")).alias("part")
    )
    return plan.join(cut, plan["source"].eqNullSafe(cut["cut_source"]), "left").select(
        plan["source"].alias("cut_source"),
        "source_size",
        "target",
        F.col("epochs").cast("long").alias("epochs"),
        F.struct("key", "doc_id", "size").alias("cut_at"),
        F.col("part").alias("cut_part"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` (of its source) and ``taken`` (words the mix
    takes from it, repeats counted)."""
    base = docs.drop(*(c for c in _ADDED if c in docs.columns))
    doc_id, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    own = {"__size": word_count(F.col(f"`{text_col}`")), "__key": random_key(doc_id, seed)}
    narrow = base.select(doc_id.alias("doc_id"), source.alias("source"), own["__size"].alias("size"), own["__key"].alias("key"))
    narrow = stored(narrow, "mix")
    targets = stored(source_targets(narrow, share, weights, max_epochs), "targets")
    cuts = stored(source_cuts(narrow, targets), "cuts")
    if set(base.columns) <= {id_col, text_col, source_col}:
        # Nothing else is asked for: the narrow table already has it.
        rows = narrow.select(
            F.col("doc_id").alias(id_col), F.col("source").alias(source_col), F.col("size").alias("__size"), F.col("key").alias("__key")
        )
    else:
        rows = base.withColumns(own)
    joined = rows.join(broadcast_if_small(cuts, cuts.count()), source.eqNullSafe(F.col("cut_source")), "left")
    at = F.struct(F.col("__key").alias("key"), doc_id.alias("doc_id"), F.col("__size").alias("size"))
    size = F.col("__size")
    last = F.when(F.col("cut_part").isNull() | (at > F.col("cut_at")), 0).when(at == F.col("cut_at"), F.col("cut_part")).otherwise(size)
    taken = F.col("epochs") * size + last
    kept = [c for c in rows.columns if not c.startswith("__")]
    return joined.select(
        *(F.col(f"`{c}`") for c in kept),
        size.alias("size"),
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
    )


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """The mix as rows: a document once for every time it is taken whole; the one at a source's cut
    counts if at least half of it is taken. The columns that mixing added are dropped."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = mixed.withColumn("__copies", copies).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop(*_ADDED, "__copies", "__copy")
