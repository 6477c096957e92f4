"""Sharding by extendible hashing, in DataFrame operations only.

Every row gets 60 hash bits. A directory maps hash prefixes to shards: it starts with one shard for
all rows, and only a shard that holds more than ``limit`` bytes splits on its next bit, until every
shard fits. The directory is computed from byte sums of fine hash cells (map-side combined), never by
moving rows: cells too large are cut finer among themselves, then each cell looks up the shortest
prefix whose sum fits. Rows find their shard by a join with the directory.

A shard of equal rows only cannot split on bits. If it is over the limit it keeps its prefix and is
cut into numbered parts (``part``), each of as many rows as fit, at least one: a row above the limit
is a part of its own.

Defined cases: a null text has 0 bytes; nulls take part in the hash as such; equal rows hash alike; an
empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.columns import set_aside
from fleetsight.llm.store import stored
from fleetsight.plans.sizing import broadcast_if_small

SHARD_BYTES = 16 * 1024 * 1024
BITS = 60
# Bits by which the first cells are finer than shards of the wanted size, and by which a cell that is
# still too large is cut again.
FINER = 4
AGAIN = 8

_ADDED = ("n_bytes", "shard", "part", "shard_bytes")


def row_hash(columns: list[Column]) -> Column:
    """60 hash bits of the columns' text forms."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column | int) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {bits})") if isinstance(bits, int) else F.call_function("shiftright", F.col("h"), F.lit(BITS) - bits)


def _cells(rows: DataFrame, bits: int) -> DataFrame:
    return rows.groupBy(_prefix(bits).alias("prefix")).agg(
        F.sum("n_bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")
    ).withColumn("bits", F.lit(bits))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(start, cell, cell_bits, shard, bits, shard_bytes, single): one row per fine cell with its shard;
    ``start`` is the cell's prefix of the returned number of bits. ``rows`` has h and n_bytes and is read
    more than once."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    first = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + FINER)
    too_large = (F.col("bytes") > limit) & (F.col("low") < F.col("high"))
    parts, left, bits = [], rows, first
    while True:
        cells = stored(_cells(left, bits), "cells")
        parts.append(cells.where(~too_large))
        large = cells.where(too_large).select(F.col("prefix").alias("large"))
        n = large.count()
        if not n:
            break
        left = left.join(broadcast_if_small(large, n), _prefix(bits) == F.col("large"), "left_semi")
        bits = min(BITS, bits + AGAIN)
    cells = reduce(DataFrame.unionByName, parts)
    up = cells.withColumn("d", F.explode(F.expr("sequence(0, bits)"))).withColumn("p", F.expr("shiftright(prefix, bits - d)"))
    sums = up.groupBy("d", "p").agg(F.sum("bytes").alias("sum"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    fits = sums.where((F.col("sum") <= limit) | (F.col("lo") == F.col("hi")))
    best = F.min(F.struct(F.col("d"), F.col("p"), F.col("sum"), (F.col("lo") == F.col("hi")).alias("single")))
    chosen = up.join(fits, ["d", "p"]).groupBy(F.col("prefix").alias("cell"), F.col("bits").alias("cell_bits")).agg(best.alias("s"))
    return chosen.select(
        F.expr(f"shiftright(cell, cell_bits - {first})").alias("start"),
        "cell",
        "cell_bits",
        F.col("s.p").alias("prefix"),
        F.col("s.d").alias("bits"),
        F.col("s.sum").alias("shard_bytes"),
        F.col("s.single").alias("single"),
    ), first


def shard_rows(docs: DataFrame, text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` plus ``n_bytes`` (of its text), ``shard`` (the prefix bits, '' for the only shard),
    ``part`` (0 unless equal rows overflow) and ``shard_bytes`` (of that shard and part)."""
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    base = docs.drop(*(c for c in _ADDED if c in docs.columns))
    given, named = set_aside(base, text_col)
    own = [F.col(f"`{c}`") for c in given.columns]
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    hashed = given.select(*own, n_bytes.alias("n_bytes"), row_hash(own).alias("h"))
    found = _assigned(hashed, stored(hashed.select("h", "n_bytes"), "hashes"), given.columns, limit)
    return found.select(*named, *_ADDED)


def shard_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """As shard_rows, for the id alone: texts are read once and not carried."""
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    narrow = stored(docs.select(doc_id.alias(id_col), n_bytes.alias("n_bytes"), row_hash([doc_id, text]).alias("h")), "hashes")
    return _assigned(narrow, narrow.select("h", "n_bytes"), [id_col], limit)


def _assigned(hashed: DataFrame, narrow: DataFrame, columns: list[str], limit: int) -> DataFrame:
    cells, first = directory(narrow, limit)
    cells = stored(cells, "directory")
    own = [F.col(f"`{c}`") for c in columns]
    found = hashed.join(
        broadcast_if_small(cells, cells.count()),
        (_prefix(first) == F.col("start")) & (F.expr(f"shiftright(h, {BITS} - cell_bits)") == F.col("cell")),
    )
    name = F.when(F.col("bits") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), bits, '0')"))
    over = F.col("single") & (F.col("shard_bytes") > limit)
    found = found.select(*own, "n_bytes", name.alias("shard"), "shard_bytes", over.alias("__over"))
    plain = found.where("NOT __over").select(*own, "n_bytes", "shard", F.lit(0).cast("long").alias("part"), "shard_bytes")
    if not cells.where(over).head(1):
        return plain
    # Equal rows that overflow: counted, then dealt out again part by part.
    per_part = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)"))
    equal = found.where("__over").groupBy(*own, "n_bytes", "shard").agg(F.count(F.lit(1)).alias("__n")).withColumn("__per", per_part)
    parts = equal.withColumn("part", F.explode(F.expr("sequence(0L, (__n - 1) div __per)")))
    parts = parts.withColumn("__here", F.least(F.col("__per"), F.col("__n") - F.col("part") * F.col("__per")))
    dealt = parts.repartition("shard", "part").withColumn("__i", F.explode(F.expr("sequence(1L, __here)")))
    return plain.unionByName(dealt.select(*own, "n_bytes", "shard", "part", (F.col("n_bytes") * F.col("__here")).alias("shard_bytes")))
