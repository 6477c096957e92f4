"""Column helpers. Each takes and returns ``Column`` and stays inside JVM code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports of common mining-pool endpoints.
MINING_PORTS = (3333, 4444, 5555, 6666, 7777, 8332, 8333, 14433, 14444)

# Path prefixes that count as execution from temporary storage.
TMP_PREFIXES = ("/tmp/", "/dev/shm/")


def host_of(instance: Column) -> Column:
    """``10.0.0.1:9100`` -> ``10.0.0.1``."""
    return F.substring_index(instance, ":", 1)


def parse_iso(text: Column) -> Column:
    """ISO-8601 text, fraction optional, one trailing ``Z`` ignored -> timestamp."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds, fraction cut off."""
    return F.unix_timestamp(ts)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def render_time(epoch: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds (fraction allowed) -> text in the session time zone."""
    return F.date_format(F.timestamp_micros(F.rint(epoch * 1_000_000).cast("bigint")), fmt)


def render_iso(epoch: Column) -> Column:
    return render_time(epoch, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def progress(score: Column) -> Column:
    """Score as a whole percentage in 0..100."""
    return clamp(score.cast("int"), 0, 100)


def utilization(idle: Column, scale: float = 1.0) -> Column:
    """Share that is not idle: ``scale - scale * idle`` (scale 100 for percent)."""
    return F.lit(scale) - idle * F.lit(scale)


def default_to(col: Column, value) -> Column:
    return F.coalesce(col, F.lit(value))


def basename_or(path: Column, default: str = "baseline") -> Column:
    """Last path element; ``default`` where there is no path."""
    return F.when(
        path.isNotNull() & (path != ""), F.substring_index(path, "/", -1)
    ).otherwise(F.lit(default))


def fixed_decimals(x: Column, digits: int) -> Column:
    """Fixed-point text. ``format_number`` rounds the binary value half-even, as C printf does;
    ``format_string('%.1f')`` would round the shortest decimal text half-up instead."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def fixed_width(cols: list[Column], widths: list[int]) -> Column:
    """Left-aligned cells, never truncated; width 0 leaves a cell unpadded."""
    fmt = " ".join(f"%-{w}s" if w else "%s" for w in widths)
    return F.format_string(fmt, *cols)


def latency_or_null(latency: Column, keep_sentinel: bool = True) -> Column:
    """-1 marks a failed probe. Kept by default, null on request."""
    return latency if keep_sentinel else F.nullif(latency, F.lit(-1.0))


def is_tmp_exec(binary: Column) -> Column:
    return reduce(lambda a, b: a | b, [binary.startswith(p) for p in TMP_PREFIXES])


def is_mining_port(port: Column) -> Column:
    return port.isin(*MINING_PORTS)


def map_json(counts: Column) -> Column:
    """Map -> JSON text with keys in sorted order (maps carry no order of their own)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counts))))


def first_json_key(raw: Column) -> Column:
    """First key of a JSON object in text order; ``unknown`` for an empty object."""
    return F.coalesce(F.get(F.json_object_keys(raw), F.lit(0)), F.lit("unknown"))


def is_json_object(raw: Column) -> Column:
    """True for text that is exactly one JSON object.

    Parsing it as the only element of an array also rejects trailing text after the object.
    Text in single quotes is no JSON.
    """
    alone = F.from_json(
        F.concat(F.lit("["), raw, F.lit("]")),
        "array<map<string, string>>",
        {"allowSingleQuotes": "false"},
    )
    return raw.startswith("{") & F.coalesce(F.size(alone) == 1, F.lit(False))


def status_tile(status: Column) -> Column:
    """Display text of a status. A compromised node is shown as such, not as healthy."""
    return (
        F.when(status == "Banned", "BANNED")
        .when(status == "Probation", "PROBATION")
        .when(status == "Compromised", "COMPROMISED")
        .otherwise("HEALTHY")
    )
