"""Trust scores, statuses, enforcement actions and current state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions.scalars import fixed_decimals, progress, status_tile
from fleetsight.plans.ordered import Clamp, OrderedRows, hold_unless, latest, ordered
from fleetsight.operators.predicates import bad_nodes


@dataclass(frozen=True)
class TrustPolicy:
    """Score steps and limits of one detector generation."""

    decay: float
    recovery: float
    lo: float = 0.0
    hi: float = 100.0
    init: float = 100.0


# Steps of the record detector (v1) and of the sequence detector (v2).
V1 = TrustPolicy(decay=15.0, recovery=2.0)
V2 = TrustPolicy(decay=5.0, recovery=1.0)

# Status limits (v1) and cordon limits (v2).
BANNED_BELOW = 30.0
PROBATION_BELOW = 75.0
CORDON_BELOW = 40.0
UNCORDON_ABOVE = 60.0


def _rows(df: DataFrame | OrderedRows, key, order, rows_per_chunk, plan_from=None) -> OrderedRows:
    if isinstance(df, OrderedRows):
        return df
    return ordered(df, key, order, rows_per_chunk, plan_from)


def score_clamp(
    policy: TrustPolicy,
    anomaly: str = "is_anomaly",
    tampered: str | None = None,
    prior: str | None = None,
) -> Clamp:
    """The score step as a clamp; a tampered record sets the score to 0 instead. ``prior`` names
    a column with the score of each key before its first row (null: the default)."""
    delta = F.when(F.col(anomaly), -policy.decay).otherwise(policy.recovery)
    lo, hi = F.lit(policy.lo), F.lit(policy.hi)
    if tampered is not None:
        bad = F.coalesce(F.col(tampered), F.lit(False))
        delta = F.when(bad, 0.0).otherwise(delta)
        lo, hi = F.when(bad, 0.0).otherwise(lo), F.when(bad, 0.0).otherwise(hi)
    init = policy.init if prior is None else F.coalesce(F.col(prior), F.lit(policy.init))
    return Clamp("score", delta, lo, hi, init)


def latch_clamp(tampered: str, prior: str | None = None) -> Clamp:
    lo, hi = hold_unless(F.coalesce(F.col(tampered), F.lit(False)))
    init = 0.0 if prior is None else F.coalesce(F.col(prior).cast("double"), F.lit(0.0))
    return Clamp("compromised", F.lit(0.0), lo, hi, init)


def trust_rows(
    df: DataFrame | OrderedRows,
    policy: TrustPolicy = V1,
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("ts",),
    anomaly: str = "is_anomaly",
    tampered: str | None = None,
    rows_per_chunk: int | None = None,
    prior_score: str | None = None,
    prior_compromised: str | None = None,
    plan_from: DataFrame | None = None,
) -> OrderedRows:
    clamps = [score_clamp(policy, anomaly, tampered, prior_score)]
    if tampered is not None:
        clamps.append(latch_clamp(tampered, prior_compromised))
    return _rows(df, key, order, rows_per_chunk, plan_from).scan(*clamps)


def trust_scores(df: DataFrame | OrderedRows, policy: TrustPolicy = V1, **kw) -> DataFrame:
    """Bounded running score per key: adds ``score`` (after the row) and ``prev_score``.

    With ``tampered`` (a flag column) such records set the score to 0, and ``compromised`` /
    ``prev_compromised`` (1.0/0.0) tell whether one was seen so far / before.
    """
    return trust_rows(df, policy, **kw).result()


def latch(
    df: DataFrame,
    flag: str,
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("ts",),
    out: str = "compromised",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """True from the first flagged row of a key on."""
    rows = ordered(df, key, order, rows_per_chunk).running(
        _seen=latest(F.when(F.col(flag), F.lit(True)))
    )
    return rows.with_columns(**{out: F.coalesce("_seen", F.lit(False))}).result().drop("_seen")


def status_of(score: Column) -> Column:
    return (
        F.when(score < BANNED_BELOW, "Banned")
        .when(score < PROBATION_BELOW, "Probation")
        .otherwise("Healthy")
    )


def status_transitions(df: DataFrame, tampered: str | None = None) -> DataFrame:
    """Add ``status``, ``prev_status`` and ``action`` to scored rows.

    A status is a function of the score, so the previous status follows from ``prev_score`` in
    the same row: a projection, no second pass over the order.
    """
    now, before = status_of(F.col("score")), status_of(F.col("prev_score"))
    bad = F.lit(False)
    if tampered is not None:
        bad = F.coalesce(F.col(tampered), F.lit(False))
        now = F.when(F.col("compromised") == 1.0, "Compromised").otherwise(now)
        before = F.when(F.col("prev_compromised") == 1.0, "Compromised").otherwise(before)
    new, old = F.col("status"), F.col("prev_status")
    action = (
        F.when(bad, "BAN")
        .when(new == "Compromised", None)
        .when((new == "Banned") & (old != "Banned"), "BAN")
        .when((new == "Probation") & (old == "Healthy"), "TAINT")
        .when((new == "Healthy") & (old == "Probation"), "UNTAINT")
        .when((new == "Healthy") & (old == "Banned"), "UNCORDON+UNTAINT")
    )
    return df.withColumns({"status": now, "prev_status": before}).withColumn("action", action)


def _auto(auto_remediate: bool | str) -> Column:
    """A constant, or the name of a policy column."""
    return F.col(auto_remediate) if isinstance(auto_remediate, str) else F.lit(auto_remediate)


def hysteresis_rows(
    rows: OrderedRows,
    low: float = CORDON_BELOW,
    high: float = UNCORDON_ABOVE,
    auto_remediate: bool | str = True,
    prior: str | None = None,
) -> OrderedRows:
    """``prior`` names a column with the flag of each key before its first row (null: not set)."""
    score = F.col("score")
    lo, hi = hold_unless(score < low, _auto(auto_remediate) & (score > high))
    init = 0.0 if prior is None else F.coalesce(F.col(prior).cast("double"), F.lit(0.0))
    scanned = rows.scan(Clamp("_cordon", F.lit(0.0), lo, hi, init))
    flag, before = F.col("_cordon") == 1.0, F.col("prev__cordon") == 1.0
    return scanned.with_columns(
        cordoned=flag,
        action=F.when(flag & ~before, "CORDON").when(~flag & before, "UNCORDON"),
    )


def hysteresis(
    df: DataFrame,
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("ts",),
    rows_per_chunk: int | None = None,
    **kw,
) -> DataFrame:
    """Cordon flag that is set below ``low``, cleared above ``high`` (if remediation is on) and
    held in between; ``action`` on changes only."""
    rows = hysteresis_rows(ordered(df, key, order, rows_per_chunk), **kw)
    return rows.result().drop("_cordon", "prev__cordon")


def cordon_trace(
    df: DataFrame,
    policy: TrustPolicy = V2,
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("ts",),
    anomaly: str = "is_anomaly",
    rows_per_chunk: int | None = None,
    plan_from: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """Score and cordon flag in one layout: both scans run in the same tasks, one shuffle."""
    rows = trust_rows(
        df, policy, key, order, anomaly, None, rows_per_chunk, plan_from=plan_from
    )
    return hysteresis_rows(rows, **kw).result().drop("_cordon", "prev__cordon")


def latest_state(
    df: DataFrame,
    key: Sequence[str] = ("node",),
    order: Sequence[str] = ("ts",),
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Newest row per key. ``max_by`` combines map side: one row per key and task shuffles."""
    cols = [c for c in (cols or df.columns) if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_s"))
        .select(*key, "_s.*")
    )


def node_health(state: DataFrame) -> DataFrame:
    """Dashboard rows: tile text, gauges as text, progress bar, alert text for bad nodes."""
    status = F.coalesce("status", F.lit("Unknown"))
    cpu = F.coalesce("cpu", F.lit(0.0))
    score = F.coalesce("score", F.lit(100.0))
    return state.select(
        "node",
        status.alias("status"),
        status_tile(status).alias("tile"),
        F.concat(fixed_decimals(cpu, 1), F.lit("%")).alias("cpu_text"),
        fixed_decimals(score, 1).alias("score_text"),
        progress(score).alias("progress"),
        F.when(status == "Banned", "BANNED (Cordoned/Drained)")
        .when(status == "Probation", "PROBATION (Tainted)")
        .alias("alert"),
    )


def node_alerts(state: DataFrame, include_compromised: bool = False) -> DataFrame:
    return node_health(bad_nodes(state, include_compromised)).select("node", "status", "alert")
