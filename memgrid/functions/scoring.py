"""Scores of candidates as Column expressions (R4-R8). Penalties are added to a logit, so they never raise one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the model.
DECAY_FACTOR, PERSISTENT_PENALTY = 0.98, -0.2
ACTIVATION_ALPHA, ACTIVATION_MAX, INJECTED_WEIGHT = 0.15, 0.6, 0.25
HUB_LAMBDA = 0.08
STATUS_FACTOR = {"active": 1.0, "superseded": 0.1, "disputed": 0.5}
INJECT_FLOOR, INJECT_MARGIN = 0.25, 2.5


def elapsed_days(now: Column, then: Column) -> Column:
    """F52."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / 86_400e6)


def activation(used: Column, injected: Column, clock: Column) -> Column:
    """What was used lately is nearer; clock counts a project's sessions, or else days."""
    n = used + INJECTED_WEIGHT * injected
    level = F.ln(1 + n * F.pow(F.greatest(F.lit(1.0), clock), F.lit(-0.5)))
    return F.when(n > 0, F.least(F.lit(ACTIVATION_MAX), ACTIVATION_ALPHA * level)).otherwise(0.0)


def hub_penalty(degree: Column) -> Column:
    """R6."""
    return F.when(degree > 0, -HUB_LAMBDA * F.ln(1 + degree)).otherwise(0.0)


def decay(type_: Column, days: Column, activation_: Column, hub: Column) -> Column:
    """Transient nodes fade by the day; persistent ones have a fixed penalty, activation and hub penalty."""
    return F.when(type_ == "persistent", F.lit(PERSISTENT_PENALTY) + activation_ + hub).otherwise(F.ln(F.lit(DECAY_FACTOR)) * days)


def status_penalty(status: Column) -> Column:
    """R7."""
    out = F
    for s, f in STATUS_FACTOR.items():
        out = out.when(status == s, F.ln(F.lit(f)))
    return out.otherwise(0.0)


def inject(rerank: Column, verified: Column, *by: str, floor: float = INJECT_FLOOR, margin: float = INJECT_MARGIN) -> Column:
    """Near enough to the best of the final results, above the floor, not marked unverified."""
    best = F.max(rerank).over(W.partitionBy(*by))
    return (rerank >= floor) & (rerank >= best - margin) & ~verified.eqNullSafe(F.lit(False))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)
