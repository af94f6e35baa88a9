"""Score bands and small arithmetic shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower limits of the bands.
RISK_BANDS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]
CHAIN_RISK_BANDS = [(80, "critical"), (60, "high"), (40, "medium"), (15, "low")]
ACTION_BANDS = [(75, "block"), (50, "observe"), (30, "log")]


def band(score: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    """Name of the first band whose lower limit the score reaches."""
    expr = None
    for limit, name in limits:
        expr = F.when(score >= limit, name) if expr is None else expr.when(score >= limit, name)
    return expr.otherwise(rest)


def risk_band(score: Column) -> Column:
    return band(score, RISK_BANDS, "clean")


def chain_risk_band(score: Column) -> Column:
    return band(score, CHAIN_RISK_BANDS, "clean")


def action_band(score: Column) -> Column:
    return band(score, ACTION_BANDS, "pass")


def points(*rules: tuple[Column, int | float]) -> Column:
    """Sum of the points of all conditions that hold."""
    total = F.lit(0)
    for cond, n in rules:
        total = total + F.when(cond, F.lit(n)).otherwise(F.lit(0))
    return total


def first_of(rules: list[tuple[Column, object]], rest: object) -> Column:
    """Value of the first condition that holds."""
    expr = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    r = rest if isinstance(rest, Column) else F.lit(rest)
    return expr.otherwise(r) if expr is not None else r


def labels(*rules: tuple[Column, str]) -> Column:
    """Array of the names of all conditions that hold, in the given order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())


def whole(x: Column) -> Column:
    """Truncation to a whole number."""
    return x.cast("bigint")
