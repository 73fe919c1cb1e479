"""Scores of a short series given as columns, oldest first.

Lags are few and known when the plan is built, so the series stays flat columns: the
arithmetic is generated code, without array functions in the hot path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierwise.functions.numeric import rnd
from tierwise.specs import COHERENCE, LOUDNESS, RELEVANCE_HORIZON


def steps(series: Sequence[Column]) -> list[Column]:
    return [b - a for a, b in zip(series, series[1:])]


def variation(series: Sequence[Column]) -> Column:
    """Path length of the series. Inputs carry 2 decimals; 6 decimals drop float noise."""
    total = F.lit(0.0)
    for step in steps(series):
        total = total + F.abs(step)
    return rnd(total, 6)


def net(series: Sequence[Column]) -> Column:
    return rnd(series[-1] - series[0], 6)


def coherence(v: Column, d: Column) -> Column:
    """d / v, and 0 for a series that does not move."""
    return F.when(v == 0, F.lit(0.0)).otherwise(d / F.nullif(v, F.lit(0.0)))


def ladder(kind: Column, level: str) -> Column:
    """The loudness threshold of one level, chosen by a strength-kind column."""
    out = None
    for name, bands in LOUDNESS.items():
        value = F.lit(float(bands[level]))
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def heading(d: Column, higher_is_better: Column) -> Column:
    return (
        F.when(d == 0, "flat")
        .when((d > 0) == higher_is_better, "improving")
        .otherwise("deteriorating")
    )


def shape(v: Column, rho: Column, kind: Column) -> Column:
    loud = ladder(kind, "loud")
    return (
        F.when(v < ladder(kind, "moderate"), "quiet")
        .when((v >= loud) & (F.abs(rho) >= COHERENCE["trend"]), "trend")
        .when((v >= loud) & (F.abs(rho) < COHERENCE["oscillation"]), "unstable")
        .otherwise("mixed")
    )


def strength(
    series: Sequence[Column], kind: Column, higher_is_better: Column | bool = True, prefix: str = ""
) -> list[Column]:
    """magnitude, net, coherence, signed_strength, direction and shape as named columns."""
    better = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    v, d = variation(series), net(series)
    rho = coherence(v, d)
    return [
        rnd(v, 3).alias(prefix + "magnitude"),
        rnd(d, 3).alias(prefix + "net"),
        rnd(rho, 3).alias(prefix + "coherence"),
        rnd(d * F.abs(rho), 3).alias(prefix + "signed_strength"),
        heading(d, better).alias(prefix + "direction"),
        shape(v, rho, kind).alias(prefix + "shape"),
    ]


def persistence(rho: Column) -> Column:
    """Label of the rounded coherence."""
    return (
        F.when(F.abs(rho) >= COHERENCE["trend"], "consistent")
        .when(F.abs(rho) >= COHERENCE["oscillation"], "mixed")
        .otherwise("oscillating")
    )


def relevance(rank: Column, v: Column, period: Column, kind: Column, prefix: str = "") -> list[Column]:
    """materiality x loudness x horizon, with its band."""
    # Bounds of the rank and of the score.
    materiality = F.when(rank >= 90, 4).when(rank >= 75, 3).when(rank >= 50, 2).otherwise(1)
    a = F.abs(v)
    loudness = (
        F.when(a >= ladder(kind, "very_loud"), 4)
        .when(a >= ladder(kind, "loud"), 3)
        .when(a >= ladder(kind, "moderate"), 2)
        .otherwise(1)
    )
    horizon = None
    for name, value in RELEVANCE_HORIZON.items():
        horizon = F.when(period == name, value) if horizon is None else horizon.when(period == name, value)
    score = materiality * loudness * horizon
    band = (
        F.when(score >= 48, "critical").when(score >= 24, "high").when(score >= 8, "moderate").otherwise("low")
    )
    return [
        materiality.alias(prefix + "materiality"),
        loudness.alias(prefix + "loudness"),
        horizon.alias(prefix + "horizon"),
        score.alias(prefix + "score"),
        band.alias(prefix + "band"),
    ]
