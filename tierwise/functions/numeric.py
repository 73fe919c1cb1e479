"""Rounding, growth and number-formatting expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, dp: int) -> Column:
    """Scale, round half to even, unscale; ``+ 0.0`` turns -0.0 into 0.0."""
    scale = float(10**dp)
    return F.rint(x.cast("double") * scale) / F.lit(scale) + F.lit(0.0)


def half_up(x: Column, dp: int) -> Column:
    """Round halves towards plus infinity, the rule of the generic signal reader."""
    scale = float(10**dp)
    return F.floor(x * scale + 0.5).cast("double") / F.lit(scale) + F.lit(0.0)


def pct_growth(cur: Column, prev: Column) -> Column:
    """Unrounded (cur - prev) / prev * 100; NULL where prev is 0 or NULL."""
    c, p = cur.cast("double"), prev.cast("double")
    return (c - p) / F.nullif(p, F.lit(0.0)) * 100.0


def pct_of(part: Column, whole: Column) -> Column:
    """Unrounded part / whole * 100; NULL unless whole > 0."""
    w = whole.cast("double")
    return F.when(w > 0, part.cast("double") / F.nullif(w, F.lit(0.0)) * 100.0)


def short_number(x: Column) -> Column:
    """A 2-decimal value as text without trailing zeros: 2, 0.5, -2.76."""
    text = x.cast("decimal(28,2)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")
