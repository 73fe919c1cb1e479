"""Tier 1: month, rolling quarter, year to date and moving annual total, with their lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import pct_growth, rnd
from tierwise.specs import PERIODS, PRIOR_PERIOD_ROWS, PRIOR_YEAR_ROWS, WINDOW_ROWS


def _period_sum(column: str, period: str, keys: Sequence[str]) -> Column:
    # Ordering by year first lets the calendar-year frame and the rolling frames share one sort.
    if period == "Month":
        return F.col(column)
    if period == "YTD":
        year = W.partitionBy(*keys, "_year").orderBy("year_month")
        return F.sum(column).over(year.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = WINDOW_ROWS[period]
    series = W.partitionBy(*keys).orderBy("_year", "year_month")
    total = F.sum(column).over(series.rowsBetween(1 - rows, W.currentRow))
    return F.when(F.col("_n") >= rows, total)


def period_rows(
    monthly: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    periods: Sequence[str] = PERIODS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row and period: each column's sum, its value a year and a period before.

    Adds ``<c>``, ``<c>_py`` and ``<c>_pp`` per column. All windows run over the same keys and
    order: one shuffle and one sort for every period. Shifts count rows, so a series must have
    one row per month.
    """
    series = W.partitionBy(*keys).orderBy("_year", "year_month")
    df = monthly.withColumn("_year", F.substring("year_month", 1, 4)).withColumn(
        "_n", F.row_number().over(series)
    )
    sums = {f"_{p}_{c}": _period_sum(c, p, keys) for p in periods for c in columns}
    df = df.withColumns(sums)
    shifted = {}
    for p in periods:
        for c in columns:
            shifted[f"_{p}_{c}_py"] = F.lag(f"_{p}_{c}", PRIOR_YEAR_ROWS).over(series)
            shifted[f"_{p}_{c}_pp"] = F.lag(f"_{p}_{c}", PRIOR_PERIOD_ROWS[p]).over(series)
    df = df.withColumns(shifted)
    ids = list(dict.fromkeys(["year_month", *keep]))

    def fields(p: str) -> list[Column]:
        return [F.lit(p).alias("period_type")] + [
            F.col(f"_{p}_{c}{s}").alias(f"{c}{s}") for c in columns for s in ("", "_py", "_pp")
        ]

    if len(periods) == 1:
        return df.select(*ids, *fields(periods[0]))
    return df.select(*ids, F.inline(F.array(*[F.struct(*fields(p)) for p in periods])))


def forecast_growth(brand_forecast: DataFrame, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Prior-year growth of the brand forecast per period, over the months that exist."""
    rows = period_rows(brand_forecast, ["brand_name"], ["units", "sales_eur"], periods, ["brand_name"])
    return rows.select(
        "year_month",
        "period_type",
        "brand_name",
        rnd(pct_growth(F.col("sales_eur"), F.col("sales_eur_py")), 2).alias("fcst_growth_py"),
        rnd(pct_growth(F.col("units"), F.col("units_py")), 2).alias("fcst_growth_py_u"),
    )
