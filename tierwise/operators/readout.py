"""Territory and national readouts, plan attainment, table pages and profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwise.functions.numeric import rnd
from tierwise.functions.trajectory import strength
from tierwise.operators.signals import _asof, at_asof, complete, filtered, oldest_first
from tierwise.specs import NATIONAL, PERIODS, ROLES, SIGNALS, TERRITORY, WINDOW_ROWS, Condition, SignalSpec

POSITION = SIGNALS[ROLES["territory_position"]]
MAX_PAGE = 500


def period_months(months: DataFrame, asof: str | None = None) -> DataFrame:
    """(period_type, year_month) of the months each period covers at the as-of month."""
    at = _asof(months, asof)
    # One row per calendar month of the data, newest first, so the list is short.
    listed = months.filter(F.col("year_month") <= at).agg(
        F.reverse(F.array_sort(F.collect_set("year_month"))).alias("m")
    )
    rows = {"Month": 1, **WINDOW_ROWS}
    covered = F.array(
        *[F.when(F.col("_k") < rows[p], p) for p in PERIODS if p != "YTD"],
        F.when(F.substring("year_month", 1, 4) == F.substring(at, 1, 4), "YTD"),
    )
    return listed.select(F.posexplode("m").alias("_k", "year_month")).select(
        F.explode(F.array_compact(covered)).alias("period_type"), "year_month"
    )


def plan_attainment(
    territory_rows: DataFrame, brand_forecast: DataFrame, asof: str | None = None, calendar: DataFrame | None = None
) -> DataFrame:
    """Actual over forecast per brand and period; left out where a month has no forecast.

    ``calendar`` holds the months of the data; without it they are taken from the rows.
    """
    calendar = territory_rows if calendar is None else calendar
    actual = (
        territory_rows.filter(F.col("year_month") == _asof(calendar, asof))
        .groupBy("brand_name", "period_type")
        .agg(F.sum("sales_eur").cast("decimal(28,4)").alias("actual"))
        .filter(F.col("actual").isNotNull())
    )
    months = period_months(calendar, asof)
    plan = brand_forecast.select("brand_name", "year_month", F.col("sales_eur").alias("fcst"))
    level = (
        actual.join(months, "period_type")
        .join(plan, ["brand_name", "year_month"], "left")
        .groupBy("brand_name", "period_type", "actual")
        .agg(
            F.sum("fcst").cast("decimal(28,4)").alias("fcst"),
            F.count("fcst").alias("_have"),
            F.count(F.lit(1)).alias("_want"),
        )
    )
    a, f = F.col("actual").cast("double"), F.col("fcst").cast("double")
    return level.filter((F.col("_have") == F.col("_want")) & (F.col("fcst") != 0)).select(
        "brand_name",
        "period_type",
        rnd(a, 0).alias("actual"),
        rnd(f, 0).alias("fcst"),
        rnd(a / F.nullif(f, F.lit(0.0)) * 100.0, 1).alias("pct"),
    )


def _headline() -> list[Column]:
    one = {
        "growth_py_sales": "growth_py",
        "growth_pp_sales": "growth_pp",
        "market_share": "market_share",
        "growth_vs_fcst_eur": "growth_vs_fcst",
    }
    return [
        rnd(F.col("sales_eur").cast("double"), 0).alias("mat_sales"),
        rnd(F.col("units").cast("double"), 0).alias("units"),
        *[rnd(F.col(c), 1).alias(name) for c, name in one.items()],
    ]


def _signal(spec: SignalSpec) -> list[Column]:
    """The trajectory and its scores, NULL unless every point is known."""
    whole = complete("m", range(spec.oldest + 1))
    scores = strength(oldest_first("m", spec.oldest), F.lit(spec.strength_kind), spec.higher_is_better, "signal_")
    names = [f"signal_{n}" for n in ("magnitude", "net", "coherence", "signed_strength", "direction", "shape")]
    points = [
        F.when(whole, rnd(F.col(f"m{k}"), 2)).alias(f"m{k}") for k in range(spec.oldest, -1, -1)
    ]
    return points + [F.when(whole, s).alias(n) for s, n in zip(scores, names)]


def national_summary(national: DataFrame, asof: str | None = None) -> DataFrame:
    """Absolute columns of every brand, and the trajectory of its national share."""
    rows = at_asof(national, {"m": "market_share"}, NATIONAL.series_keys, asof, POSITION.oldest)
    plan_growth = F.col("growth_py_sales") - F.col("growth_vs_fcst_eur")
    return rows.select(
        "brand_name",
        "year_month",
        *_headline(),
        rnd(plan_growth, 1).alias("national_fcst_growth"),
        *_signal(POSITION),
    )


def territory_readout(territory: DataFrame, regions: DataFrame, asof: str | None = None) -> DataFrame:
    """One row per brand and territory, largest first."""
    counts = regions.groupBy("territory_name").agg(F.count(F.lit(1)).alias("region_count"))
    rows = at_asof(territory, {"m": "mshare_deviation"}, TERRITORY.series_keys, asof, POSITION.oldest)
    return (
        rows.join(counts, "territory_name", "left")
        .select(
            "brand_name",
            "territory_name",
            F.coalesce(F.col("region_count"), F.lit(0).cast("long")).alias("region_count"),
            *_headline(),
            rnd(F.col("mshare_deviation"), 2).alias("mshare_deviation"),
            *_signal(POSITION),
        )
        .orderBy(F.desc("mat_sales"), "brand_name", "territory_name")
    )


def table_page(
    table: DataFrame,
    key: list[str],
    equals: Mapping[str, object] | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """A page of the filtered rows in key order, with the total count on every row.

    A limit above MAX_PAGE is refused.
    """
    if limit > MAX_PAGE:
        raise ValueError(f"a page has {MAX_PAGE} rows at most; asked for {limit}")
    conditions = [Condition(c, "=", v) for c, v in (equals or {}).items()]
    rows = filtered(table, conditions)
    total = rows.agg(F.count(F.lit(1))).scalar()
    page = rows.orderBy(*key).offset(offset).limit(limit)
    return page.withColumn("total", total)


def meta_profile(monthly: DataFrame) -> DataFrame:
    """Every brand with its franchise, the period types and the latest month, from the dense monthly frame.

    Every month and brand of that frame has a row in each period, so no period window is needed.
    """
    return monthly.groupBy("brand_name", "franchise").agg(F.max("year_month").alias("latest_ym")).select(
        "brand_name", "franchise", F.lit(",".join(sorted(PERIODS))).alias("periods"), "latest_ym"
    )
