"""Tier 2: growth, share, deviation from the national reference, forecast gap and ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import pct_growth, pct_of, rnd
from tierwise.operators import order
from tierwise.specs import RANKED, Grain

# Every brand month holds one row per entity of the dense grid, so these groups are even.
PEERS = ("brand_name", "year_month", "period_type")
PEER_SUMS = ("own_s", "tot_s", "own_s_py", "tot_s_py", "own_s_pp", "tot_s_pp")


def peer_sum(name: str) -> Column:
    """The sum over all entities of the brand month, which one task holds."""
    return F.sum(name).over(W.partitionBy(*PEERS))


def with_peer_sums(rows: DataFrame, entity: str) -> DataFrame:
    """PEER_SUMS of the brand month as columns `all_...`, for brand months too large for one task: summed on the map side
    and joined back."""
    rows = order.written(rows)
    sums = rows.groupBy(*PEERS).agg(*[F.sum(c).alias(f"all_{c}") for c in PEER_SUMS], F.count(F.lit(1)).alias("_n"))
    salts = order.salts_for(sums.agg(F.max("_n")).first()[0])
    return order.beside(rows, sums.drop("_n"), PEERS, salts, entity)


def joined_sum(name: str) -> Column:
    """A sum that with_peer_sums has joined."""
    return F.col(f"all_{name}")


def growth_columns() -> dict[str, Column]:
    out = {}
    for shift in ("py", "pp"):
        for name, col in (("sales", "own_s"), ("units", "own_u")):
            out[f"growth_{shift}_{name}"] = rnd(pct_growth(F.col(col), F.col(f"{col}_{shift}")), 2)
    return out


def growth(rows: DataFrame) -> DataFrame:
    """Growth against prior year and prior period, for sales and units."""
    return rows.withColumns(growth_columns())


def share_columns() -> dict[str, Column]:
    return {"market_share": rnd(pct_of(F.col("own_s"), F.col("tot_s")), 2)}


def share(rows: DataFrame) -> DataFrame:
    return rows.withColumns(share_columns())


def share_deviation_columns(total: Callable[[str], Column] = peer_sum) -> dict[str, Column]:
    """Deviations now, a year and a period before. total gives the national sum of a column.

    The national reference is a window sum over the peers, and the earlier deviations are derived
    from the shifted sums of the same rows, so no join-back and no further shuffle is needed.
    """

    def deviation(suffix: str) -> Column:
        own, tot = f"own_s{suffix}", f"tot_s{suffix}"
        national = pct_of(total(own), total(tot))
        return rnd(rnd(pct_of(F.col(own), F.col(tot)), 2) - national, 2)

    return {"mshare_deviation": deviation(""), "_dev_py": deviation("_py"), "_dev_pp": deviation("_pp")}


def deviation_change_columns() -> dict[str, Column]:
    return {
        f"growth_{s}_mshare_dev": rnd(F.col("mshare_deviation") - F.col(f"_dev_{s}"), 2) for s in ("py", "pp")
    }


def share_deviation(rows: DataFrame) -> DataFrame:
    """Share minus the volume-weighted national share, and its change to prior year and period."""
    return rows.withColumns(share_deviation_columns()).withColumns(deviation_change_columns())


def growth_deviation_columns(total: Callable[[str], Column] = peer_sum) -> dict[str, Column]:
    cur, prev = total("own_s").cast("double"), total("own_s_py").cast("double")
    national = F.when(prev > 0, (cur - prev) / F.nullif(prev, F.lit(0.0)) * 100.0)
    return {"growth_deviation": rnd(F.col("growth_py_sales") - national, 2)}


def growth_deviation(rows: DataFrame) -> DataFrame:
    """Prior-year sales growth minus the volume-weighted national growth."""
    return rows.withColumns(growth_deviation_columns())


def growth_vs_forecast_columns() -> dict[str, Column]:
    return {
        "growth_vs_fcst_eur": rnd(F.col("growth_py_sales") - F.col("fcst_growth_py"), 2),
        "growth_vs_fcst_units": rnd(F.col("growth_py_units") - F.col("fcst_growth_py_u"), 2),
    }


def join_forecast(rows: DataFrame, fcst_growth: DataFrame) -> DataFrame:
    return rows.join(fcst_growth, ["brand_name", "year_month", "period_type"], "left")


def growth_vs_forecast(rows: DataFrame, fcst_growth: DataFrame) -> DataFrame:
    """Growth minus the forecast's own growth, in points; NULL where no forecast exists."""
    return join_forecast(rows, fcst_growth).withColumns(growth_vs_forecast_columns())


def percentile_rank(value: str) -> Column:
    """1..100 by average rank over the share of non-null peers, rounded half to even."""
    by_value = W.partitionBy(*PEERS).orderBy(F.col(value).asc_nulls_last())
    known = F.count(value).over(W.partitionBy(*PEERS))
    # The default frame counts rows up to and including ties, so this is the mean tied position.
    place = (F.rank().over(by_value) + F.count(value).over(by_value)) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), _percentile(place, known))


def _percentile(place: Column, known: Column) -> Column:
    share_of_peers = place / F.nullif(known, F.lit(0)) * 100.0
    return F.rint(F.least(F.greatest(share_of_peers, F.lit(1.0)), F.lit(100.0))).cast("int")


def rank_columns() -> dict[str, Column]:
    return {name: percentile_rank(value) for name, value in RANKED.items()}


def large_ranks(rows: DataFrame, entity: str) -> DataFrame:
    """rank_columns by tallies of the values, for brand months too large for one task."""
    return order.ranked(rows, PEERS, entity, RANKED, lambda below, n, known: _percentile((below * 2 + n + 1) / F.lit(2.0), known))


def rank_trend_column(grain: Grain) -> Column:
    """Change of the sales rank over three rows of the series."""
    series = W.partitionBy(*grain.series_keys, "period_type").orderBy("year_month")
    return (F.col("rank_sales_eur") - F.lag("rank_sales_eur", 3).over(series)).alias("rank_trend_3m")
