"""Oracle SQL of tiers 0 to 2."""

from __future__ import annotations

from tierwise.oracle.stages import LINES, MEASURES, RANKS, forecast_growth, upto, with_stages

BASE = with_stages(LINES)
OUT = MEASURES.replace("sales_eur,", "sales_eur::DOUBLE AS sales_eur,", 1)


def table(grain: str, ids: str, where: str = "") -> str:
    return (
        upto((grain,))
        + f"SELECT year_month, period_type, brand_name, franchise, {ids} {OUT}, "
        + f"{', '.join(RANKS)}, rank_trend_3m FROM {grain}_metrics {where}"
    )


def some(columns: str, where: str = "") -> str:
    return upto() + f"SELECT year_month, period_type, brand_name, region_name, {columns} FROM region_metrics {where}"


GEO = "region_name, territory_id, territory_name,"


def period(name: str) -> str:
    return upto() + (
        "SELECT year_month, period_type, brand_name, region_name, units, sales_eur::DOUBLE AS sales_eur, "
        f"tot_s::DOUBLE AS tot_sales_eur FROM region_metrics WHERE period_type = '{name}'"
    )


def sql() -> dict[str, str]:
    return {
        "bucketed_sales": BASE
        + "SELECT year_month, brand_name, franchise, region_name, territory_id, territory_name, units, "
        "sales_eur::DOUBLE AS sales_eur FROM sales",
        "bucketed_forecast": BASE
        + "SELECT year_month, brand_name, franchise, units, sales_eur::DOUBLE AS sales_eur FROM brand_forecast",
        "own_sales": BASE
        + "SELECT year_month, brand_name, franchise, region_name, territory_id, territory_name, units, "
        "sales_eur::DOUBLE AS sales_eur FROM sales WHERE is_own_brand = 1",
        "market_totals": BASE
        + "SELECT year_month, franchise, region_name, tot_u, tot_s::DOUBLE AS tot_s FROM market",
        "brand_forecast": BASE
        + "SELECT year_month, brand_name, franchise, units, sales_eur::DOUBLE AS sales_eur FROM brand_forecast",
        "dense_grid": BASE + "SELECT * FROM grid",
        "dense_sales": BASE
        + "SELECT year_month, brand_name, franchise, region_name, territory_id, territory_name, own_u, "
        "own_s::DOUBLE AS own_s, tot_u, tot_s::DOUBLE AS tot_s FROM dense",
        "metrics_month": period("Month"),
        "metrics_rollq": period("RollQ"),
        "metrics_ytd": period("YTD"),
        "metrics_mat": period("MAT"),
        "market_share": some("market_share"),
        "growth": some("growth_py_sales, growth_pp_sales, growth_py_units, growth_pp_units"),
        "forecast_growth": with_stages(LINES, forecast_growth())
        + "SELECT year_month, period_type, brand_name, fcst_growth_py, fcst_growth_py_u FROM fc_growth",
        "growth_vs_forecast": some("growth_vs_fcst_eur, growth_vs_fcst_units"),
        "growth_deviation": some("growth_py_sales, growth_deviation"),
        "mshare_deviation": some("market_share, mshare_deviation"),
        "mshare_dev_growth": some("mshare_deviation, growth_py_mshare_dev, growth_pp_mshare_dev"),
        "percentile_ranks": some(", ".join(RANKS)),
        "rank_trend": some("rank_sales_eur, rank_trend_3m"),
        "region_metrics": table("region", GEO),
        "territory_metrics": table("territory", "territory_id, territory_name,"),
        "national_metrics": table("national", ""),
        "top_regions": upto()
        + """SELECT brand_name, region_name, territory_name, units, sales_eur::DOUBLE AS sales_eur,
  market_share, growth_py_sales, rank_sales_eur, rank_trend_3m
FROM region_metrics
WHERE period_type = 'Month' AND year_month = (SELECT max(year_month) FROM region_metrics)
QUALIFY row_number() OVER (PARTITION BY brand_name ORDER BY rank_sales_eur DESC, region_name) <= 10""",
        "launch_vs_decline": upto()
        + """, latest AS (SELECT DISTINCT year_month FROM region_metrics ORDER BY 1 DESC LIMIT 10),
picked AS (SELECT year_month FROM (SELECT year_month, row_number() OVER (ORDER BY year_month DESC) AS k
  FROM latest) WHERE k IN (1, 4, 7, 10))
SELECT brand_name, year_month, sum(units)::BIGINT AS units, sum(sales_eur)::DOUBLE AS sales_eur,
  round_even(sum(growth_py_sales::DECIMAL(18,2))::DOUBLE / count(growth_py_sales), 1) + 0.0::DOUBLE AS avg_gpy,
  round_even(sum(growth_vs_fcst_eur::DECIMAL(18,2))::DOUBLE / count(growth_vs_fcst_eur), 1) + 0.0::DOUBLE
    AS avg_growth_vs_fcst_eur
FROM region_metrics WHERE period_type = 'Month' AND year_month IN (SELECT year_month FROM picked)
GROUP BY brand_name, year_month""",
    }
