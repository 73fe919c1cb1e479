"""Shared WITH stages of the oracle SQL, from order lines to metric tables.

Written apart from the DataFrame code: national references are joined back from grouped rows,
periods are stacked with UNION ALL, ties are counted by partition, the grid is a product of lists.
"""

from __future__ import annotations

# Period lengths, measures and rank columns of the metric tables.
PERIOD_ROWS = {"Month": 1, "RollQ": 3, "MAT": 12}
PRIOR = {"Month": 1, "RollQ": 3, "YTD": 12, "MAT": 1}
PERIODS = ("Month", "RollQ", "YTD", "MAT")
MEASURES = (
    "units, sales_eur, market_share, mshare_deviation, growth_py_sales, growth_pp_sales, growth_py_units, "
    "growth_pp_units, growth_vs_fcst_eur, growth_vs_fcst_units, growth_deviation, growth_py_mshare_dev, "
    "growth_pp_mshare_dev"
)
RANKS = {
    "rank_units": "units",
    "rank_sales_eur": "sales_eur",
    "rank_mshare_dev": "mshare_deviation",
    "rank_growth_py": "growth_py_sales",
    "rank_growth_pp": "growth_pp_sales",
    "rank_growth_vs_fcst_eur": "growth_vs_fcst_eur",
    "rank_growth_vs_fcst_units": "growth_vs_fcst_units",
    "rank_growth_py_mshare_dev": "growth_py_mshare_dev",
    "rank_growth_pp_mshare_dev": "growth_pp_mshare_dev",
}
GRAIN = {
    "region": ("region_name", "region_name, territory_id, territory_name"),
    "territory": ("territory_name", "territory_id, territory_name"),
    "national": ("brand_name", ""),
}


def r(x: str, dp: int) -> str:
    return f"(round_even({x}, {dp}) + 0.0::DOUBLE)"


def growth(cur: str, prev: str) -> str:
    return r(
        f"(({cur})::DOUBLE - ({prev})::DOUBLE) / nullif(({prev})::DOUBLE, 0.0::DOUBLE) * 100.0::DOUBLE", 2
    )


def share(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN ({part})::DOUBLE / ({whole})::DOUBLE * 100.0::DOUBLE END"


LINES = """
lines AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS ship_ym, strftime(o_orderdate, '%Y-%m') AS order_ym,
         l_partkey, p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS n,
         n_name AS region_name, CAST(r_regionkey AS VARCHAR) AS territory_id, r_name AS territory_name,
         CAST(l_quantity AS DECIMAL(18,4)) AS qty,
         CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(9,6))) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       JOIN part ON l_partkey = p_partkey),
sales AS (
  SELECT ship_ym AS year_month, p_brand AS brand_name, 'F' || (n % 5) AS franchise,
         CASE WHEN n <= 6 THEN 1 ELSE 0 END AS is_own_brand, region_name, territory_id, territory_name,
         round(sum(qty))::BIGINT AS units, CAST(sum(amount) AS DECIMAL(28,4)) AS sales_eur
  FROM lines GROUP BY ALL),
brand_forecast AS (
  SELECT order_ym AS year_month, p_brand AS brand_name, 'F' || (n % 5) AS franchise,
         round(sum(qty))::BIGINT AS units, CAST(sum(amount) AS DECIMAL(28,4)) AS sales_eur
  FROM lines WHERE n <= 6 GROUP BY ALL),
market AS (
  SELECT year_month, franchise, region_name, sum(units)::BIGINT AS tot_u, sum(sales_eur) AS tot_s
  FROM sales GROUP BY ALL),
regions AS (
  SELECT n_name AS region_name, CAST(r_regionkey AS VARCHAR) AS territory_id, r_name AS territory_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
grid AS (
  SELECT m.year_month, b.brand_name, b.franchise, g.region_name, g.territory_id, g.territory_name
  FROM (SELECT DISTINCT year_month FROM sales WHERE is_own_brand = 1) m,
       (SELECT DISTINCT brand_name, franchise FROM sales WHERE is_own_brand = 1) b, regions g),
dense AS (
  SELECT grid.*, coalesce(o.units, 0)::BIGINT AS own_u, coalesce(o.sales_eur, 0) AS own_s,
         coalesce(k.tot_u, 0)::BIGINT AS tot_u, coalesce(k.tot_s, 0) AS tot_s
  FROM grid
  LEFT JOIN (SELECT * FROM sales WHERE is_own_brand = 1) o
    ON o.year_month = grid.year_month AND o.brand_name = grid.brand_name AND o.region_name = grid.region_name
  LEFT JOIN market k
    ON k.year_month = grid.year_month AND k.franchise = grid.franchise AND k.region_name = grid.region_name)"""


def _period_select(src: str, keys: str, cols: list[str], ids: str, period: str) -> str:
    if period == "YTD":
        frame = f"(PARTITION BY {keys}, left(year_month, 4) ORDER BY year_month ROWS UNBOUNDED PRECEDING)"
        sums = ", ".join(f"sum({c}) OVER {frame} AS {c}" for c in cols)
    else:
        n = PERIOD_ROWS[period]
        frame = f"(PARTITION BY {keys} ORDER BY year_month ROWS {n - 1} PRECEDING)"
        sums = ", ".join(
            f"CASE WHEN count(*) OVER {frame} = {n} THEN sum({c}) OVER {frame} END AS {c}" for c in cols
        )
    return f"SELECT year_month, '{period}' AS period_type, {ids}, {sums} FROM {src}"


def _prior(col: str, keys: str) -> str:
    w = f"(PARTITION BY {keys}, period_type ORDER BY year_month)"
    whens = " ".join(f"WHEN '{p}' THEN lag({col}, {n}) OVER {w}" for p, n in PRIOR.items())
    return f"CASE period_type {whens} END"


def forecast_growth(periods=PERIODS) -> str:
    stacked = " UNION ALL ".join(
        _period_select("brand_forecast", "brand_name", ["units", "sales_eur"], "brand_name", p)
        for p in periods
    )
    w = "(PARTITION BY brand_name, period_type ORDER BY year_month)"
    return f"""
fc_periods AS ({stacked}),
fc_growth AS (
  SELECT year_month, period_type, brand_name,
         {growth("sales_eur", f"lag(sales_eur, 12) OVER {w}")} AS fcst_growth_py,
         {growth("units", f"lag(units, 12) OVER {w}")} AS fcst_growth_py_u
  FROM fc_periods)"""


def metrics(grain: str, periods=PERIODS) -> str:
    """CTEs ending in <grain>_metrics; needs LINES and forecast_growth before it."""
    ent, geo = GRAIN[grain]
    g = grain
    ids = "brand_name, franchise" + (f", {geo}" if geo else "")
    keys = "brand_name" if ent == "brand_name" else f"brand_name, {ent}"
    cols = ["own_u", "own_s", "tot_u", "tot_s"]
    stacked = " UNION ALL ".join(_period_select(f"{g}_base", keys, cols, ids, p) for p in periods)
    w = f"(PARTITION BY {keys}, period_type ORDER BY year_month)"
    peers = "PARTITION BY year_month, period_type, brand_name"
    ranks = ",\n         ".join(
        f"CASE WHEN {v} IS NOT NULL THEN CAST(round_even(least(greatest(("
        f"rank() OVER ({peers} ORDER BY {v} ASC NULLS LAST)"
        f" + (count(*) OVER ({peers}, {v}) - 1)::DOUBLE / 2.0::DOUBLE)"
        f" / nullif(count({v}) OVER ({peers}), 0)::DOUBLE * 100.0::DOUBLE, 1.0::DOUBLE), 100.0::DOUBLE), 0)"
        f" AS INTEGER) END AS {n}"
        for n, v in RANKS.items()
    )
    return f"""
{g}_base AS (
  SELECT year_month, {ids}, sum(own_u)::BIGINT AS own_u, sum(own_s) AS own_s,
         sum(tot_u)::BIGINT AS tot_u, sum(tot_s) AS tot_s
  FROM dense GROUP BY ALL),
{g}_periods AS ({stacked}),
{g}_lagged AS (
  SELECT *, lag(own_s, 12) OVER {w} AS s_py, {_prior("own_s", keys)} AS s_pp,
         lag(own_u, 12) OVER {w} AS u_py, {_prior("own_u", keys)} AS u_pp,
         lag(tot_s, 12) OVER {w} AS ts_py
  FROM {g}_periods),
{g}_national AS (
  SELECT year_month, period_type, brand_name, sum(own_s) AS o, sum(tot_s) AS t, sum(s_py) AS o_py
  FROM {g}_lagged GROUP BY ALL),
{g}_comp AS (
  SELECT l.*, {r(share("l.own_s", "l.tot_s"), 2)} AS market_share,
         {growth("l.own_s", "l.s_py")} AS growth_py_sales, {growth("l.own_s", "l.s_pp")} AS growth_pp_sales,
         {growth("l.own_u", "l.u_py")} AS growth_py_units, {growth("l.own_u", "l.u_pp")} AS growth_pp_units,
         {share("x.o", "x.t")} AS nat_share,
         CASE WHEN x.o_py > 0
              THEN (x.o::DOUBLE - x.o_py::DOUBLE) / x.o_py::DOUBLE * 100.0::DOUBLE END AS nat_growth,
         f.fcst_growth_py, f.fcst_growth_py_u
  FROM {g}_lagged l
  JOIN {g}_national x USING (year_month, period_type, brand_name)
  LEFT JOIN fc_growth f USING (year_month, period_type, brand_name)),
{g}_dev AS (
  SELECT *, {r("market_share - nat_share", 2)} AS mshare_deviation,
         {r("growth_py_sales - nat_growth", 2)} AS growth_deviation,
         {r("growth_py_sales - fcst_growth_py", 2)} AS growth_vs_fcst_eur,
         {r("growth_py_units - fcst_growth_py_u", 2)} AS growth_vs_fcst_units
  FROM {g}_comp),
{g}_momentum AS (
  SELECT year_month, period_type, {ids}, own_u::BIGINT AS units, own_s AS sales_eur, tot_s, market_share,
         mshare_deviation, growth_py_sales, growth_pp_sales, growth_py_units, growth_pp_units,
         growth_vs_fcst_eur, growth_vs_fcst_units, growth_deviation, nat_share, nat_growth, fcst_growth_py,
         {r(f"mshare_deviation - lag(mshare_deviation, 12) OVER {w}", 2)} AS growth_py_mshare_dev,
         {r(f"mshare_deviation - ({_prior('mshare_deviation', keys)})", 2)} AS growth_pp_mshare_dev
  FROM {g}_dev),
{g}_ranked AS (
  SELECT *, {ranks}
  FROM {g}_momentum),
{g}_metrics AS (
  SELECT *, rank_sales_eur - lag(rank_sales_eur, 3) OVER {w} AS rank_trend_3m FROM {g}_ranked)"""


def with_stages(*stages: str) -> str:
    return "WITH " + ",".join(stages) + "\n"


def upto(grains: tuple[str, ...] = ("region",), periods=PERIODS) -> str:
    """WITH clause from the order lines to the metric tables of some grains."""
    return with_stages(LINES, forecast_growth(periods), *(metrics(g, periods) for g in grains))
