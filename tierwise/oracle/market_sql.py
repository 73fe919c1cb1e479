"""Oracle SQL of the documented market, gap, rule and neighbour methods."""

from __future__ import annotations

from tierwise.oracle.signals_sql import RKEY
from tierwise.oracle.stages import LINES, PERIODS, RANKS, _period_select, growth, r, share, upto, with_stages


def market(periods=PERIODS) -> str:
    ids = "franchise, region_name, territory_name"
    keys = "franchise, region_name"
    stacked = " UNION ALL ".join(_period_select("mb", keys, ["own_s", "tot_s", "tot_u"], ids, p) for p in periods)
    w = f"(PARTITION BY {keys}, period_type ORDER BY year_month)"
    return with_stages(
        LINES,
        f"""
mb AS (SELECT d.year_month, d.franchise, d.region_name, d.territory_name, sum(own_s) AS own_s, any_value(tot_s) AS tot_s,
    any_value(tot_u) AS tot_u FROM dense d GROUP BY ALL),
mp AS ({stacked}),
ml AS (SELECT *, lag(own_s, 12) OVER {w} AS own_py, lag(tot_s, 12) OVER {w} AS tot_py,
    lag(tot_u, 12) OVER {w} AS tot_u_py FROM mp),
mn AS (SELECT year_month, period_type, franchise, sum(tot_s) AS n, sum(tot_py) AS n_py FROM ml GROUP BY ALL),
mg AS (SELECT ml.*, {growth("own_s", "own_py")} AS own_growth, {growth("tot_s", "tot_py")} AS market_growth,
    {growth("tot_s - own_s", "tot_py - own_py")} AS competitor_growth, {r(share("own_s", "tot_s"), 2)} AS market_share,
    CASE WHEN n_py > 0 THEN (n::DOUBLE - n_py::DOUBLE) / n_py::DOUBLE * 100.0::DOUBLE END AS national
  FROM ml JOIN mn USING (year_month, period_type, franchise)),
ms AS (SELECT *, {r("own_growth - market_growth", 2)} AS share_momentum,
    {r("market_growth - national", 2)} AS market_growth_deviation FROM mg)""",
    )


def rivals() -> str:
    keys = "brand_name, region_name"
    w = f"(PARTITION BY {keys}, period_type ORDER BY year_month)"
    ids = "brand_name, franchise, region_name, territory_name"
    stacked = " UNION ALL ".join(_period_select("rb", keys, ["own_s", "tot_s"], ids, p) for p in PERIODS)
    return f""",
rgrid AS (SELECT m.year_month, b.brand_name, b.franchise, g.region_name, g.territory_name
  FROM (SELECT DISTINCT year_month FROM sales WHERE is_own_brand = 1) m,
       (SELECT DISTINCT brand_name, franchise FROM sales WHERE is_own_brand = 0) b, regions g),
rb AS (SELECT x.*, coalesce(o.sales_eur, 0) AS own_s, coalesce(k.tot_s, 0) AS tot_s FROM rgrid x
  LEFT JOIN sales o ON o.year_month = x.year_month AND o.brand_name = x.brand_name AND o.region_name = x.region_name
  LEFT JOIN market k ON k.year_month = x.year_month AND k.franchise = x.franchise AND k.region_name = x.region_name),
rp AS ({stacked}),
rl AS (SELECT *, lag(own_s, 12) OVER {w} AS own_py FROM rp)
"""


def gaps(name: str, metric: str) -> str:
    w = f"(PARTITION BY {RKEY}, period_type ORDER BY year_month)"
    return f"""
{name}0 AS (SELECT m.*, {r("med", 6)} AS pm FROM region_metrics m
  JOIN (SELECT year_month, brand_name, period_type, median({metric}) AS med FROM region_metrics GROUP BY ALL)
  USING (year_month, brand_name, period_type)),
{name}1 AS (SELECT year_month, period_type, brand_name, region_name, {metric} AS value, {r("pm", 2)} AS peer_median,
  {r(f"{metric} - pm", 2)} AS gap FROM {name}0),
{name}2 AS (SELECT *, lag(gap) OVER {w} AS previous_gap, {r(f"gap - lag(gap) OVER {w}", 2)} AS momentum FROM {name}1),
{name} AS (SELECT *, CASE WHEN momentum > 0.5 THEN 'widening' WHEN momentum < -0.5 THEN 'shrinking'
  WHEN momentum IS NOT NULL THEN 'stable' END AS movement FROM {name}2)"""


def status(rows: list[tuple[str, str, str, str]]) -> str:
    whens = " ".join(
        f"WHEN {cond} THEN CASE movement WHEN 'widening' THEN '{a}' WHEN 'stable' THEN '{b}' "
        f"WHEN 'shrinking' THEN '{c}' END"
        for cond, a, b, c in rows
    )
    return f"CASE {whens} END"


GROWTH_ROWS = [
    ("gap >= 10", "Exceptional & accelerating", "Exceptional & holding", "Exceptional but losing steam"),
    ("gap >= 5", "Strong & accelerating", "Consistently strong", "Strong but slowing"),
    ("gap > -5", "Turning positive", "Neutral", "Turning negative"),
    ("gap > -10", "Weak but improving", "Consistently below", "Weak & worsening"),
    ("gap <= -10", "Far behind but recovering", "Critically weak", "Crisis: worsening rapidly"),
]
POSITION_ROWS = [
    ("gap >= 1", "Strong position & gaining", "Strong position maintained", "Strong but slipping"),
    ("gap >= 0.5", "Improving position", "Above peer average", "Losing edge"),
    ("gap > -0.5", "Moving toward advantage", "Aligned with peers", "Moving toward disadvantage"),
    ("gap > -1", "Below avg but gaining", "Below peer average", "Below & worsening"),
    ("gap <= -1", "Significant gap but closing", "Severely disadvantaged", "Worsening crisis"),
]
TALL = {
    "units": "units",
    "sales_eur": "EUR",
    "market_share": "%",
    "mshare_deviation": "pp",
    "growth_py_sales": "%",
    "growth_pp_sales": "%",
    "growth_py_units": "%",
    "growth_pp_units": "%",
    "growth_vs_fcst_eur": "pp",
    "growth_vs_fcst_units": "pp",
    "growth_deviation": "pp",
    "growth_py_mshare_dev": "pp",
    "growth_pp_mshare_dev": "pp",
    **dict.fromkeys([*RANKS, "rank_trend_3m"], "rank"),
}
KEY = "year_month, period_type, franchise, region_name"


def _knn() -> str:
    d = "(a.g - b.g) * (a.g - b.g) + (a.d - b.d) * (a.d - b.d) + (a.k - b.k) * (a.k - b.k)"
    off = " + ".join(f"CASE WHEN abs({c} - m{c}) > 1 THEN 1 ELSE 0 END" for c in "gdk")
    med = ", ".join(f"{r(f'median(b{c})', 6)} AS m{c}" for c in "gdk")
    return (
        upto()
        + f""", pt AS (SELECT brand_name, year_month, period_type, region_name AS entity, growth_py_sales / 10.0::DOUBLE AS g,
    mshare_deviation / 1.0::DOUBLE AS d, rank_sales_eur / 25.0::DOUBLE AS k FROM region_metrics
  WHERE growth_py_sales IS NOT NULL AND mshare_deviation IS NOT NULL AND rank_sales_eur IS NOT NULL),
pr AS (SELECT a.*, b.g AS bg, b.d AS bd, b.k AS bk, {r(d, 9)} AS d2, b.entity AS peer
  FROM pt a JOIN pt b USING (brand_name, year_month, period_type) WHERE a.entity <> b.entity),
nn AS (SELECT * FROM pr
  QUALIFY row_number() OVER (PARTITION BY brand_name, year_month, period_type, entity ORDER BY d2, peer) <= 5),
ag AS (SELECT brand_name, year_month, period_type, entity, g, d, k, {med}, sum(d2) AS s, count(*) AS neighbours FROM nn GROUP BY ALL)
SELECT brand_name, year_month, period_type, entity, neighbours, {r(f"sqrt({r('s', 6)} / neighbours)", 4)} AS distance,
  ({off}) AS metrics_off, ({off}) >= 2 AS outlier FROM ag"""
    )


def _clusters(k: int = 4, steps: int = 8) -> str:
    """Lloyd steps as one stage each, and the least of all ways to match the centres of two months."""
    from itertools import permutations

    key, axes = "brand_name, year_month, period_type", "gdk"
    names = ", ".join(f"c{j}{a}" for j in range(k) for a in axes)

    def away(x, y):
        return " + ".join(f"({x(a)} - {y(a)})::DOUBLE * ({x(a)} - {y(a)})::DOUBLE" for a in axes)

    def near(source):
        least = ", ".join(f"{{'d': {away(lambda a: f'pt.{a}', lambda a, j=j: f'{source}.c{j}{a}')}, 'j': {j}}}" for j in range(k))
        return f"list_min([{least}]).j"

    first = ", ".join(f"min({a}) + ((max({a}) - min({a})) * {2 * j + 1}) // {2 * k} AS c{j}{a}" for j in range(k) for a in axes)
    stages = [f"k0 AS (SELECT {key}, {first} FROM pt GROUP BY ALL)"]
    for t in range(steps):
        moved = ", ".join(
            f"CASE WHEN count(*) FILTER (j = {j}) > 0 THEN (sum({a}) FILTER (j = {j}))::BIGINT // count(*) FILTER (j = {j}) ELSE any_value(c{j}{a}) END AS c{j}{a}"
            for j in range(k)
            for a in axes
        )
        stages.append(f"k{t + 1} AS (SELECT {key}, {moved} FROM (SELECT pt.*, {near(f'k{t}')} AS j, {names} FROM pt JOIN k{t} USING ({key})) GROUP BY ALL)")
    last = f"k{steps}"
    ways = ", ".join(
        "{'cost': " + " + ".join(f"({away(lambda a, i=i: f'p.c{i}{a}', lambda a, j=j: f'n.c{j}{a}')})" for i, j in enumerate(way))
        + f", 'way': {list(way)}}}"
        for way in permutations(range(k))
    )
    high = " || ".join(
        f"CASE WHEN [{', '.join(f'c{j}{a}' for j in range(k))}][j + 1] * {k} >= {' + '.join(f'c{j}{a}' for j in range(k))} THEN 'High' ELSE 'Low' END || '{title}'"
        for a, title in (("g", "Growth"), ("k", "Rank"))
    )
    return (
        upto()
        + f""", pt AS (SELECT {key}, region_name AS entity, round_even(growth_py_sales / 10.0::DOUBLE * 10000, 0)::BIGINT AS g,
    round_even(mshare_deviation / 1.0::DOUBLE * 10000, 0)::BIGINT AS d, round_even(rank_sales_eur / 25.0::DOUBLE * 10000, 0)::BIGINT AS k
  FROM region_metrics WHERE growth_py_sales IS NOT NULL AND mshare_deviation IS NOT NULL AND rank_sales_eur IS NOT NULL),
{", ".join(stages)},
mo AS (SELECT *, lag(year_month) OVER (PARTITION BY brand_name, period_type ORDER BY year_month) AS before FROM {last}),
wy AS (SELECT n.brand_name, n.year_month, n.period_type, list_min([{ways}]).way AS way FROM mo n
  JOIN {last} p ON p.brand_name = n.brand_name AND p.period_type = n.period_type AND p.year_month = n.before),
pl AS (SELECT pt.*, {near(last)} AS j, {names} FROM pt JOIN {last} USING ({key})),
nm AS (SELECT {key}, entity, j, {high} AS name FROM pl)
SELECT n.brand_name, n.year_month, n.period_type, n.entity, n.j::INT AS cluster_now, way[b.j + 1]::INT AS cluster_before,
  n.name AS name_now, b.name AS name_before, way[b.j + 1] <> n.j AS changed, CASE WHEN way[b.j + 1] <> n.j THEN 'high' END AS strength
FROM nm n JOIN mo USING ({key}) JOIN wy USING ({key})
JOIN nm b ON b.brand_name = n.brand_name AND b.period_type = n.period_type AND b.entity = n.entity AND b.year_month = mo.before"""
    )


def sql() -> dict[str, str]:
    all_ = market()
    regions = upto()
    peers = "(PARTITION BY year_month, brand_name, period_type)"
    w = f"(PARTITION BY {RKEY}, period_type ORDER BY year_month)"
    return {
        "market_growth": all_ + f"SELECT {KEY}, own_growth, market_growth FROM ms",
        "share_momentum": all_ + f"SELECT {KEY}, market_share, share_momentum FROM ms",
        "competitor_growth": all_ + f"SELECT {KEY}, competitor_growth FROM ms",
        "market_growth_deviation": all_ + f"SELECT {KEY}, market_growth, market_growth_deviation FROM ms",
        "competitor_segments": with_stages(LINES)
        + rivals()
        + f"""SELECT year_month, period_type, franchise, region_name, territory_name, brand_name AS competitor,
  own_s::DOUBLE AS sales_eur, {r(share("own_s", "tot_s"), 2)} AS competitor_share,
  {growth("own_s", "own_py")} AS competitor_growth FROM rl""",
        "market_matrix": all_
        + f""", mx AS (SELECT *, CASE WHEN market_growth > 1 THEN 'expanding' WHEN market_growth < -1 THEN 'contracting'
    WHEN market_growth IS NOT NULL THEN 'stable' END AS pie,
  CASE WHEN share_momentum > 1 THEN 'gaining' WHEN share_momentum < -1 THEN 'losing'
    WHEN share_momentum IS NOT NULL THEN 'holding' END AS slice FROM ms)
SELECT {KEY}, market_growth, share_momentum, pie, slice, CASE pie || '/' || slice
  WHEN 'expanding/gaining' THEN 'outgrowing' WHEN 'expanding/holding' THEN 'riding_the_tide'
  WHEN 'expanding/losing' THEN 'underperforming_hot_market' WHEN 'stable/gaining' THEN 'taking_share'
  WHEN 'stable/holding' THEN 'dormant' WHEN 'stable/losing' THEN 'losing_share'
  WHEN 'contracting/gaining' THEN 'counter_cyclical' WHEN 'contracting/holding' THEN 'sinking_with_market'
  WHEN 'contracting/losing' THEN 'double_hit' END AS archetype FROM mx""",
        "attribution": all_
        + rivals()
        + f""", top AS (SELECT year_month, period_type, franchise, region_name, brand_name, own_s - own_py AS change FROM rl
  WHERE own_s - own_py IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY year_month, period_type, franchise, region_name
    ORDER BY own_s - own_py DESC, brand_name DESC) = 1)
SELECT {KEY}, territory_name, (own_py - own_s)::DOUBLE AS lost, own_growth, competitor_growth,
  CASE WHEN competitor_growth > 1 THEN 'competitive_takeover' WHEN competitor_growth < -1 THEN 'market_contraction'
    WHEN competitor_growth IS NOT NULL THEN 'outflow_or_demand_loss' END AS verdict,
  t.brand_name AS top_competitor, t.change::DOUBLE AS top_change
FROM ms LEFT JOIN top t USING (year_month, period_type, franchise, region_name) WHERE own_s < own_py""",
        "displacement": all_
        + f""", mv AS (SELECT {KEY}, (tot_u - tot_u_py)::DOUBLE AS delta FROM ml WHERE tot_u - tot_u_py <> 0),
up AS (SELECT year_month, period_type, franchise, sum(delta) AS risen FROM mv WHERE delta > 0 GROUP BY ALL),
best AS (SELECT * FROM mv WHERE delta > 0 QUALIFY row_number() OVER (
  PARTITION BY year_month, period_type, franchise ORDER BY delta DESC, region_name DESC) = 1),
hit AS (SELECT a.*, coalesce(u.risen, 0.0::DOUBLE) AS r, b.region_name AS dest, b.delta AS rise,
    abs(-a.delta - coalesce(u.risen, 0.0::DOUBLE)) <= 0.2::DOUBLE * -a.delta AS hit
  FROM mv a LEFT JOIN up u USING (year_month, period_type, franchise)
  LEFT JOIN best b ON b.year_month = a.year_month AND b.period_type = a.period_type AND b.franchise = a.franchise
  WHERE a.delta < 0)
SELECT {KEY}, -delta AS lost, r AS risen_elsewhere, CASE WHEN hit THEN dest END AS destination_region,
  CASE WHEN hit THEN rise END AS destination_rise,
  CASE WHEN hit THEN 'displaced_volume' ELSE 'true_demand_loss' END AS diagnosis FROM hit""",
        "rule_findings": regions
        + f""", f0 AS (SELECT *, coalesce(growth_vs_fcst_eur < 0, false) AS miss,
    coalesce(rank_sales_eur >= 80 AND growth_py_sales <
      {r(f"median(growth_py_sales) OVER {peers}", 6)} - 10, false) AS behind,
    coalesce(rank_sales_eur - lag(rank_sales_eur) OVER {w} < -10, false) AS fall FROM region_metrics),
f1 AS (SELECT *, coalesce(lag(miss, 1) OVER {w}, false) AS miss1, coalesce(lag(miss, 2) OVER {w}, false) AS miss2,
    coalesce(lag(behind) OVER {w}, false) AS behind1, coalesce(lag(fall) OVER {w}, false) AS fall1 FROM f0)
SELECT year_month, period_type, brand_name, region_name, 'ConsecutiveForecastMiss' AS finding_type,
  CASE WHEN miss2 THEN 'high' ELSE 'moderate' END AS strength FROM f1 WHERE miss AND miss1 AND period_type = 'MAT'
UNION ALL SELECT year_month, period_type, brand_name, region_name, 'RapidDeteriorationTrend', 'high' FROM f1
WHERE fall AND fall1
UNION ALL SELECT year_month, period_type, brand_name, region_name, 'BigRegionUnderperformance', 'critical' FROM f1
WHERE behind AND behind1""",
        "peer_gap": regions + "," + gaps("gg", "growth_py_sales") + " SELECT * FROM gg",
        "gap_status": regions
        + ","
        + gaps("gg", "growth_py_sales")
        + ","
        + gaps("gp", "mshare_deviation")
        + f"""SELECT 'growth' AS kind, year_month, period_type, brand_name, region_name, gap, movement,
  CASE WHEN abs(gap) >= 15 THEN 'Exceptional' WHEN abs(gap) >= 10 THEN 'Strong' WHEN abs(gap) >= 5 THEN 'Moderate'
    WHEN gap IS NOT NULL THEN 'Weak' END AS size_class, {status(GROWTH_ROWS)} AS status FROM gg
UNION ALL SELECT 'position', year_month, period_type, brand_name, region_name, gap, movement,
  CASE WHEN abs(gap) >= 1 THEN 'Significant' WHEN abs(gap) >= 0.5 THEN 'Moderate'
    WHEN gap IS NOT NULL THEN 'Aligned' END, {status(POSITION_ROWS)} FROM gp""",
        "metrics_tall": upto(("region", "territory", "national"))
        + " UNION ALL ".join(
            f"SELECT '{g}' AS grain, year_month, period_type, brand_name, franchise, {geo}, "
            f"'{m}' AS metric_type, {m}::DOUBLE AS value, '{u}' AS unit FROM {g}_metrics WHERE {m} IS NOT NULL"
            for g, geo in (
                ("region", "region_name, territory_id, territory_name"),
                ("territory", "NULL::VARCHAR AS region_name, territory_id, territory_name"),
                ("national", "NULL::VARCHAR AS region_name, NULL::VARCHAR AS territory_id, NULL::VARCHAR AS territory_name"),
            )
            for m, u in TALL.items()
        ),
        "knn_outliers": _knn(),
        "cluster_change": _clusters(),
    }
