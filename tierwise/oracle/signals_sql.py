"""Oracle SQL of tier 3."""

from __future__ import annotations

from tierwise.oracle.stages import LINES, r, upto, with_stages

LADDERS = {
    "position": (0.5, 1.0, 2.0),
    "growth": (5.0, 10.0, 15.0),
    "territory_position": (0.15, 0.3, 0.6),
    "territory_growth": (2.5, 5.0, 7.5),
}
SIGNALS = [
    ("mshare_deviation_mat", "position", "region", "mshare_deviation"),
    ("growth_deviation_mat", "growth", "region", "growth_deviation"),
    ("growth_py_sales_mat", "growth", "region", "growth_py_sales"),
    ("territory_mshare_deviation_mat", "territory_position", "territory", "mshare_deviation"),
    ("territory_growth_deviation_mat", "territory_growth", "territory", "growth_deviation"),
    ("territory_growth_py_sales_mat", "territory_growth", "territory", "growth_py_sales"),
]
PAIR = "mshare_deviation_mat+growth_deviation_mat"
ASOF = "(SELECT max(year_month) FROM region_metrics)"
REGION = upto(("region",), ("MAT",))
BOTH = upto(("region", "territory"), ("MAT",))


def level(kind: str, i: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in LADDERS.items())
    return f"CASE {kind} {whens} END"


def path(cols: list[str]) -> tuple[str, str]:
    v = " + ".join(f"abs({b} - {a})" for a, b in zip(cols, cols[1:]))
    return r(f"({v})", 6), r(f"({cols[-1]} - {cols[0]})", 6)


def scored(src: str, cols: list[str], kind: str, better: str = "true", p: str = "") -> str:
    """SELECT with V and D of a series as {p}v6 and {p}d6, and the strength columns."""
    v, d = path(cols)
    loud, moderate = level(kind, 1), level(kind, 0)
    return f"""SELECT *, {r(f"{p}v6", 3)} AS {p}magnitude, {r(f"{p}d6", 3)} AS {p}net,
      {r(f"{p}rho", 3)} AS {p}coherence, {r(f"{p}d6 * abs({p}rho)", 3)} AS {p}signed_strength,
      CASE WHEN {p}d6 = 0 THEN 'flat' WHEN ({p}d6 > 0) = {better} THEN 'improving' ELSE 'deteriorating' END
        AS {p}direction,
      CASE WHEN {p}v6 < {moderate} THEN 'quiet'
           WHEN {p}v6 >= {loud} AND abs({p}rho) >= 0.6::DOUBLE THEN 'trend'
           WHEN {p}v6 >= {loud} AND abs({p}rho) < 0.3::DOUBLE THEN 'unstable' ELSE 'mixed' END AS {p}shape
    FROM (SELECT *, CASE WHEN {p}v6 = 0 THEN 0.0::DOUBLE ELSE {p}d6 / {p}v6 END AS {p}rho
          FROM (SELECT *, {v} AS {p}v6, {d} AS {p}d6 FROM {src}))"""


def lagged(table: str, metric: str, keys: str, n: int = 3, prefix: str = "m", more: str = "") -> str:
    w = f"(PARTITION BY {keys} ORDER BY year_month)"
    lags = ", ".join(f"lag({metric}, {k}) OVER {w} AS {prefix}{k}" for k in range(1, n + 1))
    return f"SELECT *, {metric} AS {prefix}0, {lags} {more} FROM {table}"


RKEY = "brand_name, region_name"
M4 = ["m3", "m2", "m1", "m0"]


def asof_scores(metric: str, kind: str) -> str:
    return REGION + (
        f", lg AS ({lagged('region_metrics', metric, RKEY)}),"
        f" now AS (SELECT * FROM lg WHERE year_month = {ASOF} AND m3 IS NOT NULL),"
        f" sc AS ({scored('now', M4, repr(kind))}) "
    )


def relevance(kind: str, period: str = "MAT") -> str:
    horizon = {"MAT": 4, "YTD": 3, "RollQ": 2, "Month": 1}[period]
    mod, loud, very = (f"{x}::DOUBLE" for x in LADDERS[kind])
    return f"""materiality, loudness, {horizon} AS horizon, materiality * loudness * {horizon} AS score,
  CASE WHEN materiality * loudness * {horizon} >= 48 THEN 'critical'
       WHEN materiality * loudness * {horizon} >= 24 THEN 'high'
       WHEN materiality * loudness * {horizon} >= 8 THEN 'moderate' ELSE 'low' END AS band
  FROM (SELECT *, rank_sales_eur AS mat_rank,
    CASE WHEN rank_sales_eur >= 90 THEN 4 WHEN rank_sales_eur >= 75 THEN 3
         WHEN rank_sales_eur >= 50 THEN 2 ELSE 1 END AS materiality,
    CASE WHEN magnitude >= {very} THEN 4 WHEN magnitude >= {loud} THEN 3
         WHEN magnitude >= {mod} THEN 2 ELSE 1 END AS loudness,
    CASE WHEN abs(coherence) >= 0.6::DOUBLE THEN 'consistent'
         WHEN abs(coherence) >= 0.3::DOUBLE THEN 'mixed' ELSE 'oscillating' END AS consistency FROM sc)"""


def points(cols: list[str], dp: int = 2) -> str:
    return ", ".join(f"{r(c, dp)} AS {c}" for c in cols)


def generic(src: str, seg: str, entity: str, metric: str, n: int, kind: str, extra: str = "") -> str:
    w = f"(PARTITION BY {seg}, {entity} ORDER BY year_month)"
    lags = ", ".join(f"(lag({metric}, {k}) OVER {w})::DOUBLE AS v{k}" for k in range(1, n + 1))
    ok = " AND ".join(f"v{k} IS NOT NULL" for k in range(n + 1))
    cols = [f"v{k}" for k in range(n, -1, -1)]
    return f"""gl AS (SELECT *, {metric}::DOUBLE AS v0, {lags},
    max(year_month) OVER (PARTITION BY {seg}) AS "asof" FROM {src}),
  gn AS (SELECT * FROM gl WHERE year_month = "asof" AND {ok}),
  gs AS ({scored("gn", cols, repr(kind))}) """


STRENGTH = "magnitude, net, coherence, signed_strength, direction, shape"


def stack(ids: list[str] | None = None) -> str:
    wanted = [s for s in SIGNALS if ids is None or s[0] in ids]
    ent = {"region": "region_name", "territory": "territory_name"}
    return "st AS (" + " UNION ALL ".join(
        f"SELECT '{i}' AS signal_id, '{k}' AS kind, true AS better, '{g}' AS level, brand_name, "
        f"{ent[g]} AS entity, year_month, rank_sales_eur AS rank, {m} AS value FROM {g}_metrics"
        for i, k, g, m in wanted
    ) + ")"


def wins() -> str:
    v, _ = path(M4)
    return (
        f"wl AS ({lagged('st', 'value', 'signal_id, brand_name, entity')}),\n"
        f"wins AS (SELECT *, {v} AS v FROM wl "
        "WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL)"
    )


def analysis(ids: list[str] | None) -> str:
    with_ = BOTH if ids is None else REGION
    sigma = "' (≈' || CAST(round_even(vs_self, 0) AS BIGINT) || 'σ above its own normal)'"
    return (
        with_
        + ", "
        + stack(ids)
        + ", "
        + wins()
        + f""",
past AS (SELECT signal_id, brand_name, entity, count(*) AS k, {r("median(v)", 6)} AS med
  FROM wins WHERE year_month < {ASOF} GROUP BY ALL),
mads AS (SELECT w.signal_id, w.brand_name, w.entity, {r("median(abs(w.v - p.med))", 6)} AS mad
  FROM wins w JOIN past p USING (signal_id, brand_name, entity) WHERE w.year_month < {ASOF} GROUP BY ALL),
cur AS (SELECT w.*,
    {r('''(count(*) OVER (PARTITION BY signal_id, brand_name ORDER BY v RANGE UNBOUNDED PRECEDING))::DOUBLE
      / (count(*) OVER (PARTITION BY signal_id, brand_name))::DOUBLE''', 3)} AS vs_peers
  FROM wins w WHERE year_month = {ASOF}),
own AS (SELECT c.*, CASE WHEN p.k >= 4 THEN
      {r("CASE WHEN mad > 0 THEN (v - med) / mad WHEN v <= med THEN 0.0::DOUBLE ELSE 6.0::DOUBLE END", 2)}
    END AS vs_self
  FROM cur c LEFT JOIN past p USING (signal_id, brand_name, entity)
  LEFT JOIN mads USING (signal_id, brand_name, entity)),
sco AS ({scored("own", M4, "kind", "better")}),
tagged AS (SELECT *,
    CASE WHEN vs_peers >= 0.9::DOUBLE AND coalesce(vs_self >= 2, false) THEN 'eruption'
         WHEN vs_peers >= 0.9::DOUBLE THEN 'chronic'
         WHEN coalesce(vs_self >= 2, false) THEN 'stirring' ELSE 'quiet' END AS tag FROM sco),
an AS (SELECT signal_id, level, brand_name, entity, rank, {points(M4)}, {r("v", 3)} AS loudness,
    net AS net_change, coherence AS ker, shape, direction, vs_peers, vs_self, tag,
    CASE shape WHEN 'unstable' THEN 'Swinging hard with no clear net direction'
      WHEN 'quiet' THEN 'Little net movement'
      ELSE upper(direction[1]) || substr(direction, 2) || ' on ' ||
           CASE shape WHEN 'trend' THEN 'a clean directional move' ELSE 'a partial-direction move' END END
    || CASE tag WHEN 'eruption' THEN ' — loud vs peers and a break from its own calm history'
                WHEN 'chronic' THEN ' — loud vs peers but typical for this region'
                WHEN 'stirring' THEN ' — unusual for this region, not yet loud vs peers' ELSE '' END
    || CASE WHEN tag IN ('eruption', 'stirring') THEN {sigma} ELSE '' END || '.' AS read
  FROM tagged)
"""
    )


def scale_ctes() -> str:
    return f"""
deltas AS (SELECT signal_id, {r("value - lag(value) OVER (PARTITION BY signal_id, brand_name, entity ORDER BY year_month)", 6)} AS d
  FROM st WHERE value IS NOT NULL),
dmed AS (SELECT signal_id, count(d) AS steps, {r("median(d)", 6)} AS med,
    {r("stddev_pop(d)", 6)} AS dev FROM deltas WHERE d IS NOT NULL GROUP BY ALL),
dmad AS (SELECT signal_id, {r(f"median({r('abs(d - med)', 6)})", 6)} AS mad
  FROM deltas JOIN dmed USING (signal_id) WHERE d IS NOT NULL GROUP BY ALL),
scales AS (SELECT signal_id, steps::BIGINT AS steps, med, mad,
    coalesce(nullif(mad, 0), nullif(dev, 0), 1.0::DOUBLE) AS scale FROM dmed JOIN dmad USING (signal_id))"""


def combos(list_: list[tuple[str, ...]], weights: list[float] | None = None) -> str:
    rows = []
    for ids in list_:
        for k, i in enumerate(ids):
            f = 1.0 if weights is None else weights[k] / sum(weights) * len(ids)
            rows.append(f"('{'+'.join(ids)}', '{i}', {k}, {len(ids)}, {f!r}::DOUBLE)")
    return f"combos(combo_id, signal_id, position, size, factor) AS (VALUES {', '.join(rows)})"


def composite(list_, weights=None) -> str:
    ids = [i for c in list_ for i in c]
    with_ = BOTH if any(i.startswith("territory") for i in ids) else REGION
    return (
        with_
        + ", "
        + ", ".join([stack(ids), wins(), scale_ctes(), combos(list_, weights)])
        + f""",
zs AS (SELECT w.*, combo_id, position, size, (m2 - m3) / scale * factor AS w1, (m1 - m2) / scale * factor AS w2,
    (m0 - m1) / scale * factor AS w3,
    count(*) OVER (PARTITION BY combo_id, brand_name, entity) AS have
  FROM wins w JOIN scales USING (signal_id) JOIN combos USING (signal_id) WHERE year_month = {ASOF}),
contrib AS (SELECT *, {r("abs(w1) + abs(w2) + abs(w3)", 3)} AS loudness, {r("m0 - m3", 2)} AS net,
    {r("w1 + w2 + w3", 9)} AS good FROM zs WHERE have = size),
contrib2 AS (SELECT *, {r("good", 2)} AS znet,
    CASE WHEN good = 0 THEN 'flat' WHEN good > 0 THEN 'improving' ELSE 'deteriorating' END AS direction,
    row_number() OVER (PARTITION BY combo_id, brand_name, entity ORDER BY loudness DESC, position) AS pick
  FROM contrib),
summed AS (SELECT level, combo_id, brand_name, entity,
    {r("sqrt(sum(w1 * w1)) + sqrt(sum(w2 * w2)) + sqrt(sum(w3 * w3))", 9)} AS path,
    {r("sum(good)", 9)} AS g, sqrt(sum(good * good)) AS reach,
    count(DISTINCT CASE WHEN direction <> 'flat' THEN direction END) AS ways,
    max(CASE WHEN pick = 1 THEN signal_id END) AS main_driver,
    max(CASE WHEN pick = 1 THEN direction END) AS main_direction, min(znet) AS solo_worst
  FROM contrib2 GROUP BY ALL),
crow AS (SELECT *, {r("path", 3)} AS composite_loudness, {r("g", 3)} AS composite_net,
    {r(f"CASE WHEN path > 0 THEN sign({r('g', 3)}) * reach / path ELSE 0.0::DOUBLE END", 3)} AS composite_ker,
    'Loud composite (' || CAST({r("path", 1)} AS DECIMAL(20,1)) || 'σ), ' ||
    CASE WHEN ways <= 1 THEN 'reinforcing — components move the same way'
         ELSE 'divergent — components pull opposite ways' END ||
    '; driven mainly by ' || main_driver || ' (' || main_direction || ').' AS read
  FROM summed)
"""
    )


def scorecard(list_) -> str:
    idx = "least(k - 1, greatest(0, CAST(floor(k * {f}) AS INTEGER))) + 1"
    hi, lo = idx.format(f="0.95::DOUBLE"), idx.format(f="(1.0::DOUBLE - 0.95::DOUBLE)")

    def pick(place: str, col: str, i: str) -> str:
        return r(f"max(CASE WHEN {place} = {i} THEN {col} END)", 3)

    part = "PARTITION BY combo_id, brand_name ORDER BY"
    return (
        composite(list_)
        + f""", placed AS (SELECT *, count(*) OVER (PARTITION BY combo_id, brand_name) AS k,
    row_number() OVER ({part} composite_loudness, entity) AS pl,
    row_number() OVER ({part} composite_net, entity) AS pn,
    row_number() OVER ({part} composite_ker, entity) AS pk,
    row_number() OVER ({part} composite_loudness DESC, entity) AS pt FROM crow)
SELECT level, combo_id, brand_name, {r("min(solo_worst) - min(composite_net)", 3)} AS synergy,
  {pick("pl", "composite_loudness", hi)} AS loudness_p95,
  {r("sum(composite_net::DECIMAL(28,3))::DOUBLE", 3)} AS net_total,
  {pick("pn", "composite_net", hi)} AS net_best, {pick("pn", "composite_net", lo)} AS net_worst,
  {pick("pk", "composite_ker", hi)} AS ker_best, {pick("pk", "composite_ker", lo)} AS ker_worst,
  max(composite_loudness) AS max_loudness,
  concat_ws(' | ', max(CASE WHEN pt = 1 THEN entity END), max(CASE WHEN pt = 2 THEN entity END),
    max(CASE WHEN pt = 3 THEN entity END)) AS top_entities
FROM placed GROUP BY level, combo_id, brand_name"""
    )


def _all_combos() -> list[tuple[str, ...]]:
    out = []
    for g in ("region", "territory"):
        a, b, c = (s[0] for s in SIGNALS if s[2] == g)
        out += [(a, b), (a, c), (b, c), (a, b, c)]
    return out


def sql() -> dict[str, str]:
    pair = [tuple(PAIR.split("+"))]
    regional = [s[0] for s in SIGNALS if s[2] == "region"]
    trail = {
        "x": ("mshare_deviation", 2),
        "y": ("growth_deviation", 2),
        "size": ("sales_eur::DOUBLE", 0),
        "rank": ("rank_sales_eur", None),
        "share": ("market_share", 2),
        "units": ("units::DOUBLE", 0),
        "growth": ("growth_py_sales", 2),
    }
    w = f"(PARTITION BY {RKEY} ORDER BY year_month)"
    trail_lags = ", ".join(
        f"(lag({c}, {k}) OVER {w}) AS {p}{k}" if k else f"{c} AS {p}0"
        for p, (c, _) in trail.items()
        for k in (3, 2, 1, 0)
    )
    trail_out = ", ".join(
        (f"{p}{k}" if dp is None else f"{r(f'{p}{k}', dp)} AS {p}{k}")
        for p, (_, dp) in trail.items()
        for k in (3, 2, 1, 0)
    )
    return {
        "latest_asof": with_stages(LINES)
        + "SELECT brand_name, max(year_month) AS asof FROM sales WHERE is_own_brand = 1 GROUP BY 1",
        "segment_values": REGION
        + """, f AS (SELECT * FROM region_metrics WHERE franchise IN ('F1', 'F2', 'F3')
  AND brand_name <> 'Brand#2' AND territory_id >= '1')
SELECT DISTINCT 'brand_name' AS segment, brand_name AS value FROM f
UNION ALL SELECT DISTINCT 'territory_name', territory_name FROM f""",
        "filtered_signal": REGION
        + """, f AS (SELECT * FROM region_metrics WHERE franchise IN ('F1', 'F2', 'F3')
  AND brand_name <> 'Brand#2' AND territory_id >= '1'), """
        + generic("f", "brand_name, territory_name", "region_name", "market_share", 3, "position")
        + "SELECT brand_name, territory_name, region_name AS entity, \"asof\", mshare_deviation, v0 AS now, "
        f"v3, v2, v1, {STRENGTH} FROM gs",
        "generic_signal": with_stages(LINES)
        + ", f AS (SELECT * FROM sales WHERE is_own_brand = 1), "
        + generic("f", "brand_name", "region_name", "units", 3, "growth")
        + "SELECT brand_name, region_name AS entity, \"asof\", v0 AS now, v3, v2, v1, "
        "floor((v0 - v1) * 1000 + 0.5::DOUBLE) / 1000 + 0.0::DOUBLE AS delta_1m, "
        f"floor((v0 - v3) * 1000 + 0.5::DOUBLE) / 1000 + 0.0::DOUBLE AS delta_3m, {STRENGTH} FROM gs",
        "signal_trajectory": REGION
        + f", lg AS ({lagged('region_metrics', 'mshare_deviation', RKEY)}) "
        + "SELECT year_month, brand_name, region_name, m0 AS now, m1, m2, m3, m0 - m1 AS delta_1m, "
        "m0 - m3 AS delta_3m FROM lg",
        "signal_strength": asof_scores("growth_deviation", "growth")
        + f"SELECT brand_name, region_name, {STRENGTH} FROM sc",
        "signal_relevance": asof_scores("mshare_deviation", "position")
        + f"SELECT brand_name, region_name, mat_rank, magnitude, consistency, {relevance('position')}",
        "signal_report": asof_scores("mshare_deviation", "position")
        + "SELECT year_month, brand_name, franchise, region_name, territory_id, territory_name, mat_rank, "
        f"{r('m0', 2)} AS now, {points(['m3', 'm2', 'm1'])}, {r('m0 - m1', 2)} AS delta_1m, "
        f"{r('m0 - m3', 2)} AS delta_3m, {STRENGTH}, consistency, {relevance('position')}",
        "scatter": REGION
        + f"""SELECT brand_name, region_name, territory_name, {r("mshare_deviation", 2)} AS x,
  {r("growth_deviation", 2)} AS y, rank_sales_eur AS mat_rank FROM region_metrics
WHERE year_month = {ASOF} AND mshare_deviation IS NOT NULL AND growth_deviation IS NOT NULL""",
        "trails": REGION
        + f""", lg AS (SELECT brand_name, region_name, territory_name, year_month, {trail_lags}
  FROM region_metrics)
SELECT brand_name, region_name, territory_name, {trail_out} FROM lg
WHERE year_month = {ASOF} AND x3 IS NOT NULL AND y3 IS NOT NULL""",
        "signal_windows": REGION
        + ", "
        + stack(["mshare_deviation_mat"])
        + ", "
        + wins()
        + f" SELECT year_month, brand_name, entity, rank, {points(M4)}, {r('v', 3)} AS loudness FROM wins",
        "signal_slope": REGION
        + f", lg AS ({lagged('region_metrics', 'mshare_deviation', RKEY)}) "
        + f"""SELECT brand_name, region_name,
  {r(f"{r('m3 * -1.5::DOUBLE + m2 * -0.5::DOUBLE + m1 * 0.5::DOUBLE + m0 * 1.5::DOUBLE', 6)} / 5.0::DOUBLE", 4)}
    AS slope FROM lg WHERE year_month = {ASOF} AND m0 + m1 + m2 + m3 IS NOT NULL""",
        "step_scale": BOTH + ", " + stack() + ", " + scale_ctes() + " SELECT * FROM scales",
        "vs_self": analysis(["mshare_deviation_mat"])
        + "SELECT signal_id, brand_name, entity, loudness, vs_self FROM an",
        "vs_peers": analysis(["growth_deviation_mat"])
        + "SELECT signal_id, brand_name, entity, loudness, vs_peers FROM an",
        "loudness_tags": analysis(regional)
        + "SELECT signal_id, brand_name, entity, vs_peers, vs_self, tag FROM an",
        "signal_reads": analysis(regional) + "SELECT signal_id, brand_name, entity, read FROM an",
        "analyze_signal": analysis(["mshare_deviation_mat"]) + "SELECT * FROM an",
        "analyze_all": analysis(None) + "SELECT * FROM an",
        "composite": composite(pair, [0.6, 0.4])
        + "SELECT level, combo_id, brand_name, entity, composite_loudness, composite_net, composite_ker FROM crow",
        "composite_contrib": composite(pair)
        + "SELECT combo_id, signal_id, brand_name, entity, loudness, direction, net, znet, "
        f"{points(M4)} FROM contrib2",
        "composite_reads": composite(pair)
        + "SELECT combo_id, brand_name, entity, main_driver, read FROM crow",
        "composite_top": composite(pair)
        + """SELECT combo_id, brand_name, entity, composite_loudness, place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY combo_id, brand_name
      ORDER BY composite_loudness DESC, entity) AS INTEGER) AS place,
    greatest(1, floor(count(*) OVER (PARTITION BY combo_id, brand_name) * 0.05::DOUBLE)) AS keep FROM crow)
WHERE place <= keep""",
        "composite_scorecard": scorecard(pair),
        "composite_search": scorecard(_all_combos()),
    }
