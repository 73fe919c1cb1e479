"""Oracle SQL of tiers 4 and 5, readouts, sinks and sources."""

from __future__ import annotations

from tierwise.oracle.signals_sql import ASOF, REGION, RKEY, lagged, scored
from tierwise.oracle.stages import r, upto

QUADRANT = """CASE WHEN {m} < 0 AND {g} < 0 THEN 'losing_both' WHEN {g} < 0 THEN 'slipping'
  WHEN {m} < 0 THEN 'catching_up' ELSE 'star' END"""
LABEL = """CASE {k} WHEN 'losing_both' THEN 'Losing on both' WHEN 'slipping' THEN 'Slipping'
  WHEN 'catching_up' THEN 'Catching up' WHEN 'star' THEN 'Star' END"""
BAND = """CASE WHEN {s} >= 5 THEN 'critical' WHEN {s} >= 3 THEN 'high' WHEN {s} >= 2 THEN 'moderate'
  ELSE 'low' END"""


def lags(metric: str, p: str, n: int = 3) -> str:
    w = f"(PARTITION BY {RKEY} ORDER BY year_month)"
    return ", ".join([f"{metric} AS {p}0"] + [f"lag({metric}, {k}) OVER {w} AS {p}{k}" for k in range(1, n + 1)])


def cols(p: str) -> list[str]:
    return [f"{p}{k}" for k in (3, 2, 1, 0)]


def report() -> str:
    """CTEs ending in fd: one scored row per month, brand and region."""

    def sev(now: str, p: str, loud: float) -> str:
        return (
            f"(CASE WHEN {now} < 0 THEN 1 ELSE 0 END + CASE WHEN {p}net < -0.3::DOUBLE THEN 1 ELSE 0 END + "
            f"CASE WHEN {now} < 0 AND {p}net < -0.3::DOUBLE AND {p}magnitude >= {loud}::DOUBLE THEN 1 ELSE 0 END)"
        )

    w = f"(PARTITION BY {RKEY} ORDER BY year_month)"
    return (
        REGION
        + f""",
fl AS (SELECT *, {lags('mshare_deviation', 'ms')}, {lags('growth_deviation', 'gr')} FROM region_metrics),
fm AS ({scored('fl', cols('ms'), "'position'", p='ms_')}),
fg AS ({scored('fm', cols('gr'), "'growth'", p='growth_')}),
fs AS (SELECT *, {sev('ms0', 'ms_', 1.0)} AS ms_sev, {sev('gr0', 'growth_', 10.0)} AS growth_sev,
    {QUADRANT.format(m='ms0', g='gr0')} AS finding_key,
    ms0 + ms1 + ms2 + ms3 + gr0 + gr1 + gr2 + gr3 IS NOT NULL AS whole FROM fg),
ft AS (SELECT *, ms_sev + growth_sev AS severity_score,
    CASE WHEN whole THEN finding_key = 'losing_both' AND ms_sev + growth_sev >= 3 END AS red FROM fs),
fr AS (SELECT *, coalesce(red, false) AS red0, coalesce(lag(red, 1) OVER {w}, false) AS red1,
    coalesce(lag(red, 2) OVER {w}, false) AS red2 FROM ft),
fd AS (SELECT *, {BAND.format(s='severity_score')} AS severity_band, {LABEL.format(k='finding_key')} AS finding_label,
    CASE WHEN red0 AND red1 AND red2 THEN 3 WHEN red0 AND red1 THEN 2 WHEN red0 THEN 1 ELSE 0 END AS months_red,
    red1 AND NOT red0 AS improved, red0 AND red1 AND red2 AS escalate, {r('ms0', 2)} AS ms_now,
    {r('gr0', 2)} AS growth_now, rank_sales_eur AS mat_rank FROM fr)
"""
    )


AXES = {
    "share": ("mshare_deviation", "position", 1.0),
    "growth": ("growth_deviation", "growth", 10.0),
    "sales": ("growth_py_sales", "growth", 10.0),
}


def classified(names: list[str], axes: dict = AXES) -> str:
    """CTEs ending in cf: generic axis readings with sides and severities."""
    src, ctes = "cl", []
    all_lags = ", ".join(lags(axes[n][0], f"{n}_v") for n in names)
    ok = " + ".join(f"{n}_v{k}" for n in names for k in range(4))
    ctes.append(f"cl0 AS (SELECT *, {all_lags} FROM region_metrics)")
    ctes.append(f"cl AS (SELECT * FROM cl0 WHERE year_month = {ASOF} AND {ok} IS NOT NULL)")
    for n in names:
        ctes.append(f"c_{n} AS ({scored(src, cols(f'{n}_v'), repr(axes[n][1]), p=f'{n}_')})")
        src = f"c_{n}"
    sevs = ", ".join(
        f"""least(3, CASE WHEN {n}_v0 < 0 THEN 1 ELSE 0 END + CASE WHEN {n}_net < -0.3::DOUBLE THEN 1 ELSE 0 END
          + CASE WHEN {n}_magnitude >= {axes[n][2]}::DOUBLE THEN 1 ELSE 0 END) AS {n}_sev,
        CASE WHEN {n}_v0 >= 0 THEN 'good' ELSE 'bad' END AS {n}_side""".replace("\n", " ")
        for n in names
    )
    ctes.append(f"cs AS (SELECT *, region_name AS entity, rank_sales_eur AS mat_rank, {sevs} FROM {src})")
    total = " + ".join(f"{n}_sev" for n in names)
    ctes.append(f"cf AS (SELECT *, {total} AS severity_score, {BAND.format(s=f'({total})')} AS severity_band FROM cs)")
    return ", " + ",\n".join(ctes) + "\n"


RULES = """CASE WHEN share_side = 'bad' AND growth_side = 'bad' THEN 'losing_both'
  WHEN share_side = 'good' AND growth_side = 'bad' THEN 'slipping'
  WHEN share_side = 'bad' AND growth_side = 'good' THEN 'catching_up' ELSE 'unclassified' END"""
RULE_LABEL = """CASE finding_key WHEN 'losing_both' THEN 'Losing on both' WHEN 'slipping' THEN 'Slipping'
  WHEN 'catching_up' THEN 'Catching up' ELSE 'Unclassified' END"""


def num(x: str) -> str:
    half_up = f"floor({x} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE + 0.0::DOUBLE"
    return f"regexp_replace(CAST(CAST({half_up} AS DECIMAL(28,2)) AS VARCHAR), '\\.?0+$', '')"


def insight() -> str:
    """CTEs ending in it: one row per framing and finding."""
    mem = report().replace(REGION, "", 1)
    return (
        REGION
        + mem
        + classified(["share", "growth"])
        + f""", ck AS (SELECT *, {RULES} AS finding_key FROM cf),
cm AS (SELECT ck.*, {RULE_LABEL} AS finding_label, coalesce(m.months_red, 0) AS months_red FROM ck
  LEFT JOIN (SELECT brand_name, region_name, months_red FROM fd WHERE year_month = {ASOF}) m
  USING (brand_name, region_name)),
it AS (
  SELECT 'manager_losing' AS framing_id, 'sales_manager' AS persona, *,
    severity_band = 'critical' OR mat_rank >= 75 AS surfaces,
    entity || ' (' || territory_name || ', rank ' || mat_rank || ') is losing on both axes: share gap ' ||
    {num('share_v0')} || ' pp after ' || {num('share_v3')} || ' pp, growth gap ' || {num('growth_v0')} ||
    ' pp. Red for ' || months_red || ' months [' || severity_band || '].' AS text
  FROM cm WHERE finding_key = 'losing_both'
  UNION ALL
  SELECT 'ceo_losing', 'ceo', *, severity_band = 'critical' AND NOT mat_rank < 40,
    finding_label || ': ' || entity || ' scores ' || severity_score || '; share path ' || share_shape ||
    ', net ' || {num('share_net')} || ', coherence ' || {num('share_coherence')} || '.'
  FROM cm WHERE finding_key = 'losing_both'
  UNION ALL
  SELECT 'rep_slipping', 'sales_rep', *, NOT severity_score < 2,
    entity || ': growth gap ' || {num('growth_v0')} || ' pp, path length ' || {num('growth_magnitude')} ||
    ' pp. Ask {{{{UNKNOWN:owner}}}}.'
  FROM cm WHERE finding_key = 'slipping')
"""
    )


def as_json(fields: list[tuple[str, str, bool]]) -> str:
    """A JSON object as text from (name, SQL value, quoted)."""
    parts = [
        f"""'"{n}":"' || {v} || '"'""" if quoted else f"""'"{n}":' || {v}""" for n, v, quoted in fields
    ]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def number(x: str) -> str:
    return f"CAST(({x})::DOUBLE AS VARCHAR)"


def report_evidence() -> str:
    fields = []
    for p, name in (("ms", "ms"), ("gr", "growth")):
        series = " || ',' || ".join(number(r(f"{p}{k}", 2)) for k in (3, 2, 1, 0))
        fields.append((f"{name}_series", f"'[' || {series} || ']'", False))
        scores = [(n, number(f"{name}_{n}"), False) for n in ("magnitude", "net", "coherence")]
        scores += [("direction", f"{name}_direction", True), ("signed_strength", number(f"{name}_signed_strength"), False)]
        fields.append((f"{name}_strength", as_json([*scores, ("shape", f"{name}_shape", True)]), False))
    return as_json(fields)


def axes_evidence(names: dict[str, str]) -> str:
    """names: output name -> prefix of its columns."""
    fields = []
    for name, p in names.items():
        one = [("now", number(f"{p}_v0"), False), ("oldest", number(f"{p}_v3"), False)]
        one += [(n, number(f"{p}_{n}"), False) for n in ("magnitude", "net", "coherence")]
        one += [("direction", f"{p}_direction", True), ("shape", f"{p}_shape", True), ("sev", f"CAST({p}_sev AS VARCHAR)", False)]
        fields.append((name, as_json(one), False))
    return as_json(fields)


PROMOTED = {"a": ("mshare_deviation", "position", 1.0), "b": ("growth_py_sales", "growth", 10.0)}
OCTANT_KEY = "share_side || '_' || growth_side || '_' || sales_side"


def stored() -> str:
    """A query of the rows of all three definitions in one catalog."""
    cols = "year_month, brand_name, region_name"
    axes = {"share": "share", "growth": "growth", "sales": "sales"}
    promoted = {"mshare_deviation_mat": "a", "growth_py_sales_mat": "b"}
    return f"""(SELECT * FROM ({report()} SELECT 'fnd_share_growth' AS finding_def_id, {cols}, finding_key, severity_score,
  {report_evidence()} AS axes_snapshot FROM fd WHERE whole)
UNION ALL SELECT * FROM ({REGION}{classified(["share", "growth", "sales"])} SELECT 'share_growth_sales', {cols},
  {OCTANT_KEY}, severity_score, {axes_evidence(axes)} FROM cf)
UNION ALL SELECT * FROM ({REGION}{classified(["a", "b"], PROMOTED)} SELECT 'promoted', {cols}, a_side || '_' || b_side,
  severity_score, {axes_evidence(promoted)} FROM cf))"""


def headline() -> str:
    return f"""{r('sales_eur::DOUBLE', 0)} AS mat_sales, {r('units::DOUBLE', 0)} AS units,
  {r('growth_py_sales', 1)} AS growth_py, {r('growth_pp_sales', 1)} AS growth_pp,
  {r('market_share', 1)} AS market_share, {r('growth_vs_fcst_eur', 1)} AS growth_vs_fcst"""


def signal_cols() -> str:
    ok = "m0 + m1 + m2 + m3 IS NOT NULL"
    names = ("magnitude", "net", "coherence", "signed_strength", "direction", "shape")
    pts = ", ".join(f"CASE WHEN {ok} THEN {r(f'm{k}', 2)} END AS m{k}" for k in (3, 2, 1, 0))
    return pts + ", " + ", ".join(f"CASE WHEN {ok} THEN signal_{n} END AS signal_{n}" for n in names)


def attainment(cut: str) -> str:
    return (
        upto(("territory",))
        + f""", tr AS (SELECT * FROM territory_metrics {cut}),
latest AS (SELECT max(year_month) AS ym FROM tr),
months AS (SELECT year_month, row_number() OVER (ORDER BY year_month DESC) AS k
  FROM (SELECT DISTINCT year_month FROM tr)),
cover AS (
  SELECT 'Month' AS period_type, year_month FROM months WHERE k <= 1
  UNION ALL SELECT 'RollQ', year_month FROM months WHERE k <= 3
  UNION ALL SELECT 'MAT', year_month FROM months WHERE k <= 12
  UNION ALL SELECT 'YTD', year_month FROM months, latest WHERE left(year_month, 4) = left(ym, 4)),
act AS (SELECT brand_name, period_type, sum(sales_eur) AS actual FROM tr, latest WHERE year_month = ym
  GROUP BY ALL HAVING sum(sales_eur) IS NOT NULL),
plan AS (SELECT a.brand_name, a.period_type, a.actual, sum(f.sales_eur) AS fcst, count(f.sales_eur) AS have,
    count(*) AS want
  FROM act a JOIN cover c USING (period_type)
  LEFT JOIN brand_forecast f ON f.brand_name = a.brand_name AND f.year_month = c.year_month GROUP BY ALL)
SELECT brand_name, period_type, {r('actual::DOUBLE', 0)} AS actual, {r('fcst::DOUBLE', 0)} AS fcst,
  {r('actual::DOUBLE / fcst::DOUBLE * 100.0::DOUBLE', 1)} AS pct
FROM plan WHERE have = want AND fcst <> 0"""
    )


def sql() -> dict[str, str]:
    all_grains = upto(("region", "territory", "national"))
    fcols = (
        "year_month, brand_name, region_name, territory_name, finding_key, finding_label, severity_score, "
        f"severity_band, ms_now, ms_sev, growth_now, growth_sev, {r('market_share', 1)} AS market_share, mat_rank, "
        "months_red, escalate, improved"
    )
    nat = upto(("national",), ("MAT",))
    ter = upto(("territory",), ("MAT",))
    nat_asof = ASOF.replace("region_metrics", "national_metrics")
    ter_asof = ASOF.replace("region_metrics", "territory_metrics")
    return {
        "write_metrics": all_grains
        + " UNION ALL ".join(
            f"SELECT '{g}_metrics' AS table_name, period_type, count(*) AS row_count, "
            f"count(market_share) AS known_shares, sum(sales_eur)::DOUBLE AS sales_eur FROM {g}_metrics GROUP BY ALL"
            for g in ("region", "territory", "national")
        ),
        "copy_report": REGION
        + """SELECT 'sales' AS table_name, count(*) AS rows_copied, count(*) - count(sales_eur) AS nulls FROM sales
UNION ALL SELECT 'forecast', count(*), count(*) - count(sales_eur) FROM brand_forecast
UNION ALL SELECT 'region_metrics_mat', count(*), count(*) - count(growth_vs_fcst_eur) FROM region_metrics""",
        "table_page": REGION
        + """, p AS (SELECT *, count(*) OVER () AS total FROM region_metrics
  WHERE brand_name = (SELECT min(brand_name) FROM region_metrics) AND territory_id = '0')
SELECT year_month, brand_name, region_name, units, sales_eur::DOUBLE AS sales_eur, market_share, total
FROM p ORDER BY year_month, region_name LIMIT 500 OFFSET 50""",
        "meta_profile": upto()
        + """SELECT brand_name, franchise, string_agg(DISTINCT period_type, ',' ORDER BY period_type) AS periods,
  max(year_month) AS latest_ym FROM region_metrics GROUP BY ALL""",
        "classify_findings": REGION
        + classified(["share", "growth"])
        + f""", ck AS (SELECT *, {RULES} AS finding_key FROM cf)
SELECT brand_name, entity, territory_name, finding_key, {RULE_LABEL} AS finding_label, severity_score,
  severity_band, mat_rank, share_sev, growth_sev, share_v0 AS share_now, growth_v0 AS growth_now, share_net,
  growth_net FROM ck""",
        "classify_octants": REGION
        + classified(["share", "growth", "sales"])
        + """SELECT brand_name, entity, territory_name,
  share_side || '_' || growth_side || '_' || sales_side AS finding_key,
  'share: ' || share_side || ', growth: ' || growth_side || ', sales: ' || sales_side AS finding_label,
  severity_score, severity_band, mat_rank, share_sev, growth_sev, sales_sev FROM cf""",
        "promoted_findings": REGION
        + classified(["a", "b"], PROMOTED)
        + "SELECT brand_name, entity, a_side || '_' || b_side AS finding_key, severity_score, severity_band FROM cf",
        "quadrant_findings": report()
        + f"""SELECT brand_name, region_name, finding_key, finding_label, ms_sev, growth_sev, severity_score,
  severity_band FROM fd WHERE whole AND year_month = {ASOF}""",
        "finding_memory": report()
        + "SELECT year_month, brand_name, region_name, red0 AS red_now, months_red, improved, escalate FROM fd",
        "find_findings": report() + f"SELECT {fcols} FROM fd WHERE whole AND year_month = {ASOF}",
        "finding_summary": report()
        + f""", keys(position, finding_key) AS (VALUES (0, 'losing_both'), (1, 'slipping'), (2, 'catching_up'),
  (3, 'star')), now AS (SELECT * FROM fd WHERE whole AND year_month = {ASOF})
SELECT b.brand_name, k.position, k.finding_key, {LABEL.format(k='k.finding_key')} AS finding_label,
  count(n.region_name) AS entities
FROM (SELECT DISTINCT brand_name FROM now) b CROSS JOIN keys k
LEFT JOIN now n ON n.brand_name = b.brand_name AND n.finding_key = k.finding_key GROUP BY ALL""",
        "recovered_entities": report()
        + """SELECT brand_name, region_name, territory_name, mat_rank FROM fd a WHERE improved AND NOT EXISTS (
  SELECT 1 FROM fd b WHERE b.whole AND b.brand_name = a.brand_name AND b.region_name = a.region_name
    AND b.year_month = a.year_month)""",
        "run_summary": f"""SELECT * FROM ({report()}, keys(finding_key) AS (VALUES ('losing_both'), ('slipping'),
  ('catching_up'), ('star')), now AS (SELECT * FROM fd WHERE whole AND year_month = {ASOF})
SELECT 'quadrants' AS definition, b.brand_name, k.finding_key, {LABEL.format(k='k.finding_key')} AS finding_label,
  count(n.region_name) AS entities FROM (SELECT DISTINCT brand_name FROM now) b CROSS JOIN keys k
LEFT JOIN now n ON n.brand_name = b.brand_name AND n.finding_key = k.finding_key GROUP BY ALL)
UNION ALL SELECT * FROM ({REGION}{classified(["share", "growth", "sales"])} SELECT 'octants', brand_name, {OCTANT_KEY},
  'share: ' || share_side || ', growth: ' || growth_side || ', sales: ' || sales_side, count(*) FROM cf GROUP BY ALL)""",
        "catalog_generic": f"""SELECT finding_def_id, brand_name, finding_key, count(*) AS entities,
  sum(severity_score)::BIGINT AS score, max(year_month) AS last_month FROM {stored()} GROUP BY ALL""",
        "finding_provenance": f"SELECT finding_def_id, year_month, brand_name, region_name, axes_snapshot FROM {stored()}",
        "catalog_append": report()
        + f""", c AS (SELECT count(*) FILTER (year_month < {ASOF}) AS a, count(*) AS b FROM fd WHERE whole)
SELECT 'months_before' AS run, a AS inserted, a AS skipped, a AS total_rows FROM c
UNION ALL SELECT 'all_months', b - a, b + a, b FROM c UNION ALL SELECT 'again', 0::BIGINT, 2 * b, b FROM c""",
        "catalog_upsert": report()
        + f"""SELECT year_month, brand_name, count(*) AS entities,
  sum(CASE WHEN year_month = {ASOF} THEN severity_score ELSE -1 END)::BIGINT AS score
FROM fd WHERE whole GROUP BY ALL""",
        "catalog_stats": report()
        + "SELECT count(*) AS total_rows, count(DISTINCT (brand_name, year_month)) AS periods FROM fd WHERE whole",
        "finding_history": report()
        + """SELECT year_month, brand_name, region_name, finding_key AS finding, severity_band, severity_score, ms_now,
  growth_now, mat_rank, months_red, escalate::INTEGER AS escalate, improved::INTEGER AS improved
FROM fd WHERE whole AND region_name = (SELECT min(n_name) FROM nation)""",
        "plan_attainment_latest": attainment(""),
        "plan_attainment": attainment(
            "WHERE year_month <= (SELECT max(year_month) FROM brand_forecast)"
        ),
        "national_summary": nat
        + f", lg AS ({lagged('national_metrics', 'market_share', 'brand_name')}), "
        + f"""now AS (SELECT * FROM lg WHERE year_month = {nat_asof}),
sc AS ({scored('now', ['m3', 'm2', 'm1', 'm0'], "'territory_position'", p='signal_')})
SELECT brand_name, year_month, {headline()}, {r('growth_py_sales - growth_vs_fcst_eur', 1)} AS national_fcst_growth,
  {signal_cols()} FROM sc""",
        "territory_readout": ter
        + f", lg AS ({lagged('territory_metrics', 'mshare_deviation', 'brand_name, territory_name')}), "
        + f"""now AS (SELECT * FROM lg WHERE year_month = {ter_asof}),
sc AS ({scored('now', ['m3', 'm2', 'm1', 'm0'], "'territory_position'", p='signal_')})
SELECT brand_name, territory_name, coalesce(region_count, 0) AS region_count, {headline()},
  {r('mshare_deviation', 2)} AS mshare_deviation, {signal_cols()}
FROM sc LEFT JOIN (SELECT territory_name, count(*) AS region_count FROM regions GROUP BY 1) USING (territory_name)""",
        "render_insights": insight() + "SELECT framing_id, persona, brand_name, entity, finding_key, text FROM it",
        "insight_topn": insight()
        + """SELECT framing_id, brand_name, entity, severity_score, place, text FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY framing_id, brand_name ORDER BY severity_score DESC, mat_rank DESC, entity)
    AS INTEGER) AS place FROM it) WHERE place <= 5""",
        "insight_gate": insight()
        + "SELECT framing_id, brand_name, entity, severity_band, mat_rank, surfaces FROM it",
    }
