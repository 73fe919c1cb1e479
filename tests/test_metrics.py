"""Edge frames and invariants of tiers 0 to 2."""

from decimal import Decimal

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.functions.numeric import pct_growth, pct_of
from tierwise.operators import comparatives as c
from tierwise.operators.grid import dense_sales, market_totals, own_sales
from tierwise.operators.periods import forecast_growth, period_rows
from tierwise.plans.metrics import Pipeline, build_metrics
from tierwise.specs import NATIONAL, REGION, TERRITORY

SALES = (
    "year_month string, brand_name string, franchise string, is_own_brand int, region_name string, "
    "territory_id string, territory_name string, units bigint, sales_eur decimal(28,4)"
)
FORECAST = "year_month string, brand_name string, franchise string, units bigint, sales_eur decimal(28,4)"
PLACES = [("R1", "0", "T0"), ("R2", "0", "T0"), ("R3", "1", "T1")]


def months(n):
    return [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(n)]


def regions(spark):
    return spark.createDataFrame(PLACES, "region_name string, territory_id string, territory_name string")


def sale(ym, brand, own, region, eur, franchise="F1"):
    tid, t = next((tid, t) for r, tid, t in PLACES if r == region)
    return (ym, brand, franchise, own, region, tid, t, int(eur) // 10, Decimal(eur))


@pytest.fixture(scope="module")
def launch(spark):
    """30 months; brand B starts after 20, region R3 has competitors only, C is a rival."""
    rows = []
    for i, ym in enumerate(months(30)):
        for k, r in enumerate(("R1", "R2")):
            rows.append(sale(ym, "A", 1, r, 100 + 10 * k + i))
            if i >= 20:
                rows.append(sale(ym, "B", 1, r, 50 + i))
        rows.append(sale(ym, "C", 0, "R3", 70))
        rows.append(sale(ym, "C", 0, "R1", 300))
    sales = spark.createDataFrame(rows, SALES)
    plan = [(ym, "A", "F1", 20, Decimal(200 + i)) for i, ym in enumerate(months(28))]
    dense = dense_sales(sales, regions(spark))
    return sales, dense, build_metrics(dense, spark.createDataFrame(plan, FORECAST)).cache()


def pick(df, **at):
    for k, v in at.items():
        df = df.filter(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_dense_grid(launch):
    sales, dense, _ = launch
    assert dense.count() == 30 * 2 * 3
    r = pick(dense, year_month="2020-01", brand_name="B", region_name="R1")
    assert (r.own_u, r.own_s, r.tot_s) == (0, 0, 400)
    r = pick(dense, year_month="2020-01", brand_name="A", region_name="R3")
    assert (r.own_s, r.tot_s, r.territory_name) == (0, 70, "T1")
    assert own_sales(sales).count() == 30 * 2 + 10 * 2
    assert pick(market_totals(sales), year_month="2022-01", region_name="R1").tot_s == 100 + 24 + 50 + 24 + 300


def test_launch_and_zero_denominators(launch):
    m = launch[2]
    new = m.filter("brand_name = 'B' AND region_name = 'R1' AND period_type = 'Month'")
    assert pick(new, year_month="2021-09").growth_pp_sales is None  # nothing sold before
    assert pick(new, year_month="2021-10").growth_pp_sales == round((71 - 70) / 70 * 100, 2)
    assert pick(new, year_month="2022-01").growth_py_sales is None
    empty = pick(m, brand_name="A", region_name="R3", period_type="MAT", year_month="2022-01")
    assert (empty.market_share, empty.growth_py_sales) == (0.0, None)


def test_window_edges(launch):
    m = launch[2].filter("brand_name = 'A' AND region_name = 'R1'")
    known = {p: m.filter((F.col("period_type") == p) & F.col("market_share").isNotNull()).count() for p in ("Month", "RollQ", "YTD", "MAT")}
    assert known == {"Month": 30, "RollQ": 28, "YTD": 30, "MAT": 19}
    q = pick(m, period_type="RollQ", year_month="2020-03")
    assert float(q.sales_eur) == 100 + 101 + 102
    y = pick(m, period_type="YTD", year_month="2021-02")
    assert float(y.sales_eur) == 112 + 113
    a = pick(m, period_type="MAT", year_month="2021-12")
    before = pick(m, period_type="MAT", year_month="2020-12")
    cur, prev = float(a.sales_eur), float(before.sales_eur)
    assert a.growth_py_sales == pytest.approx(round((cur - prev) / prev * 100, 2))
    ytd = pick(m, period_type="YTD", year_month="2022-03")
    assert ytd.growth_pp_sales == ytd.growth_py_sales  # the prior period of YTD is a year back


def test_missing_forecast(launch):
    m = launch[2].filter("brand_name = 'A' AND region_name = 'R1' AND period_type = 'Month'")
    assert pick(m, year_month="2022-04").growth_vs_fcst_eur is not None
    assert pick(m, year_month="2022-05").growth_vs_fcst_eur is None
    assert launch[2].filter("brand_name = 'B' AND growth_vs_fcst_eur IS NOT NULL").count() == 0


def test_forecast_shifts_count_rows(spark):
    """A hole in the forecast moves the year-ago row, as rows are counted and not months."""
    kept = [m for i, m in enumerate(months(14)) if i != 3]
    plan = [(ym, "A", "F1", 1, Decimal(100 + i)) for i, ym in enumerate(kept)]
    out = forecast_growth(spark.createDataFrame(plan, FORECAST), ["Month"])
    assert pick(out, year_month=kept[12]).fcst_growth_py == 12.0


@pytest.mark.parametrize("n,rollq,mat", [(2, 0, 0), (3, 1, 0), (11, 9, 0), (12, 10, 1), (13, 11, 2)])
def test_short_history(spark, n, rollq, mat):
    df = spark.createDataFrame([(ym, "A", 1) for ym in months(n)], "year_month string, k string, v bigint")
    out = period_rows(df, ["k"], ["v"])
    got = {r.period_type: r.n for r in out.filter("v IS NOT NULL").groupBy("period_type").agg(F.count("*").alias("n")).collect()}
    assert (got.get("RollQ", 0), got.get("MAT", 0), got["YTD"]) == (rollq, mat, n)


def test_rank_ties(spark):
    rows = [(k, v, "b", "2020-01", "MAT") for k, v in enumerate([3.0, 3.0, 1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, v double, brand_name string, year_month string, period_type string")
    got = {r.k: r.p for r in df.withColumn("p", c.percentile_rank("v")).collect()}
    assert [got[i] for i in range(7)] == [92, 92, 67, None, 33, 33, 33]


def test_zero_denominator_expressions(spark):
    r = spark.range(1).select(
        pct_growth(F.lit(5), F.lit(0)).alias("a"),
        pct_growth(F.lit(5), F.lit(None).cast("int")).alias("b"),
        pct_of(F.lit(5), F.lit(0)).alias("c"),
    ).first()
    assert (r.a, r.b, r.c) == (None, None, None)


def test_invariants(spark):
    pipe = Pipeline(spark, SF_DIR)
    region, territory, national = (pipe.metrics(g) for g in ("region", "territory", "national"))
    key = ["brand_name", "year_month"]
    a = region.groupBy(*key, "territory_name").agg(F.sum("sales_eur").alias("s"))
    b = territory.select(*key, "territory_name", F.col("sales_eur").alias("t"))
    assert a.join(b, [*key, "territory_name"]).filter("NOT (s <=> t)").count() == 0
    a = territory.groupBy(*key).agg(F.sum("sales_eur").alias("s"))
    assert a.join(national.select(*key, F.col("sales_eur").alias("t")), key).filter("NOT (s <=> t)").count() == 0
    # share is rounded before the unrounded reference is taken off, so at most half a cent remains
    assert national.filter("abs(mshare_deviation) > 0.01 OR abs(growth_deviation) > 0.01").count() == 0
    for col in (f for f in region.columns if f.startswith("rank_") and f != "rank_trend_3m"):
        assert region.filter(f"{col} < 1 OR {col} > 100").count() == 0
    assert region.groupBy("year_month", "brand_name").count().select("count").distinct().count() == 1


def test_grain_keys():
    assert NATIONAL.series_keys == ["franchise", "brand_name"]
    assert TERRITORY.series_keys[-1] == "territory_name" and REGION.entity == "region_name"


def test_fractions_of_the_source_are_kept(spark, tmp_path):
    """2.5 units and 4.5 percent: nothing is rounded before the sum."""
    from datetime import datetime

    from tierwise.sources import orderlines

    folder = f"file://{tmp_path}"
    for t in ("orders", "customer", "nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    key = spark.read.parquet(f"{folder}/orders.parquet").first().o_orderkey
    day = datetime(2020, 1, 5)
    lines = [(key, 1, 2.5, 1000.0, 0.045, day), (key, 1, 2.5, 0.1234, 0.0, day)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    row = orderlines.sales(spark, folder).first()
    assert (row.units, float(row.sales_eur)) == (5, 955.1234)
