"""Registered queries of tiers 0 to 2, over all brands, months and regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import rnd
from tierwise.operators import comparatives as c
from tierwise.operators import grid
from tierwise.operators.periods import forecast_growth
from tierwise.operators.signals import latest
from tierwise.plans.metrics import Pipeline, grain_rows
from tierwise.sources import orderlines
from tierwise.sources.bucketed import BucketedLines
from tierwise.specs import NATIONAL, PERIODS, RANKED, REGION, TERRITORY

Query = Callable[[SparkSession, str], DataFrame]
KEY = ("year_month", "period_type", "brand_name", "region_name")


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Exact money sums as doubles, for output."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _period(period: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = grain_rows(Pipeline(spark, sf_dir).monthly(), REGION, [period])
        return rows.select(
            *KEY,
            F.col("own_u").alias("units"),
            F.col("own_s").cast("double").alias("sales_eur"),
            F.col("tot_s").cast("double").alias("tot_sales_eur"),
        )

    return run


def _rows(pipe: Pipeline) -> DataFrame:
    return grain_rows(pipe.monthly(), REGION, PERIODS)


def _step(*columns: str, ops: tuple[Callable, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _rows(Pipeline(spark, sf_dir))
        for op in ops:
            rows = rows.transform(op)
        return rows.select(*KEY, *columns)

    return run


def _vs_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = Pipeline(spark, sf_dir)
    return (
        _rows(pipe)
        .transform(c.growth)
        .transform(c.growth_vs_forecast, forecast_growth(pipe.brand_forecast()))
        .select(*KEY, "growth_vs_fcst_eur", "growth_vs_fcst_units")
    )


def _bucketed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of all brands from the lines' bucketed layout."""
    cells = BucketedLines(Pipeline(spark, sf_dir).store).cells()
    sales = orderlines.sales_of_cells(cells, spark, sf_dir)
    return as_double(sales, "sales_eur").drop("is_own_brand")


def _bucketed_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own brands' forecast from the lines' bucketed layout."""
    cells = BucketedLines(Pipeline(spark, sf_dir).store).cells()
    return as_double(orderlines.brand_forecast_of_cells(cells), "sales_eur")


def _grain(name: str) -> Query:
    return lambda spark, sf_dir: as_double(Pipeline(spark, sf_dir).compute(name), "sales_eur")


def top_regions(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n best-ranked entities of every brand in the latest month, ties by name."""
    order = W.partitionBy("brand_name").orderBy(F.desc("rank_sales_eur"), "region_name")
    return (
        metrics.filter(F.col("year_month") == latest(metrics))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n)
        .drop("_n")
    )


def launch_report(metrics: DataFrame, months_back: tuple[int, ...] = (0, 3, 6, 9)) -> DataFrame:
    """Brand sums and mean growth in the latest month and some months before it."""
    months = metrics.agg(F.reverse(F.array_sort(F.collect_set("year_month"))).alias("m"))
    picked = months.select(F.transform(F.array(*[F.lit(k + 1) for k in months_back]), lambda k: F.get("m", k - 1)))

    def mean(name: str) -> Column:
        exact = F.sum(F.col(name).cast("decimal(18,2)")).cast("double")
        return rnd(exact / F.nullif(F.count(name), F.lit(0)), 1)

    return (
        metrics.filter(F.array_contains(picked.scalar(), F.col("year_month")))
        .groupBy("brand_name", "year_month")
        .agg(
            F.sum("units").alias("units"),
            F.sum("sales_eur").cast("double").alias("sales_eur"),
            mean("growth_py_sales").alias("avg_gpy"),
            mean("growth_vs_fcst_eur").alias("avg_growth_vs_fcst_eur"),
        )
    )


def queries() -> dict[str, Query]:
    return {
        "bucketed_sales": _bucketed_sales,
        "bucketed_forecast": _bucketed_forecast,
        "own_sales": lambda s, d: as_double(grid.own_sales(orderlines.sales(s, d, own_only=True)), "sales_eur"),
        "market_totals": lambda s, d: as_double(grid.market_totals(orderlines.sales(s, d)), "tot_s"),
        "brand_forecast": lambda s, d: as_double(
            grid.brand_forecast(
                orderlines.forecast(s, d), orderlines.skus(s, d), orderlines.brands(s, d)
            ).drop("brand_id"),
            "sales_eur",
        ),
        "dense_grid": lambda s, d: grid.dense_grid(Pipeline(s, d).sales(), orderlines.regions(s, d)),
        "dense_sales": lambda s, d: as_double(
            grid.dense_sales(Pipeline(s, d).sales(), orderlines.regions(s, d)), "own_s", "tot_s"
        ),
        "metrics_month": _period("Month"),
        "metrics_rollq": _period("RollQ"),
        "metrics_ytd": _period("YTD"),
        "metrics_mat": _period("MAT"),
        "market_share": _step("market_share", ops=(c.share,)),
        "growth": _step(
            "growth_py_sales", "growth_pp_sales", "growth_py_units", "growth_pp_units", ops=(c.growth,)
        ),
        "forecast_growth": lambda s, d: forecast_growth(Pipeline(s, d).brand_forecast()),
        "growth_vs_forecast": _vs_forecast,
        "growth_deviation": _step(
            "growth_py_sales", "growth_deviation", ops=(c.growth, c.growth_deviation)
        ),
        "mshare_deviation": _step("market_share", "mshare_deviation", ops=(c.share, c.share_deviation)),
        "mshare_dev_growth": _step(
            "mshare_deviation",
            "growth_py_mshare_dev",
            "growth_pp_mshare_dev",
            ops=(c.share, c.share_deviation),
        ),
        "percentile_ranks": lambda s, d: Pipeline(s, d).compute("region").select(*KEY, *RANKED),
        "rank_trend": lambda s, d: Pipeline(s, d).compute("region").select(*KEY, "rank_sales_eur", "rank_trend_3m"),
        "region_metrics": _grain(REGION.name),
        "territory_metrics": _grain(TERRITORY.name),
        "national_metrics": _grain(NATIONAL.name),
        "top_regions": lambda s, d: as_double(
            top_regions(Pipeline(s, d).metrics("region", "Month")).select(
                "brand_name",
                "region_name",
                "territory_name",
                "units",
                "sales_eur",
                "market_share",
                "growth_py_sales",
                "rank_sales_eur",
                "rank_trend_3m",
            ),
            "sales_eur",
        ),
        "launch_vs_decline": lambda s, d: launch_report(Pipeline(s, d).metrics("region", "Month")),
    }
