"""Comparisons with peers: median gaps, rule findings, tall layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import rnd
from tierwise.operators import order
from tierwise.operators.comparatives import PEERS
from tierwise.specs import MEASURES, RANKED, REGION, Grain

STEADY = 0.5  # our default: a gap that moves less than this many points is stable

# Status by gap class, for a growing, stable and falling gap.
GROWTH_STATUS = (
    (10.0, "Exceptional & accelerating", "Exceptional & holding", "Exceptional but losing steam"),
    (5.0, "Strong & accelerating", "Consistently strong", "Strong but slowing"),
    (-5.0, "Turning positive", "Neutral", "Turning negative"),
    (-10.0, "Weak but improving", "Consistently below", "Weak & worsening"),
    (None, "Far behind but recovering", "Critically weak", "Crisis: worsening rapidly"),
)
POSITION_STATUS = (
    (1.0, "Strong position & gaining", "Strong position maintained", "Strong but slipping"),
    (0.5, "Improving position", "Above peer average", "Losing edge"),
    (-0.5, "Moving toward advantage", "Aligned with peers", "Moving toward disadvantage"),
    (-1.0, "Below avg but gaining", "Below peer average", "Below & worsening"),
    (None, "Significant gap but closing", "Severely disadvantaged", "Worsening crisis"),
)
# Gap size classes by the absolute gap.
GROWTH_SIZES = ((15.0, "Exceptional"), (10.0, "Strong"), (5.0, "Moderate"), (None, "Weak"))
POSITION_SIZES = ((1.0, "Significant"), (0.5, "Moderate"), (None, "Aligned"))

# Units of the tall layout.
UNITS = {"units": "units", "sales_eur": "EUR", "market_share": "%"}


def with_median(metrics: DataFrame, metric: str, entity: str, large: bool) -> DataFrame:
    """The median of the brand month as `peer_median`; of large brand months from the counts of distinct values."""
    if not large:
        return metrics.withColumn("peer_median", rnd(F.median(metric).over(W.partitionBy(*PEERS)), 6))
    middles = order.medians(metrics, PEERS, metric, "_middle")
    sizes = metrics.groupBy(*PEERS).agg(F.count(F.lit(1)).alias("_n"))
    salts = order.salts_for(sizes.agg(F.max("_n")).first()[0])
    middles = sizes.join(middles, list(PEERS), "left").select(*PEERS, rnd(F.col("_middle"), 6).alias("peer_median"))
    return order.beside(metrics, middles, PEERS, salts, entity)


def peer_gap(metrics: DataFrame, metric: str, grain: Grain = REGION, steady: float = STEADY, large: bool = False) -> DataFrame:
    """Gap to the peer median, the gap one row earlier and its momentum, for every month."""
    series = W.partitionBy(*grain.series_keys, "period_type").orderBy("year_month")
    gaps = with_median(metrics, metric, grain.entity, large).withColumn("gap", rnd(F.col(metric) - F.col("peer_median"), 2))
    moved = gaps.withColumn("previous_gap", F.lag("gap", 1).over(series)).withColumn(
        "momentum", rnd(F.col("gap") - F.col("previous_gap"), 2)
    )
    label = (
        F.when(F.col("momentum") > steady, "widening")
        .when(F.col("momentum") < -steady, "shrinking")
        .when(F.col("momentum").isNotNull(), "stable")
    )
    return moved.select(
        "year_month",
        "period_type",
        "brand_name",
        *([grain.entity] if grain.entity != "brand_name" else []),
        F.col(metric).alias("value"),
        rnd(F.col("peer_median"), 2).alias("peer_median"),
        "gap",
        "previous_gap",
        "momentum",
        label.alias("movement"),
    )


def gap_status(gaps: DataFrame, table: Sequence[tuple], sizes: Sequence[tuple]) -> DataFrame:
    """Size class and status text of a gap and its movement. Bounds belong to the upper class for
    gaps above zero and to the lower class below zero."""
    gap, movement = F.col("gap"), F.col("movement")

    def text(row: tuple) -> Column:
        _, up, same, down = row
        return F.when(movement == "widening", up).when(movement == "stable", same).when(movement == "shrinking", down)

    status = None
    for row in table:
        bound = row[0]
        if bound is None:
            status = status.otherwise(text(row))
        else:
            inside = gap >= bound if bound > 0 else gap > bound
            status = F.when(inside, text(row)) if status is None else status.when(inside, text(row))
    size = None
    for bound, name in sizes:
        if bound is None:
            size = size.otherwise(name)
        else:
            size = F.when(F.abs(gap) >= bound, name) if size is None else size.when(F.abs(gap) >= bound, name)
    known = gap.isNotNull()
    return gaps.withColumns({"size_class": F.when(known, size), "status": F.when(known, status)})


def rule_findings(metrics: DataFrame) -> DataFrame:
    """Three documented rules over consecutive months, for every month and period.

    Forecast missed in a row, which the document fixes to the annual total; sales rank falling by more than 10 twice; a big region more than 10
    points below the brand's median growth twice.
    """
    peers = W.partitionBy(*PEERS)
    series = W.partitionBy(*REGION.series_keys, "period_type").orderBy("year_month")

    def row_back(c: Column, k: int) -> Column:
        return F.coalesce(F.lag(c, k).over(series), F.lit(False))

    flags = metrics.withColumns(
        {
            "_miss": F.coalesce(F.col("growth_vs_fcst_eur") < 0, F.lit(False)),
            "_behind": F.coalesce(
                (F.col("rank_sales_eur") >= 80)
                & (F.col("growth_py_sales") < rnd(F.median("growth_py_sales").over(peers), 6) - 10.0),
                F.lit(False),
            ),
        }
    )
    flags = flags.withColumn(
        "_fall",
        F.coalesce(F.col("rank_sales_eur") - F.lag("rank_sales_eur", 1).over(series) < -10, F.lit(False)),
    )
    miss, behind, fall = F.col("_miss"), F.col("_behind"), F.col("_fall")
    found = flags.withColumns(
        {
            "_r1": F.when(
                (F.col("period_type") == "MAT") & miss & row_back(miss, 1), F.when(row_back(miss, 2), "high").otherwise("moderate")
            ),
            "_r2": F.when(fall & row_back(fall, 1), "high"),
            "_r3": F.when(behind & row_back(behind, 1), "critical"),
        }
    )
    types = {
        "ConsecutiveForecastMiss": "_r1",
        "RapidDeteriorationTrend": "_r2",
        "BigRegionUnderperformance": "_r3",
    }
    fields = [F.struct(F.lit(t).alias("finding_type"), F.col(c).alias("strength")) for t, c in types.items()]
    return found.select("year_month", "period_type", "brand_name", "region_name", F.inline(F.array(*fields))).filter(
        F.col("strength").isNotNull()
    )


def tall(metrics: DataFrame, grain: Grain = REGION) -> DataFrame:
    """One row per known metric value, with its unit."""
    names = [*MEASURES, *RANKED, "rank_trend_3m"]
    values = metrics.select(
        "year_month",
        "period_type",
        *grain.id_columns,
        *[F.col(n).cast("double").alias(n) for n in names],
    )
    long = values.unpivot(["year_month", "period_type", *grain.id_columns], names, "metric_type", "value")
    unit = F.when(F.col("metric_type").startswith("rank_"), "rank").otherwise("pp")
    for name, u in UNITS.items():
        unit = F.when(F.col("metric_type") == name, u).otherwise(unit)
    unit = F.when(F.col("metric_type").rlike("^growth_p[yp]_(sales|units)$"), "%").otherwise(unit)
    return long.filter(F.col("value").isNotNull()).withColumn("unit", unit)
