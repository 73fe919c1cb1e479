"""Own, competitor and market movement, and where a lost volume went.

Within a region, franchise and period everything rests on market = own + competitors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import pct_growth, pct_of, rnd
from tierwise.operators import order
from tierwise.operators.periods import period_rows
from tierwise.specs import PERIODS

SERIES = ["franchise", "region_name"]
PLACE = ("franchise", "region_name", "territory_name")
STABLE_BAND = 1.0  # our default: growth within +-1 point counts as stable or flat
MATCH = 0.2  # our default: a summed rise within 20 percent of the lost volume compensates it

# Documented archetypes of the pie x slice cells, (market direction, share direction) -> name; cells that the
# document leaves open have our names.
ARCHETYPES = {
    ("expanding", "gaining"): "outgrowing",
    ("expanding", "holding"): "riding_the_tide",
    ("expanding", "losing"): "underperforming_hot_market",
    ("stable", "gaining"): "taking_share",
    ("stable", "holding"): "dormant",
    ("stable", "losing"): "losing_share",
    ("contracting", "gaining"): "counter_cyclical",
    ("contracting", "holding"): "sinking_with_market",
    ("contracting", "losing"): "double_hit",
}


def market_rows(monthly: DataFrame, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Own and market sums per month, period, franchise and region with the year before.

    The monthly frame repeats a franchise's market on each of its own brands, so the market is
    taken once. Shuffled once: the period windows reuse the partitioning of the sums.
    """
    base = (
        monthly.repartition(*SERIES)
        .groupBy("year_month", *PLACE)
        .agg(
            F.sum("own_s").cast("decimal(28,4)").alias("own_s"),
            F.max("tot_s").alias("tot_s"),
            F.max("tot_u").alias("tot_u"),
        )
    )
    return period_rows(base, SERIES, ["own_s", "tot_s", "tot_u"], periods, PLACE)


def market_signals(rows: DataFrame) -> DataFrame:
    """Growth of own, market and competitors, share momentum and deviation from the nation."""
    nation = W.partitionBy("franchise", "year_month", "period_type")
    now, before = F.sum("tot_s").over(nation), F.sum("tot_s_py").over(nation)
    national = F.when(before > 0, pct_growth(now, before))
    rivals = F.col("tot_s") - F.col("own_s")
    rivals_py = F.col("tot_s_py") - F.col("own_s_py")
    return rows.withColumns(
        {
            "own_growth": rnd(pct_growth(F.col("own_s"), F.col("own_s_py")), 2),
            "market_growth": rnd(pct_growth(F.col("tot_s"), F.col("tot_s_py")), 2),
            "competitor_growth": rnd(pct_growth(rivals, rivals_py), 2),
            "market_share": rnd(pct_of(F.col("own_s"), F.col("tot_s")), 2),
            "_national": national,
        }
    ).withColumns(
        {
            "share_momentum": rnd(F.col("own_growth") - F.col("market_growth"), 2),
            "market_growth_deviation": rnd(F.col("market_growth") - F.col("_national"), 2),
        }
    ).drop("_national")


def competitor_segments(rival_rows: DataFrame) -> DataFrame:
    """Share and growth of every competitor; input is the dense competitor grid as period rows."""
    return rival_rows.select(
        "year_month",
        "period_type",
        *PLACE,
        F.col("brand_name").alias("competitor"),
        F.col("own_s").cast("double").alias("sales_eur"),
        rnd(pct_of(F.col("own_s"), F.col("tot_s")), 2).alias("competitor_share"),
        rnd(pct_growth(F.col("own_s"), F.col("own_s_py")), 2).alias("competitor_growth"),
        (F.col("own_s") - F.col("own_s_py")).cast("decimal(28,4)").alias("change"),
    )


def _direction(value: Column, band: float, names: tuple[str, str, str]) -> Column:
    up, flat, down = names
    return F.when(value > band, up).when(value < -band, down).when(value.isNotNull(), flat)


def market_matrix(signals: DataFrame, band: float = STABLE_BAND) -> DataFrame:
    """Pie x slice cell of every region and franchise."""
    pie = _direction(F.col("market_growth"), band, ("expanding", "stable", "contracting"))
    slice_ = _direction(F.col("share_momentum"), band, ("gaining", "holding", "losing"))
    cell = F.lit(None).cast("string")
    for (p, s), name in ARCHETYPES.items():
        cell = F.when((F.col("pie") == p) & (F.col("slice") == s), name).otherwise(cell)
    return signals.withColumns({"pie": pie, "slice": slice_}).withColumn("archetype", cell)


def attribution(signals: DataFrame, segments: DataFrame, band: float = STABLE_BAND) -> DataFrame:
    """Where own losses went within the region, and the competitor that gained most.

    The winner is picked while aggregating, so competitors are never gathered per region.
    """
    keys = ["year_month", "period_type", *PLACE]
    top = (
        segments.filter(F.col("change").isNotNull())
        .groupBy(*keys)
        .agg(
            F.max_by("competitor", F.struct("change", "competitor")).alias("top_competitor"),
            F.max("change").cast("double").alias("top_change"),
        )
    )
    lost = signals.filter(F.col("own_s") < F.col("own_s_py"))
    verdict = _direction(
        F.col("competitor_growth"), band, ("competitive_takeover", "outflow_or_demand_loss", "market_contraction")
    )
    return lost.join(top, keys, "left").select(
        *keys,
        (F.col("own_s_py") - F.col("own_s")).cast("double").alias("lost"),
        "own_growth",
        "competitor_growth",
        verdict.alias("verdict"),
        "top_competitor",
        "top_change",
    )


def displacement(rows: DataFrame, match: float = MATCH, large: bool = False) -> DataFrame:
    """Regions whose market fell, and whether the franchise rose by about as many units elsewhere in the same period.

    The lost units are compared with the summed rise of the other regions, as documented; the region that rose most is named
    as the leading destination. A group holds one row per region of the dense grid; the sums of a large one are joined back.
    """
    group = ["year_month", "period_type", "franchise"]
    delta = (F.col("tot_u") - F.col("tot_u_py")).cast("decimal(28,4)")
    moved = rows.withColumn("delta", delta).filter(F.col("delta").isNotNull() & (F.col("delta") != 0))
    rise = F.when(F.col("delta") > 0, F.col("delta"))
    top = F.when(F.col("delta") > 0, F.struct("delta", "region_name"))
    if large:
        sums = moved.groupBy(*group).agg(F.sum(rise).alias("risen"), F.max(top).alias("top"), F.count(F.lit(1)).alias("_n"))
        salts = order.salts_for(sums.agg(F.max("_n")).first()[0])
        found = order.beside(moved.filter(F.col("delta") < 0), sums.drop("_n"), group, salts, "region_name")
    else:
        everyone = W.partitionBy(*group)
        sums = {"risen": F.sum(rise).over(everyone), "top": F.max(top).over(everyone)}
        found = moved.withColumns(sums).filter(F.col("delta") < 0)
    lost = (-F.col("delta")).cast("double")
    risen = F.coalesce(F.col("risen").cast("double"), F.lit(0.0))
    hit = F.abs(lost - risen) <= F.lit(match) * lost
    return found.select(
        *group,
        "region_name",
        lost.alias("lost"),
        risen.alias("risen_elsewhere"),
        F.when(hit, F.col("top.region_name")).alias("destination_region"),
        F.when(hit, F.col("top.delta").cast("double")).alias("destination_rise"),
        F.when(hit, "displaced_volume").otherwise("true_demand_loss").alias("diagnosis"),
    )
