"""Tier 0: rollups of the facts and the dense month x brand x region grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.specs import Grain

MONEY = "decimal(28,4)"
SPREAD = 64  # buckets over which a pairing of two dimensions is spread


def own_sales(sales: DataFrame) -> DataFrame:
    return (
        sales.filter(F.col("is_own_brand") == 1)
        .groupBy("year_month", "brand_name", "franchise", "region_name", "territory_id", "territory_name")
        .agg(F.sum("units").alias("units"), F.sum("sales_eur").cast(MONEY).alias("sales_eur"))
    )


def market_totals(sales: DataFrame) -> DataFrame:
    """Own and competitor sales together, per month, franchise and region."""
    return sales.groupBy("year_month", "franchise", "region_name").agg(
        F.sum("units").alias("tot_u"), F.sum("sales_eur").cast(MONEY).alias("tot_s")
    )


def brand_forecast(forecast: DataFrame, skus: DataFrame, brands: DataFrame) -> DataFrame:
    """SKU forecast summed to month x brand.

    Rows are summed per SKU month before the lookups already; the star join is left to Spark,
    which broadcasts a dimension only below its size threshold.
    """
    return (
        forecast.join(skus, "sku_id")
        .join(brands, "brand_id")
        .groupBy("year_month", "brand_id", "brand_name", "franchise")
        .agg(F.sum("units").alias("units"), F.sum("sales_eur").cast(MONEY).alias("sales_eur"))
    )


def brand_pairs(sales: DataFrame, own: bool = True) -> DataFrame:
    """(brand, franchise) pairs seen in own sales, or in those of the competitors."""
    return sales.filter(F.col("is_own_brand") == int(own)).select("brand_name", "franchise").distinct()


def _pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row, as an equi-join on a bucket.

    The left side is repeated once per bucket and the right side is spread over the buckets, so
    the pairing is distributed whatever the sizes are; Spark still broadcasts a side it has
    measured to be small.
    """
    buckets = F.sequence(F.lit(0), F.lit(SPREAD - 1))
    spread = right.withColumn("_b", F.pmod(F.xxhash64(*right.columns), F.lit(SPREAD)).cast("int"))
    return left.withColumn("_b", F.explode(buckets)).join(spread, "_b").drop("_b")


def dense_grid(sales: DataFrame, regions: DataFrame, own: bool = True) -> DataFrame:
    """Months with own sales x own brands (or the competitors') x regions.

    The month list comes as one scalar subquery; it holds calendar months, so its size is bounded
    by the years covered and not by the rows.
    """
    sold = sales.filter(F.col("is_own_brand") == 1)
    months = sold.agg(F.array_sort(F.collect_set("year_month")))
    pairs = _pair(regions, brand_pairs(sales, own))
    return pairs.select(
        F.explode(months.scalar()).alias("year_month"),
        "brand_name",
        "franchise",
        "region_name",
        "territory_id",
        "territory_name",
    )


def dense_sales(sales: DataFrame, regions: DataFrame, own: bool = True) -> DataFrame:
    """The grid with each brand's sales and its market totals, zero where nothing was sold.

    Grid rows (as zeros) and fact rows are stacked and summed, which replaces two left joins by one
    shuffle. It is by (franchise, region): the cell sums, the market totals over the franchise and
    the later per-series windows all reuse that partitioning. Every group holds at most months x
    brands of one franchise, so no group grows with the number of order lines.
    """
    zero = F.lit(0).cast("long")
    nothing = F.lit(0).cast(MONEY)
    key = ["franchise", "region_name", "year_month", "brand_name"]
    grid = dense_grid(sales, regions, own).select(
        *key,
        "territory_id",
        "territory_name",
        zero.alias("units"),
        nothing.alias("sales_eur"),
        F.lit(1).alias("in_grid"),
    )
    facts = sales.select(
        *key,
        "territory_id",
        "territory_name",
        "units",
        F.col("sales_eur").cast(MONEY).alias("sales_eur"),
        F.lit(0).alias("in_grid"),
    )
    summed = (
        grid.unionByName(facts)
        .repartition("franchise", "region_name")
        .groupBy(*key)
        .agg(
            F.max(F.when(F.col("in_grid") == 1, F.col("territory_id"))).alias("territory_id"),
            F.max(F.when(F.col("in_grid") == 1, F.col("territory_name"))).alias("territory_name"),
            F.sum("units").alias("all_u"),
            F.sum("sales_eur").cast(MONEY).alias("all_s"),
            F.max("in_grid").alias("in_grid"),
        )
    )
    market = W.partitionBy("franchise", "region_name", "year_month")
    return (
        summed.withColumn("tot_u", F.sum("all_u").over(market))
        .withColumn("tot_s", F.sum("all_s").over(market).cast(MONEY))
        .filter("in_grid = 1")
        .select(
            "year_month",
            "brand_name",
            "franchise",
            "region_name",
            "territory_id",
            "territory_name",
            F.col("all_u").alias("own_u"),
            F.col("all_s").alias("own_s"),
            "tot_u",
            "tot_s",
        )
    )


def roll_up(monthly: DataFrame, grain: Grain) -> DataFrame:
    """Sums of a coarser grain. Shares are derived again from the sums, never averaged."""
    return monthly.groupBy("year_month", *grain.id_columns).agg(
        F.sum("own_u").alias("own_u"),
        F.sum("own_s").cast(MONEY).alias("own_s"),
        F.sum("tot_u").alias("tot_u"),
        F.sum("tot_s").cast(MONEY).alias("tot_s"),
    )
