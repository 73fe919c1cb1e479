"""Adapter from order-line tables to the sales and forecast facts.

Contract of the facts every operator takes:

* sales: year_month, brand_name, franchise, is_own_brand, region_name, territory_id,
  territory_name, units (long), sales_eur (decimal)
* forecast: year_month, sku_id, units, sales_eur; skus: sku_id, brand_id; brands: brand_id,
  brand_name, franchise
* regions: region_name, territory_id, territory_name

Names are looked up after the aggregation, so the wide shuffle carries only keys and numbers.
Joins carry no broadcast hint: Spark picks the strategy from table sizes and, at run time, from
measured shuffle sizes, and splits a hot order or part key with its skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OWN_BRANDS = 6
FRANCHISES = 5
MONEY = "decimal(28,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def brand_number(brand: Column) -> Column:
    return F.substring(brand, 7, 10).cast("int")


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def month_text(n: Column) -> Column:
    year = F.floor(n / 12).cast("int")
    return F.concat_ws(
        "-",
        F.lpad(year.cast("string"), 4, "0"),
        F.lpad((n - year * 12 + 1).cast("string"), 2, "0"),
    )


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Keys, months and exact amounts per line: qty in 1/10000 of a unit, value in 1/10^10 of the currency.

    Prices and quantities keep four decimals, discounts six. Amounts are exact whole numbers, so sums do not depend
    on their order; an amount beyond the range of a long is an error, not a wrong number.
    """
    price = F.rint(F.col("l_extendedprice") * 10_000).cast("long")
    kept = 1_000_000 - F.rint(F.col("l_discount") * 1_000_000).cast("long")
    return lineitem.select(
        "l_orderkey",
        "l_partkey",
        month_number(F.col("l_shipdate")).alias("ship_month"),
        F.rint(F.col("l_quantity") * 10_000).cast("long").alias("qty"),
        (price * kept).cast("decimal(19,0)").alias("value"),
    )


def amounts() -> list[Column]:
    """Sums in units and currency with four decimals."""
    return [
        (F.sum("qty").cast("decimal(24,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast(MONEY).alias("units"),
        (F.sum("value").cast("decimal(29,0)") * F.lit("0.0000000001").cast("decimal(11,10)")).cast(MONEY).alias("sales_eur"),
    ]


def whole_units() -> Column:
    """The facts count whole units: rounded once, after the sum."""
    return F.round("units", 0).cast("long").alias("units")


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their month and the country of their customer."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", month_number(F.col("o_orderdate")).alias("order_month")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "order_month", "c_nationkey")


def _lines_by_place(spark: SparkSession, sf_dir: str, own_only: bool, lineitem: DataFrame | None = None) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    if own_only:
        part = part.filter(brand_number(F.col("p_brand")) <= OWN_BRANDS)
    placed = placed_orders(spark, sf_dir)
    lines = order_lines(table(spark, sf_dir, "lineitem") if lineitem is None else lineitem)
    return lines.join(part, lines.l_partkey == part.p_partkey).join(
        placed, lines.l_orderkey == placed.o_orderkey
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        F.col("n_name").alias("region_name"),
        F.col("r_regionkey").cast("string").alias("territory_id"),
        F.col("r_name").alias("territory_name"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).drop("n_nationkey")


def _named(cells: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month numbers and keys of aggregated rows replaced by the names of the sales fact."""
    n = brand_number(F.col("p_brand"))
    return (
        cells.join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            month_text(F.col("ship_month")).alias("year_month"),
            F.col("p_brand").alias("brand_name"),
            F.concat(F.lit("F"), (n % FRANCHISES).cast("string")).alias("franchise"),
            (n <= OWN_BRANDS).cast("int").alias("is_own_brand"),
            "region_name",
            "territory_id",
            "territory_name",
            whole_units(),
            "sales_eur",
        )
    )


def sales(spark: SparkSession, sf_dir: str, own_only: bool = False) -> DataFrame:
    """Own and competitor sales by ship month, brand and region."""
    cells = (
        _lines_by_place(spark, sf_dir, own_only)
        .groupBy("ship_month", "p_brand", "c_nationkey")
        .agg(*amounts())
    )
    return _named(cells, spark, sf_dir)


CELL = ("ship_month", "order_month", "p_brand", "c_nationkey")


def cells(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Ship month x order month x brand x country: one pass over the lines from which both the
    sales and the brand forecast roll up. lineitem: other lines than the folder's."""
    return (
        _lines_by_place(spark, sf_dir, own_only=False, lineitem=lineitem)
        .groupBy(*CELL)
        .agg(*amounts())
    )


def sales_of_cells(cells: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = cells.groupBy("ship_month", "p_brand", "c_nationkey").agg(
        F.sum("units").cast(MONEY).alias("units"), F.sum("sales_eur").cast(MONEY).alias("sales_eur")
    )
    return _named(rolled, spark, sf_dir)


def brand_forecast_of_cells(cells: DataFrame) -> DataFrame:
    n = brand_number(F.col("p_brand"))
    return (
        cells.filter(n <= OWN_BRANDS)
        .groupBy("order_month", "p_brand")
        .agg(F.sum("units").cast(MONEY).alias("units"), F.sum("sales_eur").cast(MONEY).alias("sales_eur"))
        .select(
            month_text(F.col("order_month")).alias("year_month"),
            F.col("p_brand").alias("brand_name"),
            F.concat(F.lit("F"), (n % FRANCHISES).cast("string")).alias("franchise"),
            whole_units(),
            "sales_eur",
        )
    )


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings per order month and own product: the plan for shipments, national, per SKU.

    Lines of other products are dropped before the orders join, so the large shuffle carries own
    products only.
    """
    lines = order_lines(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_partkey", "qty", "value")
    own = skus(spark, sf_dir).select(F.col("sku_id").alias("l_partkey"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", month_number(F.col("o_orderdate")).alias("order_month")
    )
    return (
        lines.join(own, "l_partkey", "left_semi")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("order_month", "l_partkey")
        .agg(*amounts())
        .select(
            month_text(F.col("order_month")).alias("year_month"),
            F.col("l_partkey").alias("sku_id"),
            whole_units(),
            "sales_eur",
        )
    )


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own products: SKU to brand."""
    return (
        table(spark, sf_dir, "part")
        .filter(brand_number(F.col("p_brand")) <= OWN_BRANDS)
        .select(F.col("p_partkey").alias("sku_id"), F.col("p_brand").alias("brand_id"))
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = brand_number(F.col("brand_id"))
    return (
        skus(spark, sf_dir)
        .select("brand_id")
        .distinct()
        .select(
            "brand_id",
            F.col("brand_id").alias("brand_name"),
            F.concat(F.lit("F"), (n % FRANCHISES).cast("string")).alias("franchise"),
        )
    )
