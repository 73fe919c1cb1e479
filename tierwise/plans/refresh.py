"""Metric tables that are kept and refreshed: only what a change of the facts can reach is computed and written anew.

Sums are those of a month, brand and region. What a changed fact reaches:

* its month in the market of its franchise, so all own brands of the franchise in that month;
* the REACH months after it, which look back on it through the twelve-month total, its value a year before and the
  three rows of the rank trend;
* in each of these months the whole brand, since national sums and ranks compare all its entities;
* where the growth of the forecast has changed, the brand month itself.

Tables lie in partitions by month (metrics: by period and month). Partitions that nothing reaches are neither read nor written;
in those that are reached the rows of other brands are copied.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.operators import order
from tierwise.operators.grid import brand_pairs, dense_sales
from tierwise.operators.periods import forecast_growth
from tierwise.plans.metrics import build_metrics
from tierwise.specs import GRAINS, NATIONAL, PRIOR_YEAR_ROWS, WINDOW_ROWS

TREND_ROWS = 3
REACH = max(WINDOW_ROWS.values()) - 1 + PRIOR_YEAR_ROWS + TREND_ROWS

BRAND_MONTH = ["brand_name", "year_month"]


def _in_months(brands: DataFrame, months: list[str]) -> DataFrame:
    """Each brand in each of the months."""
    return brands.withColumn("year_month", F.explode(F.array(*[F.lit(m) for m in months])))


@dataclass
class MetricTables:
    spark: SparkSession
    folder: str
    grains: tuple[str, ...] = tuple(GRAINS)

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        """A table: monthly, brands, forecast_growth, region, territory or national."""
        return self.spark.read.parquet(self._path(name))

    def _replace(self, rows: DataFrame, name: str, *by: str) -> None:
        """Writes the partitions that the rows fall in; others stay. The rows may come from the table itself."""
        staged = self._path(f"_staged/{uuid.uuid4().hex[:12]}")
        rows.write.parquet(staged)
        kept = self.spark.read.schema(rows.schema).parquet(staged)
        if by:
            kept = kept.repartition(*by).sortWithinPartitions(*by)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._path(name))

    def _months(self) -> list[str]:
        """Months of the dense table: calendar months, bounded by the years covered."""
        return sorted(r.year_month for r in self.read("months").collect())

    def build(self, sales: DataFrame, brand_forecast: DataFrame, regions: DataFrame) -> None:
        """All tables from all facts."""
        monthly = dense_sales(sales, regions)
        self._replace(monthly, "monthly", "year_month")
        monthly = self.read("monthly")
        self._replace(monthly.select("year_month").distinct(), "months")
        self._replace(monthly.select("brand_name", "franchise").distinct(), "brands")
        self._replace(forecast_growth(brand_forecast), "forecast_growth")
        for name in self.grains:
            grain = GRAINS[name]
            rows = build_metrics(monthly, brand_forecast, grain, large=self._large(name, regions))
            self._replace(rows, name, "period_type", "year_month")

    def _large(self, grain: str, regions: DataFrame) -> bool:
        return grain != NATIONAL.name and regions.count() > order.LARGE

    def refresh(self, sales: DataFrame, brand_forecast: DataFrame, regions: DataFrame, changed: DataFrame) -> list[str]:
        """The tables after a change of the facts; gives the months whose metrics were written.

        sales and brand_forecast are the facts as they are now. changed names (year_month, franchise) of all sales that are new or
        other than before. Months and brands may be new, also between others; they don't go.
        """
        changed = order.written(changed.select("year_month", "franchise").distinct())
        months, brands = self._months(), self.read("brands")
        touched = sorted(r.year_month for r in changed.select("year_month").distinct().collect())
        slice_ = sales.filter(F.col("year_month").isin(touched))
        new_months = set(r.year_month for r in slice_.filter("is_own_brand = 1").select("year_month").distinct().collect()) - set(months)
        new_brands = order.written(brand_pairs(slice_).join(brands, "brand_name", "left_anti"))
        if not new_brands.isEmpty():  # with rows in every month of the grid
            touched, slice_ = sorted({*months, *touched}), sales
            brands = order.written(brands.unionByName(new_brands))
            self._replace(brands, "brands")
        months = sorted({*months, *new_months})
        if new_months:
            self._replace(self.spark.createDataFrame([(m,) for m in months], "year_month string"), "months")
        written = [m for m in touched if m in set(months)]
        if written:
            self._replace(self._dense(slice_, brands, regions, written), "monthly", "year_month")

        reached = self._reached(changed, brands, new_brands, months, new_months)
        growth = forecast_growth(brand_forecast)
        other = growth.exceptAll(self.read("forecast_growth")).select(*BRAND_MONTH)
        reached = reached.unionByName(other.join(brands, "brand_name", "left_semi")).distinct()
        reached = order.written(reached.filter(F.col("year_month").isin(months)))
        self._replace(growth, "forecast_growth")
        in_months = sorted(r.year_month for r in reached.select("year_month").distinct().collect())
        if in_months:
            self._recompute(brand_forecast, regions, reached, in_months, months)
        return in_months

    def _dense(self, sales: DataFrame, brands: DataFrame, regions: DataFrame, months: list[str]) -> DataFrame:
        """The grid of some months. Each brand gets a sale of nothing in each month, so it is in the grid where it sold nothing."""
        one = regions.agg(F.min(F.struct("region_name", "territory_id", "territory_name")).alias("r"))
        every = _in_months(brands, months)
        place = one.scalar()
        nothing = every.select(
            "year_month", "brand_name", "franchise", F.lit(1).alias("is_own_brand"),
            *[place.getField(c).alias(c) for c in ("region_name", "territory_id", "territory_name")],
            F.lit(0).cast(sales.schema["units"].dataType).alias("units"), F.lit(0).cast(sales.schema["sales_eur"].dataType).alias("sales_eur"),
        )
        # sales of competitors in months without own sales belong to no grid
        return dense_sales(sales.filter(F.col("year_month").isin(months)).unionByName(nothing), regions)

    def _reached(self, changed: DataFrame, brands: DataFrame, new_brands: DataFrame, months: list[str], new_months: set[str]) -> DataFrame:
        """(brand_name, year_month) of all metric rows that the changed sales can reach."""
        numbers = self.spark.createDataFrame(list(enumerate(months)), "i long, year_month string")
        begun = changed.join(brands, "franchise").select(*BRAND_MONTH)
        begun = begun.unionByName(_in_months(new_brands, months).select(*BRAND_MONTH))
        if new_months:  # a new row in every series
            begun = begun.unionByName(_in_months(brands, sorted(new_months)).select(*BRAND_MONTH))
        ahead = F.sequence(F.col("i"), F.least(F.col("i") + REACH, F.lit(len(months) - 1)))
        spans = begun.distinct().join(F.broadcast(numbers), "year_month").select("brand_name", F.explode(ahead).alias("i")).distinct()
        return spans.join(F.broadcast(numbers), "i").select(*BRAND_MONTH)

    def _recompute(self, brand_forecast: DataFrame, regions: DataFrame, reached: DataFrame, in_months: list[str], months: list[str]) -> None:
        first = months[max(0, months.index(in_months[0]) - REACH)]
        rows = self.read("monthly").filter(F.col("year_month").between(first, in_months[-1]))
        rows = rows.join(reached.select("brand_name").distinct(), "brand_name", "left_semi")
        for name in self.grains:
            grain = GRAINS[name]
            new = build_metrics(rows, brand_forecast, grain, large=self._large(name, regions))
            new = new.join(reached, BRAND_MONTH, "left_semi")
            # with the schema given, no file outside the months is opened for it
            old = self.spark.read.schema(new.schema).parquet(self._path(name)).filter(F.col("year_month").isin(in_months)).join(reached, BRAND_MONTH, "left_anti")
            self._replace(new.unionByName(old.select(*new.columns)), name, "period_type", "year_month")
