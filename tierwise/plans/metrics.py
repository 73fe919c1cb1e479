"""The metric pipeline of one grain, and the pipeline over order lines with written tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.operators import comparatives as c
from tierwise.operators import order
from tierwise.operators.grid import dense_sales, roll_up
from tierwise.operators.periods import forecast_growth, period_rows
from tierwise.sources import orderlines
from tierwise.sources.bucketed import BucketedLines
from tierwise.sources.store import Store
from tierwise.specs import GRAINS, MEASURES, NATIONAL, PERIODS, REGION, Grain

SUMS = ("own_u", "own_s", "tot_s")


def grain_rows(monthly: DataFrame, grain: Grain, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Period sums and their shifts at a grain; input is the dense region-level monthly frame."""
    base = monthly if grain is REGION else roll_up(monthly, grain)
    return period_rows(base, grain.series_keys, SUMS, periods, grain.id_columns)


def build_metrics(
    monthly: DataFrame,
    brand_forecast: DataFrame,
    grain: Grain = REGION,
    periods: Sequence[str] = PERIODS,
    large: bool = False,
) -> DataFrame:
    """Tiers 1 and 2 at one grain.

    Shuffles: one by series (period windows), one by brand month (national reference and all nine
    ranks), one by series for the rank trend. A large brand month has too many entities for one task: its national sums are
    joined back and its ranks come from the counts of distinct values, by ranges.
    """
    rows = c.join_forecast(grain_rows(monthly, grain, periods), forecast_growth(brand_forecast, periods))
    if large:
        rows = c.with_peer_sums(rows, grain.entity)
    total = c.joined_sum if large else c.peer_sum
    compared = (
        rows.withColumns({**c.share_columns(), **c.growth_columns()})
        .withColumns(
            {**c.growth_vs_forecast_columns(), **c.growth_deviation_columns(total), **c.share_deviation_columns(total)}
        )
        .withColumns(c.deviation_change_columns())
        .withColumnsRenamed({"own_u": "units", "own_s": "sales_eur"})
    )
    ids = ["year_month", "period_type", *grain.id_columns, *MEASURES]
    if large:
        ranked = c.large_ranks(compared.select(*ids), grain.entity)
    else:
        ranked = compared.select(*ids, *[col.alias(name) for name, col in c.rank_columns().items()])
    return ranked.select("*", c.rank_trend_column(grain))


class Pipeline:
    """Order lines to metric tables, each written once and then read.

    With a folder the tables are kept for later applications. Bucketed: lines and orders are laid out by order key first, so
    later builds of the cells don't shuffle them.
    """

    _regions: dict[str, int] = {}  # of each source

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str | None = None, bucketed: bool = False):
        self.spark, self.sf_dir, self.bucketed = spark, sf_dir, bucketed
        self.store = Store(spark, sf_dir, folder)

    def cells(self) -> DataFrame:
        build = BucketedLines(self.store).cells if self.bucketed else lambda: orderlines.cells(self.spark, self.sf_dir)
        return self.store.table("cells", build)

    def sales(self) -> DataFrame:
        return self.store.table(
            "sales", lambda: orderlines.sales_of_cells(self.cells(), self.spark, self.sf_dir)
        )

    def brand_forecast(self) -> DataFrame:
        return self.store.table("forecast", lambda: orderlines.brand_forecast_of_cells(self.cells()))

    def regions(self) -> DataFrame:
        return orderlines.regions(self.spark, self.sf_dir)

    def monthly(self) -> DataFrame:
        """Dense month x brand x region sums, the start of every grain."""
        return self.store.table("monthly", lambda: dense_sales(self.sales(), self.regions()))

    def compute(self, grain: str, periods: Sequence[str] = PERIODS) -> DataFrame:
        large = grain != NATIONAL.name and self.large()  # one row of a nation is one of a brand month
        return build_metrics(self.monthly(), self.brand_forecast(), GRAINS[grain], periods, large)

    def large(self) -> bool:
        """Whether a brand month, one row for each region, is too large for one task."""
        if self.store.base not in Pipeline._regions:
            Pipeline._regions[self.store.base] = self.regions().count()
        return Pipeline._regions[self.store.base] > order.LARGE

    def all_periods(self, grain: str) -> DataFrame:
        """The written metric table of a grain: all periods from one pass over the months, a partition each."""
        return self.store.table(f"{grain}_metrics", lambda: self.compute(grain), sort="year_month", by="period_type")

    def metrics(self, grain: str, period: str = "MAT") -> DataFrame:
        """The rows of one period; other partitions aren't read."""
        return self.all_periods(grain).filter(F.col("period_type") == period)
