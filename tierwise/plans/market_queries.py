"""Registered queries of the documented market, gap, rule and neighbour methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.operators import clusters
from tierwise.operators import market as mkt
from tierwise.operators import neighbours as near
from tierwise.operators import peers
from tierwise.operators.grid import dense_sales
from tierwise.operators.periods import period_rows
from tierwise.plans.metrics import Pipeline
from tierwise.specs import GRAINS, PERIODS, REGION

KEY = ("year_month", "period_type", "franchise", "region_name")


def _rivals(pipe: Pipeline) -> DataFrame:
    """Competitor segments on their own dense grid, all periods."""
    grid = pipe.store.table("rivals", lambda: dense_sales(pipe.sales(), pipe.regions(), own=False))
    rows = period_rows(
        grid, REGION.series_keys, ["own_s", "tot_s"], PERIODS, REGION.id_columns
    )
    return mkt.competitor_segments(rows)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mkt.market_signals(mkt.market_rows(Pipeline(spark, sf_dir).monthly()))


def _pick(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _signals(s, d).select(*KEY, *columns)


def _growth_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = Pipeline(spark, sf_dir)
    return peers.peer_gap(pipe.all_periods("region"), "growth_py_sales", large=pipe.large())


def _gap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = Pipeline(spark, sf_dir)
    growth = peers.gap_status(_growth_gap(spark, sf_dir), peers.GROWTH_STATUS, peers.GROWTH_SIZES)
    position = peers.gap_status(
        peers.peer_gap(pipe.all_periods("region"), "mshare_deviation", large=pipe.large()),
        peers.POSITION_STATUS,
        peers.POSITION_SIZES,
    )
    both = growth.withColumn("kind", F.lit("growth")).unionByName(position.withColumn("kind", F.lit("position")))
    return both.select("kind", "year_month", "period_type", "brand_name", "region_name", "gap", "movement", "size_class", "status")


def _displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipe = Pipeline(spark, sf_dir)
    return mkt.displacement(mkt.market_rows(pipe.monthly()), large=pipe.large())


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.features(Pipeline(spark, sf_dir).all_periods("region"))


def _tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric value of the three grains and four periods."""
    pipe, out = Pipeline(spark, sf_dir), None
    for name, grain in GRAINS.items():
        rows = peers.tall(pipe.all_periods(name), grain).withColumn("grain", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "market_growth": _pick("own_growth", "market_growth"),
        "share_momentum": _pick("market_share", "share_momentum"),
        "competitor_growth": _pick("competitor_growth"),
        "market_growth_deviation": _pick("market_growth", "market_growth_deviation"),
        "competitor_segments": lambda s, d: _rivals(Pipeline(s, d)).drop("change"),
        "market_matrix": lambda s, d: mkt.market_matrix(_signals(s, d)).select(
            *KEY, "market_growth", "share_momentum", "pie", "slice", "archetype"
        ),
        "attribution": lambda s, d: mkt.attribution(_signals(s, d), _rivals(Pipeline(s, d))),
        "displacement": _displacement,
        "rule_findings": lambda s, d: peers.rule_findings(Pipeline(s, d).all_periods("region")),
        "peer_gap": _growth_gap,
        "gap_status": _gap_status,
        "metrics_tall": _tall,
        "knn_outliers": lambda s, d: near.outliers(_points(s, d)),
        "cluster_change": lambda s, d: clusters.cluster_change(_points(s, d)),
    }
