"""Tier 3: several signals of one grain as one path in standardised units."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import rnd
from tierwise.operators import order
from tierwise.operators.loudness import SERIES, per_signal
from tierwise.operators.signals import complete, with_lags
from tierwise.specs import SIGNALS, SignalSpec, normalise_weights

ROW = ("combo_id", "brand_name", "entity")
BUNDLE = ("combo_id", "brand_name")


def combo_table(
    spark: SparkSession,
    combos: Iterable[tuple[str, ...]],
    weights: list[float] | None = None,
    signals: Mapping[str, SignalSpec] = SIGNALS,
) -> DataFrame:
    """One row per combination and signal. Holds configuration only, so its size does not follow
    the data."""
    rows = []
    for ids in combos:
        grains = sorted({signals[i].grain.name for i in ids})
        if len(grains) > 1:
            raise ValueError(f"a composite cannot mix the grains {grains}")
        factors = normalise_weights(ids, weights)
        rows += [("+".join(ids), i, k, len(ids), float(factors[i])) for k, i in enumerate(ids)]
    return spark.createDataFrame(
        rows, "combo_id string, signal_id string, position int, size int, factor double"
    )


def standard_steps(recent: DataFrame, scale: DataFrame, asof: Column) -> DataFrame:
    """The as-of window of every series with its three steps in units of the signal's step scale."""
    lagged = with_lags(recent, SERIES, {"m": "value"}, 3)
    current = lagged.filter((F.col("year_month") == asof) & complete("m", range(4)))
    # A series with four known months has steps, so its signal always has a scale.
    scaled = current.withColumn("scale", per_signal(scale, "scale"))
    z = {f"z{k}": (F.col(f"m{3 - k}") - F.col(f"m{4 - k}")) / F.col("scale") for k in (1, 2, 3)}
    return scaled.withColumns(z)


def contributions(steps: DataFrame, combos: DataFrame) -> DataFrame:
    """One row per combination, brand, entity and signal, for entities that have all signals.

    ``good`` is the net movement towards the signal's good side, unrounded.
    """
    whole = F.count(F.lit(1)).over(W.partitionBy(*ROW))
    weighted = steps.join(combos, "signal_id").withColumns(
        {f"w{k}": F.col(f"z{k}") * F.col("factor") for k in (1, 2, 3)}
    )
    total = F.col("w1") + F.col("w2") + F.col("w3")
    return (
        weighted.withColumn("_have", whole)
        .filter(F.col("_have") == F.col("size"))
        .withColumns(
            {
                "loudness": rnd(F.abs("w1") + F.abs("w2") + F.abs("w3"), 3),
                "good": rnd(F.when(F.col("better"), total).otherwise(-total), 9),
                "net": rnd(F.col("m0") - F.col("m3"), 2),
            }
        )
        .withColumns(
            {
                "znet": rnd(F.col("good"), 2),
                "direction": F.when(F.col("good") == 0, "flat")
                .when(F.col("good") > 0, "improving")
                .otherwise("deteriorating"),
            }
        )
        .drop("_have")
    )


def composite_rows(parts: DataFrame) -> DataFrame:
    """Path length, net and directedness of every combination, brand and entity, with its read.

    Sums per entity have at most one row per signal of the combination, and partial sums are
    combined before the shuffle.
    """

    def norm(k: int) -> Column:
        return F.sqrt(F.sum(F.col(f"w{k}") * F.col(f"w{k}")))

    top = F.max_by(
        F.struct("signal_id", "direction"), F.struct(F.col("loudness"), -F.col("position"))
    )
    summed = parts.groupBy("level", *ROW).agg(
        rnd(norm(1) + norm(2) + norm(3), 9).alias("path"),
        rnd(F.sum("good"), 9).alias("good"),
        F.sqrt(F.sum(F.col("good") * F.col("good"))).alias("reach"),
        F.countDistinct(F.when(F.col("direction") != "flat", F.col("direction"))).alias("ways"),
        top.alias("top"),
        F.min("znet").alias("solo_worst"),
    )
    net = rnd(F.col("good"), 3)
    ker = F.when(F.col("path") > 0, F.signum(net) * F.col("reach") / F.nullif(F.col("path"), F.lit(0.0)))
    # The wording of the reading.
    agree = F.when(
        F.col("ways") <= 1, "reinforcing — components move the same way"
    ).otherwise("divergent — components pull opposite ways")
    text = F.concat(
        F.lit("Loud composite ("),
        rnd(F.col("path"), 1).cast("decimal(20,1)").cast("string"),
        F.lit("σ), "),
        agree,
        F.lit("; driven mainly by "),
        F.col("top.signal_id"),
        F.lit(" ("),
        F.col("top.direction"),
        F.lit(")."),
    )
    return summed.select(
        "level",
        *ROW,
        rnd(F.col("path"), 3).alias("composite_loudness"),
        net.alias("composite_net"),
        rnd(F.coalesce(ker, F.lit(0.0)), 3).alias("composite_ker"),
        F.col("top.signal_id").alias("main_driver"),
        text.alias("read"),
        "solo_worst",
    )


def _place() -> Column:
    """Position by loudness within a bundle, ties by entity name."""
    return F.row_number().over(W.partitionBy(*BUNDLE).orderBy(F.desc("composite_loudness"), "entity"))


def top_loudest(rows: DataFrame, top_share: float = 0.05, large: bool = False) -> DataFrame:
    """The loudest slice of every bundle: at least one row. Large bundles are numbered over ranges of the loudness."""
    if large:
        placed = order.within(rows, BUNDLE, [F.desc("composite_loudness"), F.col("entity")], "entity")
        keep = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(top_share)).cast("int"))
        return placed.filter(F.col("place") <= keep).select(*rows.columns, F.col("place").cast("int").alias("place"))
    n = F.count(F.lit(1)).over(W.partitionBy(*BUNDLE))
    keep = F.greatest(F.lit(1), F.floor(n * F.lit(top_share)).cast("int"))
    return (
        rows.withColumns({"place": _place(), "_keep": keep})
        .filter(F.col("place") <= F.col("_keep"))
        .drop("_keep")
    )


def scorecard(rows: DataFrame, f: float = 0.95, top: int = 3) -> DataFrame:
    """One row per bundle: synergy, percentiles by floor index, totals and the loudest entities.

    Percentiles are picked by row number, so a bundle is sorted by Spark and never gathered into
    an array; a bundle holds one row per entity of a brand.
    """

    def place(column: str) -> Column:
        return F.row_number().over(W.partitionBy(*BUNDLE).orderBy(column, "entity"))

    n = F.count(F.lit(1)).over(W.partitionBy(*BUNDLE))

    def index(share: float) -> Column:
        raw = F.floor(F.col("_n") * F.lit(share)).cast("int")
        return F.least(F.col("_n") - 1, F.greatest(F.lit(0), raw)) + 1

    measures = {"loudness": "composite_loudness", "net": "composite_net", "ker": "composite_ker"}
    placed = rows.withColumns(
        {"_n": n, "_top": _place(), **{f"_{k}": place(c) for k, c in measures.items()}}
    )

    def pick(name: str, share: float) -> Column:
        return rnd(F.max(F.when(F.col(f"_{name}") == index(share), F.col(measures[name]))), 3)

    leaders = [F.max(F.when(F.col("_top") == k, F.col("entity"))) for k in range(1, top + 1)]
    exact_net = F.sum(F.col("composite_net").cast("decimal(28,3)")).cast("double")
    return placed.groupBy("level", *BUNDLE).agg(
        rnd(F.min("solo_worst") - F.min("composite_net"), 3).alias("synergy"),
        pick("loudness", f).alias("loudness_p95"),
        rnd(exact_net, 3).alias("net_total"),
        pick("net", f).alias("net_best"),
        pick("net", 1 - f).alias("net_worst"),
        pick("ker", f).alias("ker_best"),
        pick("ker", 1 - f).alias("ker_worst"),
        F.max("composite_loudness").alias("max_loudness"),
        F.concat_ws(" | ", *leaders).alias("top_entities"),
    )
