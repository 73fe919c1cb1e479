"""Tier 3: loudness of many signals against peers and against their own past."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import rnd
from tierwise.functions.trajectory import strength, variation
from tierwise.operators import order
from tierwise.operators.signals import complete, oldest_first, with_lags
from tierwise.specs import (
    CONSTANT_HISTORY_SCORE,
    LOUD_SHARE_OF_PEERS,
    MIN_PAST_WINDOWS,
    UNUSUAL_DEVIATIONS,
    SignalSpec,
)

SERIES = ("signal_id", "brand_name", "entity")
IDS = ("signal_id", "level", "brand_name", "entity")

# Plain-language phrases.
SHAPE_PHRASES = {"trend": "a clean directional move", "mixed": "a partial-direction move"}
UNSTABLE_PHRASE = "Swinging hard with no clear net direction"
QUIET_PHRASE = "Little net movement"
TAG_PHRASES = {
    "eruption": "loud vs peers and a break from its own calm history",
    "chronic": "loud vs peers but typical for this region",
    "stirring": "unusual for this region, not yet loud vs peers",
}


def stack(tables: Mapping[tuple[str, str], DataFrame], specs: list[SignalSpec]) -> DataFrame:
    """All signals in one long frame: signal_id, level, brand, entity, month, rank and value.

    Tables are keyed by (grain, period). A table is scanned once for all of its signals, so one
    window pass serves every signal at every grain.
    """
    out = None
    for (grain, period), table in tables.items():
        mine = [s for s in specs if s.grain.name == grain and s.period_type == period]
        if not mine:
            continue
        fields = [
            F.struct(
                F.lit(s.id).alias("signal_id"),
                F.lit(s.strength_kind).alias("kind"),
                F.lit(s.higher_is_better).alias("better"),
                F.col(s.metric).cast("double").alias("value"),
            )
            for s in mine
        ]
        rows = table.select(
            F.lit(grain).alias("level"),
            "brand_name",
            F.col(mine[0].grain.entity).alias("entity"),
            "year_month",
            F.col("rank_sales_eur").alias("rank"),
            F.inline(F.array(*fields)),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def windows(stacked: DataFrame) -> DataFrame:
    """Every month's four-point window without gaps, with its path length."""
    lagged = with_lags(stacked, SERIES, {"m": "value"}, 3).filter(complete("m", range(4)))
    return lagged.withColumn("v", variation(oldest_first("m")))


def vs_self(wins: DataFrame, asof: Column) -> DataFrame:
    """As-of windows with the robust z-score of v against the past windows of the same series.

    Medians run over the series partition that the lags have built already; a series holds one row
    per month, so a group is bounded by the months covered.
    """
    series = W.partitionBy(*SERIES)
    past = F.when(F.col("year_month") < asof, F.col("v"))
    scored = (
        wins.withColumns({"_past": F.count(past).over(series), "_med": rnd(F.median(past).over(series), 6)})
        .withColumn(
            "_mad",
            rnd(
                F.median(F.when(F.col("year_month") < asof, F.abs(F.col("v") - F.col("_med")))).over(series),
                6,
            ),
        )
        .filter(F.col("year_month") == asof)
    )
    z = F.when(
        F.col("_mad") > 0, (F.col("v") - F.col("_med")) / F.nullif(F.col("_mad"), F.lit(0.0))
    ).otherwise(F.when(F.col("v") <= F.col("_med"), 0.0).otherwise(CONSTANT_HISTORY_SCORE))
    return scored.withColumn("vs_self", F.when(F.col("_past") >= MIN_PAST_WINDOWS, rnd(z, 2))).drop(
        "_past", "_med", "_mad"
    )


def vs_peers(current: DataFrame, large: bool = False) -> DataFrame:
    """Share of the brand's entities whose v is at most the own one. A large brand is worked off by ranges of v."""
    if large:
        share = lambda below, n, known: rnd((below + n) / known, 3)
        return order.ranked(current, ["signal_id", "brand_name"], "entity", {"vs_peers": "v"}, share)
    peers = W.partitionBy("signal_id", "brand_name").orderBy("v")
    return current.withColumn("vs_peers", rnd(F.cume_dist().over(peers), 3))


def tag(peers: Column, own: Column) -> Column:
    loud = peers >= LOUD_SHARE_OF_PEERS
    unusual = F.coalesce(own >= UNUSUAL_DEVIATIONS, F.lit(False))
    return (
        F.when(loud & unusual, "eruption").when(loud, "chronic").when(unusual, "stirring").otherwise("quiet")
    )


def read_text(direction: Column, shape: Column, tag_: Column, own: Column) -> Column:
    move = F.lit(SHAPE_PHRASES["mixed"])
    move = F.when(shape == "trend", SHAPE_PHRASES["trend"]).otherwise(move)
    base = (
        F.when(shape == "unstable", UNSTABLE_PHRASE)
        .when(shape == "quiet", QUIET_PHRASE)
        .otherwise(F.concat(F.initcap(direction), F.lit(" on "), move))
    )
    context = F.lit("")
    for name, phrase in TAG_PHRASES.items():
        context = F.when(tag_ == name, " — " + phrase).otherwise(context)
    unusual = F.coalesce(own >= UNUSUAL_DEVIATIONS, F.lit(False)) & tag_.isin("eruption", "stirring")
    sigma = F.concat(F.lit(" (≈"), F.rint(own).cast("long").cast("string"), F.lit("σ above its own normal)"))
    return F.concat(base, context, F.when(unusual, sigma).otherwise(""), F.lit("."))


def analyze(stacked: DataFrame, asof: Column, large: bool = False) -> DataFrame:
    """Loudness, trajectory scores, tag and read of every signal, brand and entity at the as-of month."""
    current = vs_peers(vs_self(windows(stacked), asof), large)
    scored = current.select("*", *strength(oldest_first("m"), F.col("kind"), F.col("better")))
    tagged = scored.withColumn("tag", tag(F.col("vs_peers"), F.col("vs_self")))
    return tagged.select(
        *IDS,
        "rank",
        *[rnd(F.col(f"m{k}"), 2).alias(f"m{k}") for k in (3, 2, 1, 0)],
        rnd(F.col("v"), 3).alias("loudness"),
        F.col("net").alias("net_change"),
        F.col("coherence").alias("ker"),
        "shape",
        "direction",
        "vs_peers",
        "vs_self",
        "tag",
        read_text(F.col("direction"), F.col("shape"), F.col("tag"), F.col("vs_self")).alias("read"),
    )


def loudest_first(rows: DataFrame) -> DataFrame:
    """Display order: loud against peers, then against the own past, unknown last."""
    return rows.orderBy(F.desc("vs_peers"), F.desc_nulls_last("vs_self"), "signal_id", "brand_name", "entity")


def per_signal(df: DataFrame, value: str) -> Column:
    """A value per signal as a map in a scalar subquery, looked up without a join.

    It holds one entry per signal definition, so its size is that of the configuration.
    """
    entries = F.collect_list(F.struct("signal_id", value))
    return F.element_at(df.agg(F.map_from_entries(entries)).scalar(), F.col("signal_id"))


FINE = 4096  # ranges into which a coarse one is cut


def _range(value: Column, fine: int = 1) -> Column:
    """Number of the range a value lies in, ascending with the value: some thousands of coarse ranges hold all doubles."""
    return F.floor(F.asinh(value) * (64 * fine))


def medians(counted: DataFrame, value: str, name: str) -> DataFrame:
    """Exact median per signal of values with counts n, found by ranges: (signal_id, name).

    Counts per coarse range tell where the middle lies, counts per fine range within it narrow that down, and only the
    values of the last range are put in order. So no task holds all distinct values of a signal.
    """
    total = counted.groupBy("signal_id").agg(F.sum("n").alias("_all"))
    middles = F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))
    wanted = total.select("signal_id", F.posexplode(middles).alias("side", "left"))
    inside: list[str] = []
    rows = counted.withColumn("r1", _range(F.col(value))).withColumn("r2", _range(F.col(value), FINE))
    for place in ("r1", "r2", value):
        sums = rows.join(wanted, ["signal_id", *inside]).groupBy("signal_id", "side", "left", *inside, place).agg(F.sum("n").alias("n"))
        order = W.partitionBy("signal_id", "side").orderBy(place)
        upto = sums.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
        found = upto.filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        wanted = found.select("signal_id", "side", *inside, place, (F.col("left") - F.col("upto") + F.col("n")).alias("left"))
        inside.append(place)
    return wanted.groupBy("signal_id").agg(rnd(F.sum(value) / 2, 6).alias(name))


def step_scale(stacked: DataFrame) -> DataFrame:
    """Median absolute deviation of one-month changes per signal, over all brands and entities.

    Changes are counted per distinct value first, and medians are found by ranges. Falls back to the standard deviation,
    then to 1.
    """
    series = W.partitionBy(*SERIES).orderBy("year_month")
    steps = (
        stacked.filter(F.col("value").isNotNull())
        .withColumn("d", rnd(F.col("value") - F.lag("value", 1).over(series), 6))
        .filter(F.col("d").isNotNull())
    )
    counted = steps.groupBy("signal_id", "d").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("signal_id").agg(
        F.sum("n").alias("steps"),
        F.sum(F.col("d") * F.col("n")).alias("s1"),
        F.sum(F.col("d") * F.col("d") * F.col("n")).alias("s2"),
    )
    middle = medians(counted, "d", "med")
    away = counted.groupBy("signal_id", rnd(F.abs(F.col("d") - per_signal(middle, "med")), 6).alias("a")).agg(F.sum("n").alias("n"))
    off = medians(away, "a", "mad")
    middle = middle.join(sums, "signal_id")
    mean = F.col("s1") / F.col("steps")
    deviation = rnd(F.sqrt(F.greatest(F.col("s2") / F.col("steps") - mean * mean, F.lit(0.0))), 6)
    scale = F.coalesce(
        F.nullif(F.col("mad"), F.lit(0.0)),
        F.nullif(F.when(F.col("steps") > 1, deviation), F.lit(0.0)),
        F.lit(1.0),
    )
    return middle.join(off, "signal_id").select("signal_id", "steps", "med", "mad", scale.alias("scale"))
