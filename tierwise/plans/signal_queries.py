"""Registered queries of tier 3: signals, loudness and composites of every brand in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.functions.numeric import rnd
from tierwise.functions.trajectory import variation
from tierwise.operators import composite as comp
from tierwise.operators import loudness as loud
from tierwise.operators import signals as sig
from tierwise.plans.metrics import Pipeline
from tierwise.specs import (
    REGION,
    ROLES,
    SIGNALS,
    Condition,
    GenericSignal,
    SignalSpec,
    combinations_by_grain,
)

POSITION = SIGNALS[ROLES["region_position"]]
GROWTH = SIGNALS[ROLES["region_growth"]]
PAIR = (POSITION.id, GROWTH.id)

# A signal over the sales fact itself: monthly units of each own brand and region.
UNITS_SIGNAL = GenericSignal(
    entity="region_name",
    time="year_month",
    metric="units",
    filters=(Condition("is_own_brand", "=", 1),),
    segment_by=("brand_name",),
    lags=(0, 1, 3),
    delta_lags=(1, 3),
    strength_kind="growth",
    loud_threshold=10.0,
)
FILTERED_SIGNAL = GenericSignal(
    entity="region_name",
    time="year_month",
    metric="market_share",
    filters=(
        Condition("period_type", "=", "MAT"),
        Condition("franchise", "IN", ["F1", "F2", "F3"]),
        Condition("brand_name", "!=", "Brand#2"),
        Condition("territory_id", ">=", "1"),
    ),
    segment_by=("brand_name", "territory_name"),
    carry=("mshare_deviation",),
)


def tables(pipe: Pipeline, specs: list[SignalSpec]) -> dict[tuple[str, str], DataFrame]:
    wanted = dict.fromkeys((s.grain.name, s.period_type) for s in specs)
    return {key: pipe.metrics(*key) for key in wanted}


def stacked(pipe: Pipeline, specs: list[SignalSpec], back: int | None = None) -> DataFrame:
    """All signals in one long frame; ``back`` keeps only the last months before the lags."""
    found = tables(pipe, specs)
    if back is not None:
        found = {key: sig.recent(t, None, back) for key, t in found.items()}
    return loud.stack(found, specs)


def analysis(spark: SparkSession, sf_dir: str, specs: list[SignalSpec]) -> DataFrame:
    pipe = Pipeline(spark, sf_dir)
    return loud.analyze(stacked(pipe, specs), sig.latest(pipe.metrics(REGION.name)), pipe.large())


def step_scale(pipe: Pipeline) -> DataFrame:
    """The scale of every signal, a written table of one row a signal."""
    return pipe.store.table("step_scale", lambda: loud.step_scale(stacked(pipe, list(SIGNALS.values()))))


def parts(
    spark: SparkSession, sf_dir: str, combos: list[tuple[str, ...]], weights: list[float] | None = None
) -> DataFrame:
    """Signal contributions of some combinations; the step scales are written once and read here."""
    pipe = Pipeline(spark, sf_dir)
    specs = [SIGNALS[i] for i in dict.fromkeys(i for c in combos for i in c)]
    scale = step_scale(pipe)
    asof = sig.latest(pipe.metrics(REGION.name))
    steps = comp.standard_steps(stacked(pipe, specs, back=3), scale, asof)
    return comp.contributions(steps, comp.combo_table(spark, combos, weights))


def rows(spark: SparkSession, sf_dir: str, combos: list[tuple[str, ...]], weights=None) -> DataFrame:
    return comp.composite_rows(parts(spark, sf_dir, combos, weights))


def _scores(spec: SignalSpec, *columns: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = Pipeline(spark, sf_dir).metrics(spec.grain.name, spec.period_type)
        scored = sig.signal_scores(table, spec)
        return scored.select("brand_name", spec.grain.entity, *columns) if columns else scored

    return run


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = loud.windows(stacked(Pipeline(spark, sf_dir), [POSITION]))
    points = [rnd(F.col(f"m{k}"), 2).alias(f"m{k}") for k in (3, 2, 1, 0)]
    v = rnd(variation(sig.oldest_first("m")), 3).alias("loudness")
    return wins.select("year_month", "brand_name", "entity", "rank", *points, v)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(POSITION, delta_lags=(1, 3), readout="delta")
    table = Pipeline(spark, sf_dir).metrics(spec.grain.name, spec.period_type)
    return sig.signal_scores(table, spec).orderBy(F.desc("mat_rank"), "brand_name", "region_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = list(SIGNALS.values())
    region = [s for s in every if s.grain is REGION]
    readout = replace(POSITION, delta_lags=(1, 3), readout="delta")
    loud_keys = ("signal_id", "brand_name", "entity")
    return {
        "latest_asof": lambda s, d: sig.latest_by_segment(Pipeline(s, d).sales(), UNITS_SIGNAL),
        "segment_values": lambda s, d: sig.segment_values(Pipeline(s, d).metrics("region"), FILTERED_SIGNAL),
        "filtered_signal": lambda s, d: sig.generic_signal(Pipeline(s, d).metrics("region"), FILTERED_SIGNAL),
        "generic_signal": lambda s, d: sig.generic_signal(Pipeline(s, d).sales(), UNITS_SIGNAL),
        "signal_trajectory": lambda s, d: sig.trajectory(Pipeline(s, d).metrics("region"), readout),
        "signal_strength": _scores(
            GROWTH, "magnitude", "net", "coherence", "signed_strength", "direction", "shape"
        ),
        "signal_relevance": _scores(
            POSITION, "mat_rank", "magnitude", "consistency", "materiality", "loudness", "horizon", "score", "band"
        ),
        "signal_report": _report,
        "scatter": lambda s, d: sig.scatter(Pipeline(s, d).metrics("region")),
        "trails": lambda s, d: sig.trails(Pipeline(s, d).metrics("region")),
        "signal_windows": _windows,
        "signal_slope": lambda s, d: sig.slope(Pipeline(s, d).metrics("region"), POSITION),
        "step_scale": lambda s, d: step_scale(Pipeline(s, d)),
        "vs_self": lambda s, d: analysis(s, d, [POSITION]).select(*loud_keys, "loudness", "vs_self"),
        "vs_peers": lambda s, d: analysis(s, d, [GROWTH]).select(*loud_keys, "loudness", "vs_peers"),
        "loudness_tags": lambda s, d: analysis(s, d, region).select(*loud_keys, "vs_peers", "vs_self", "tag"),
        "signal_reads": lambda s, d: analysis(s, d, region).select(*loud_keys, "read"),
        "analyze_signal": lambda s, d: loud.loudest_first(analysis(s, d, [POSITION])),
        "analyze_all": lambda s, d: loud.loudest_first(analysis(s, d, every)),
        "composite": lambda s, d: rows(s, d, [PAIR], [0.6, 0.4]).drop("read", "main_driver", "solo_worst"),
        "composite_contrib": lambda s, d: parts(s, d, [PAIR]).select(
            "combo_id",
            "signal_id",
            "brand_name",
            "entity",
            "loudness",
            "direction",
            "net",
            "znet",
            *[rnd(F.col(f"m{k}"), 2).alias(f"m{k}") for k in (3, 2, 1, 0)],
        ),
        "composite_reads": lambda s, d: rows(s, d, [PAIR]).select(
            "combo_id", "brand_name", "entity", "main_driver", "read"
        ),
        "composite_top": lambda s, d: comp.top_loudest(rows(s, d, [PAIR]), large=Pipeline(s, d).large()).select(
            "combo_id", "brand_name", "entity", "composite_loudness", "place"
        ),
        "composite_scorecard": lambda s, d: comp.scorecard(rows(s, d, [PAIR])),
        "composite_search": lambda s, d: comp.scorecard(rows(s, d, combinations_by_grain(3))).orderBy(
            F.desc("loudness_p95"), "combo_id", "brand_name"
        ),
    }
