"""Tier 4: entities classified over one or more signals, with severity and memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import rnd
from tierwise.functions.trajectory import strength
from tierwise.operators.signals import (
    _asof,
    complete,
    filtered,
    last_readings,
    oldest_first,
    recent,
    with_lags,
)
from tierwise.sources.files import require_columns
from tierwise.specs import (
    LOUDNESS,
    QUADRANTS,
    REGION,
    Axis,
    Condition,
    FindingSpec,
    GenericSignal,
    SignalSpec,
)

MAX_AXES = 6
REPORT_DETERIORATION = -0.3
RED_SCORE = 3
ESCALATE_AFTER = 3


def _frame_key(signal: GenericSignal) -> tuple:
    return (signal.filters, signal.entity, signal.time, signal.segment_by, signal.carry)


def _readings(table: DataFrame, axes: Sequence[Axis], asof: str | None) -> DataFrame:
    """As-of readings of axes that share entity, time, filters and segments: one window pass."""
    first = axes[0].signal
    require_columns(table, [first.entity, first.time, *first.segment_by, *first.carry])
    require_columns(table, [a.signal.metric for a in axes], "metric")
    rows = filtered(table, first.filters)
    at = _asof(rows, asof, first.time)
    wanted = {f"{a.name}_": (a.signal.metric, a.signal.oldest) for a in axes}
    upto = rows.filter(F.col(first.time) <= at)
    now = last_readings(upto, [*first.segment_by, first.entity], first.time, wanted).filter(
        F.col(first.time) == at
    )
    for a in axes:
        now = now.filter(complete(f"{a.name}_", range(a.signal.oldest + 1)))
    out: list[Column] = []
    for a in axes:
        path = oldest_first(f"{a.name}_", a.signal.oldest)
        kind = F.lit(a.signal.strength_kind)
        out += [F.col(f"{a.name}_0").alias(f"{a.name}_now"), path[0].alias(f"{a.name}_oldest")]
        out += strength(path, kind, a.signal.higher_is_better, f"{a.name}_")
    return now.select(
        *first.segment_by,
        F.col(first.entity).alias("entity"),
        F.col(first.time).alias("year_month"),
        *first.carry,
        *out,
    )


def axis_readings(table: DataFrame | Mapping[str, DataFrame], spec: FindingSpec, asof: str | None = None) -> DataFrame:
    """Readings of every axis, for entities present in all of them.

    Axes over the same rows share one window pass. Others are joined on segment and entity, the
    keys their windows are partitioned by already.
    """
    if not 1 <= len(spec.axes) <= MAX_AXES:
        raise ValueError(f"a finding needs 1 to {MAX_AXES} axes")
    groups: dict[tuple, list[Axis]] = {}
    for a in spec.axes:
        source = table if isinstance(table, DataFrame) else table[a.name]
        groups.setdefault((id(source), *_frame_key(a.signal)), []).append(a)
    out = None
    for axes in groups.values():
        source = table if isinstance(table, DataFrame) else table[axes[0].name]
        part = _readings(source, axes, asof)
        if out is None:
            out = part
        else:
            keys = [*axes[0].signal.segment_by, "entity", "year_month"]
            out = out.join(part.drop(*axes[0].signal.carry), keys)
    return out


def _good(axis: Axis) -> Column:
    now = F.col(f"{axis.name}_now")
    return now >= axis.threshold if axis.positive_is_good else now <= axis.threshold


def _band(score: Column, bands: Mapping[str, int]) -> Column:
    return (
        F.when(score >= bands["critical"], "critical")
        .when(score >= bands["high"], "high")
        .when(score >= bands["moderate"], "moderate")
        .otherwise("low")
    )


def _side(axis: Axis) -> Column:
    return F.when(_good(axis), "good").otherwise("bad")


def classify(readings: DataFrame, spec: FindingSpec) -> DataFrame:
    """First matching rule, severity per axis, total score and band.

    Without rules every combination of sides is its own finding: good_bad and so on.
    """
    side = {a.name: _side(a) for a in spec.axes}
    if spec.rules:
        key, label = F.lit("unclassified"), F.lit("Unclassified")
        for rule in reversed(spec.rules):
            match = F.lit(True)
            for name, wanted in rule.sides.items():
                match = match & (side[name] == wanted)
            key = F.when(match, rule.key).otherwise(key)
            label = F.when(match, rule.label).otherwise(label)
    else:
        key = F.concat_ws("_", *side.values())
        label = F.concat_ws(", ", *[F.concat(F.lit(n + ": "), s) for n, s in side.items()])
    sev = {}
    for a in spec.axes:
        bad = (~_good(a)).cast("int")
        down = (F.col(f"{a.name}_net") < -spec.deterioration_delta).cast("int")
        loud = (F.col(f"{a.name}_magnitude") >= a.signal.loud_threshold).cast("int")
        sev[f"{a.name}_sev"] = F.least(F.lit(3), bad + down + loud)
    scored = readings.withColumns({"finding_key": key, "finding_label": label, **sev})
    total = F.lit(0)
    for name in sev:
        total = total + F.col(name)
    return scored.withColumn("severity_score", total).withColumn(
        "severity_band", _band(F.col("severity_score"), spec.bands)
    )


def classify_findings(table, spec: FindingSpec, asof: str | None = None) -> DataFrame:
    return classify(axis_readings(table, spec, asof), spec)


def promote(composite: Sequence[SignalSpec], spec_id: str, carry: tuple[str, ...] = ()) -> FindingSpec:
    """A finding definition with one axis per signal of a composite: threshold 0, positive is good."""


    axes = tuple(
        Axis(
            s.id,
            GenericSignal(
                entity=s.grain.entity,
                time="year_month",
                metric=s.metric,
                filters=(Condition("period_type", "=", s.period_type),),
                segment_by=("brand_name",),
                lags=s.lags,
                higher_is_better=s.higher_is_better,
                strength_kind=s.strength_kind,
                loud_threshold=LOUDNESS[s.strength_kind]["loud"],
                carry=carry,
            ),
        )
        for s in composite
    )
    return FindingSpec(spec_id, axes)


# ---------------------------------------------------------------- share x growth report


def quadrant(ms: Column, gr: Column) -> Column:
    """Finding by the current level of both axes."""
    return (
        F.when((ms < 0) & (gr < 0), "losing_both")
        .when(gr < 0, "slipping")
        .when(ms < 0, "catching_up")
        .otherwise("star")
    )


def quadrant_label(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in QUADRANTS.items():
        out = F.when(key == name, label).otherwise(out)
    return out


def _axis_severity(now: Column, net: Column, magnitude: Column, kind: str) -> Column:
    below, down = now < 0, net < REPORT_DETERIORATION
    loud = below & down & (magnitude >= LOUDNESS[kind]["loud"])
    return below.cast("int") + down.cast("int") + loud.cast("int")


def findings(metrics: DataFrame, asof: str | None = None, history: bool = False) -> DataFrame:
    """Share x growth findings of every brand and region with their memory.

    At the as-of month only the last six months are read; ``history`` scores every month. A month's
    red flag is computed once and looked back on with two lags, over the partitioning of the first
    window, so the memory costs no further shuffle.
    """
    rows = metrics if history else recent(metrics, asof, 5)
    keys = REGION.series_keys
    lagged = with_lags(rows, keys, {"ms": "mshare_deviation", "gr": "growth_deviation"}, 3)
    whole = complete("ms", range(4)) & complete("gr", range(4))
    ms, gr = oldest_first("ms"), oldest_first("gr")
    scored = lagged.select(
        "*",
        whole.alias("_whole"),
        *strength(ms, F.lit("position"), True, "ms_"),
        *strength(gr, F.lit("growth"), True, "growth_"),
    )
    scored = scored.withColumns(
        {
            "ms_now": rnd(F.col("ms0"), 2),
            "growth_now": rnd(F.col("gr0"), 2),
            "ms_sev": _axis_severity(F.col("ms0"), F.col("ms_net"), F.col("ms_magnitude"), "position"),
            "growth_sev": _axis_severity(F.col("gr0"), F.col("growth_net"), F.col("growth_magnitude"), "growth"),
            "finding_key": quadrant(F.col("ms0"), F.col("gr0")),
        }
    ).withColumn("severity_score", F.col("ms_sev") + F.col("growth_sev"))
    red = F.when(
        F.col("_whole"),
        (F.col("finding_key") == "losing_both") & (F.col("severity_score") >= RED_SCORE),
    )
    series = W.partitionBy(*keys).orderBy("year_month")
    scored = scored.withColumn("_red0", red)
    scored = scored.withColumns({f"_red{k}": F.lag("_red0", k).over(series) for k in (1, 2)})

    def is_red(k: int) -> Column:
        return F.coalesce(F.col(f"_red{k}"), F.lit(False))

    run = (
        F.when(is_red(0) & is_red(1) & is_red(2), 3)
        .when(is_red(0) & is_red(1), 2)
        .when(is_red(0), 1)
        .otherwise(0)
    )
    out = scored.withColumns(
        {
            "finding_label": quadrant_label(F.col("finding_key")),
            "severity_band": _band(F.col("severity_score"), {"critical": 5, "high": 3, "moderate": 2}),
            "red_now": is_red(0),
            "months_red": run,
            "improved": is_red(1) & ~is_red(0),
            "escalate": run >= ESCALATE_AFTER,
            "market_share": rnd(F.col("market_share"), 1),
            "mat_rank": F.col("rank_sales_eur"),
        }
    )
    if not history:
        out = out.filter(F.col("year_month") == _asof(metrics, asof))
    return out


# Columns of one finding row, without its evidence.
FINDING_COLUMNS = (
    "year_month",
    "brand_name",
    "region_name",
    "territory_name",
    "finding_key",
    "finding_label",
    "severity_score",
    "severity_band",
    "ms_now",
    "ms_sev",
    "growth_now",
    "growth_sev",
    "market_share",
    "mat_rank",
    "months_red",
    "escalate",
    "improved",
)


def flagged(scored: DataFrame) -> DataFrame:
    """Findings proper: rows whose two windows have no gap."""
    return scored.filter("_whole")


def memory(scored: DataFrame) -> DataFrame:
    return scored.select(
        "year_month", "brand_name", "region_name", "red_now", "months_red", "improved", "escalate"
    )


def worst_first(rows: DataFrame) -> DataFrame:
    order = F.lit(len(QUADRANTS))
    for i, key in enumerate(QUADRANTS):
        order = F.when(F.col("finding_key") == key, i).otherwise(order)
    return rows.orderBy(F.desc("severity_score"), order, F.desc("mat_rank"), "brand_name", "region_name")


def recovered(scored: DataFrame) -> DataFrame:
    """Improved entities without a finding in the same month."""
    key = ["brand_name", "region_name", "year_month"]
    return (
        scored.filter("improved")
        .join(flagged(scored).select(*key), key, "left_anti")
        .select("brand_name", "region_name", "territory_name", "mat_rank")
    )


def summary(rows: DataFrame) -> DataFrame:
    """Count per brand and finding key, zeros included, in the fixed order of the keys."""
    counts = rows.groupBy("brand_name").agg(
        *[F.count(F.when(F.col("finding_key") == k, 1)).alias(f"_{k}") for k in QUADRANTS]
    )
    fields = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(k).alias("finding_key"),
            F.lit(label).alias("finding_label"),
            F.col(f"_{k}").alias("entities"),
        )
        for i, (k, label) in enumerate(QUADRANTS.items())
    ]
    return counts.select("brand_name", F.inline(F.array(*fields)))


def axes_snapshot(spec: FindingSpec) -> Column:
    """The evidence of a classified definition as JSON: for each axis its reading, strength and severity."""
    names = ("now", "oldest", "magnitude", "net", "coherence", "direction", "shape", "sev")
    return F.to_json(
        F.struct(*[F.struct(*[F.col(f"{a.name}_{n}").alias(n) for n in names]).alias(a.name) for a in spec.axes])
    )


def run_summary(classified: DataFrame, keys: Mapping[str, str] | None = None) -> DataFrame:
    """Count per brand, finding key and label of any definition's rows.

    With ``keys`` (key to label) absent keys count 0, in their order; without, the keys that occur.
    """
    rows = classified.groupBy("brand_name", "finding_key", "finding_label").agg(F.count(F.lit(1)).alias("entities"))
    if keys is None:
        return rows
    wanted = F.array(*[F.struct(F.lit(k).alias("finding_key"), F.lit(v).alias("finding_label")) for k, v in keys.items()])
    every = classified.select("brand_name").distinct().select("brand_name", F.inline(wanted))
    counted = rows.select("brand_name", "finding_key", "entities")
    return every.join(counted, ["brand_name", "finding_key"], "left").fillna(0, ["entities"])


def snapshot() -> Column:
    """The evidence of a finding as JSON: both series, oldest first, and their strengths."""

    def series(p: str) -> Column:
        return F.array(*[rnd(c, 2) for c in oldest_first(p)])

    def scores(p: str) -> Column:
        names = ("magnitude", "net", "coherence", "direction", "signed_strength", "shape")
        return F.struct(*[F.col(f"{p}_{n}").alias(n) for n in names])

    return F.to_json(
        F.struct(
            series("ms").alias("ms_series"),
            scores("ms").alias("ms_strength"),
            series("gr").alias("growth_series"),
            scores("growth").alias("growth_strength"),
        )
    )
