"""Tier 3: a comparative metric followed over time, scored by its own path and its relevance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import half_up, rnd
from tierwise.functions.trajectory import persistence, relevance, strength
from tierwise.sources.files import require_columns
from tierwise.specs import REGION, Condition, GenericSignal, SignalSpec


def latest(df: DataFrame, time: str = "year_month") -> Column:
    """The last time value of the table, as a scalar subquery that the scan can push down."""
    return df.agg(F.max(time)).scalar()


def _asof(df: DataFrame, asof: str | None, time: str = "year_month") -> Column:
    return latest(df, time) if asof is None else F.lit(asof)


def recent(metrics: DataFrame, asof: str | None, back: int) -> DataFrame:
    """Rows of the last ``back + 1`` months up to the as-of month.

    Every series of a metric table has every month, so cutting months before the lags gives the
    same lags and keeps the shuffle independent of the length of the history. The cut months come
    from a scan of the month column alone.
    """
    months = metrics.select("year_month").distinct()
    if asof is not None:
        months = months.filter(F.col("year_month") <= asof)
    kept = months.orderBy(F.desc("year_month")).limit(back + 1)
    first = kept.agg(F.min("year_month")).scalar()
    last = kept.agg(F.max("year_month")).scalar()
    return metrics.filter((F.col("year_month") >= first) & (F.col("year_month") <= last))


def with_lags(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], oldest: int) -> DataFrame:
    """Adds ``<prefix>0 .. <prefix><oldest>`` per prefix -> column; one window for all of them."""
    series = W.partitionBy(*keys).orderBy("year_month")
    out = {}
    for prefix, column in columns.items():
        out[f"{prefix}0"] = F.col(column)
        for k in range(1, oldest + 1):
            out[f"{prefix}{k}"] = F.lag(column, k).over(series)
    return df.withColumns(out)


def oldest_first(prefix: str, oldest: int = 3) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in range(oldest, -1, -1)]


def complete(prefix: str, lags: Sequence[int]) -> Column:
    """True where no lag of the series is missing."""
    ok = F.lit(True)
    for k in lags:
        ok = ok & F.col(f"{prefix}{k}").isNotNull()
    return ok


def at_asof(metrics: DataFrame, columns: Mapping[str, str], keys: Sequence[str], asof: str | None, oldest: int = 3) -> DataFrame:
    """Lags of several metrics in the as-of month, for every brand and entity."""
    cut = recent(metrics, asof, oldest)
    return with_lags(cut, keys, columns, oldest).filter(F.col("year_month") == _asof(metrics, asof))


def predicate(filters: Sequence[Condition]) -> Column:
    """AND of the conditions; values are literals, never SQL text."""
    compare = {
        "=": lambda c, v: c == v,
        "!=": lambda c, v: c != v,
        ">": lambda c, v: c > v,
        "<": lambda c, v: c < v,
        ">=": lambda c, v: c >= v,
        "<=": lambda c, v: c <= v,
        "IN": lambda c, v: c.isin(list(v) if isinstance(v, (list, tuple)) else [v]),
    }
    out = F.lit(True)
    for f in filters:
        if f.op not in compare:
            raise ValueError(f"unknown operator {f.op!r}")
        out = out & compare[f.op](F.col(f.column), f.value)
    return out


def filtered(table: DataFrame, filters: Sequence[Condition], segment: Mapping[str, object] | None = None) -> DataFrame:
    segment = dict(segment or {})
    require_columns(table, [f.column for f in filters], "filter column")
    require_columns(table, list(segment), "segment column")
    return table.filter(predicate([*filters, *(Condition(c, "=", v) for c, v in segment.items())]))


def segment_values(table: DataFrame, signal: GenericSignal) -> DataFrame:
    """Distinct values per segment column under the filters, in order."""
    rows = filtered(table, signal.filters)
    require_columns(table, signal.segment_by, "segment column")
    out = None
    for c in signal.segment_by:
        part = rows.select(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.orderBy("segment", "value")


def latest_by_segment(table: DataFrame, signal: GenericSignal) -> DataFrame:
    """The as-of time of every segment: its last time under the filters."""
    rows = filtered(table, signal.filters)
    return rows.groupBy(*signal.segment_by).agg(F.max(signal.time).alias("asof"))


def last_readings(
    rows: DataFrame, keys: Sequence[str], time: str, columns: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """The last row of every series with its lags, ``<prefix>0 .. <prefix><oldest>`` per column.

    ``columns`` maps a prefix to (column, oldest lag). Only the last rows of a series matter, and a
    row-number limit is applied on the map side, so a series that holds a large part of the table
    sends a handful of rows per task through the shuffle.
    """
    newest = W.partitionBy(*keys).orderBy(F.desc(time))
    back = max(n for _, n in columns.values())
    kept = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= back + 1)
    lags = {
        f"{prefix}{k}": (F.lead(column, k).over(newest) if k else F.col(column)).cast("double")
        for prefix, (column, oldest) in columns.items()
        for k in range(oldest + 1)
    }
    return kept.withColumns(lags).filter(F.col("_n") == 1).drop("_n")


def generic_signal(
    table: DataFrame,
    signal: GenericSignal,
    segment: Mapping[str, object] | None = None,
    asof: str | None = None,
) -> DataFrame:
    """A signal over any table, for every segment at once.

    Lags are consecutive rows of a series. The as-of time defaults to the last one of each segment;
    it is one row per segment, joined on the segment.
    """
    require_columns(table, [signal.entity, signal.time, signal.metric, *signal.segment_by, *signal.carry])
    rows = filtered(table, signal.filters, segment)
    seg = list(signal.segment_by)
    if asof is not None:
        rows = rows.filter(F.col(signal.time) <= asof)
    n = signal.oldest
    lagged = last_readings(rows, [*seg, signal.entity], signal.time, {"v": (signal.metric, n)})
    if asof is not None:
        lagged = lagged.filter(F.col(signal.time) == asof)
    elif seg:
        last = rows.groupBy(*seg).agg(F.max(signal.time).alias("_asof"))
        lagged = lagged.join(last, seg).filter(F.col(signal.time) == F.col("_asof"))
    else:
        lagged = lagged.filter(F.col(signal.time) == latest(rows, signal.time))
    path = oldest_first("v", n)
    if n > 0:
        scores = [s for s in strength(path, F.lit(signal.strength_kind), signal.higher_is_better)]
    else:
        zero = F.lit(0.0)
        scores = [zero.alias(x) for x in ("magnitude", "net", "coherence", "signed_strength")]
        scores += [F.lit("flat").alias("direction"), F.lit("quiet").alias("shape")]
    deltas = [
        half_up(F.col("v0") - F.col(f"v{k}"), 3).alias(f"delta_{k}m")
        for k in signal.delta_lags
        if 0 < k <= n
    ]
    return lagged.filter(complete("v", range(n + 1))).select(
        *seg,
        F.col(signal.entity).alias("entity"),
        F.col(signal.time).alias("asof"),
        *signal.carry,
        F.col("v0").alias("now"),
        *path[:-1],
        *deltas,
        *scores,
    )


def trajectory(metrics: DataFrame, spec: SignalSpec) -> DataFrame:
    """Every month's reading of a template: now, its lags and, for a delta readout, the deltas."""
    require_columns(metrics, [spec.metric, spec.grain.entity])
    lagged = with_lags(metrics, spec.grain.series_keys, {"m": spec.metric}, spec.oldest)
    deltas = [(F.col("m0") - F.col(f"m{k}")).alias(f"delta_{k}m") for k in spec.delta_lags]
    return lagged.select(
        "year_month",
        "brand_name",
        spec.grain.entity,
        F.col("m0").alias("now"),
        *[F.col(f"m{k}") for k in spec.lags if k],
        *(deltas if spec.readout == "delta" else []),
    )


def signal_scores(metrics: DataFrame, spec: SignalSpec, asof: str | None = None) -> DataFrame:
    """Strength and relevance of a template in the as-of month, for every brand and entity.

    The materiality rank rides through the window, so no join back to the metric table is needed.
    """
    require_columns(metrics, [spec.metric, spec.grain.entity, spec.materiality_from])
    kind = F.lit(spec.strength_kind)
    lags = sorted(spec.lags, reverse=True)
    rows = at_asof(metrics, {"m": spec.metric}, spec.grain.series_keys, asof, spec.oldest).filter(
        F.col(f"m{lags[0]}").isNotNull()
    )
    path = [F.col(f"m{k}") for k in lags]
    scored = rows.withColumn("mat_rank", F.col(spec.materiality_from)).select(
        "*", *strength(path, kind, spec.higher_is_better)
    )
    period = F.lit(spec.period_type)
    return scored.select(
        "year_month",
        *spec.grain.id_columns,
        "mat_rank",
        rnd(F.col("m0"), 2).alias("now"),
        *[rnd(F.col(f"m{k}"), 2).alias(f"m{k}") for k in lags if k],
        *[rnd(F.col("m0") - F.col(f"m{k}"), 2).alias(f"delta_{k}m") for k in spec.delta_lags],
        "magnitude",
        "net",
        "coherence",
        "signed_strength",
        "direction",
        "shape",
        persistence(F.col("coherence")).alias("consistency"),
        *relevance(F.col("mat_rank"), F.col("magnitude"), period, kind),
    )


def scatter(metrics: DataFrame, asof: str | None = None) -> DataFrame:
    """Share against growth deviation at the as-of month."""
    return metrics.filter(
        (F.col("year_month") == _asof(metrics, asof))
        & F.col("mshare_deviation").isNotNull()
        & F.col("growth_deviation").isNotNull()
    ).select(
        "brand_name",
        "region_name",
        "territory_name",
        rnd(F.col("mshare_deviation"), 2).alias("x"),
        rnd(F.col("growth_deviation"), 2).alias("y"),
        F.col("rank_sales_eur").alias("mat_rank"),
    )


# Trail prefix -> (metric, decimals); None keeps the value.
TRAILS = {
    "x": ("mshare_deviation", 2),
    "y": ("growth_deviation", 2),
    "size": ("sales_eur", 0),
    "rank": ("rank_sales_eur", None),
    "share": ("market_share", 2),
    "units": ("units", 0),
    "growth": ("growth_py_sales", 2),
}


def trails(metrics: DataFrame, asof: str | None = None) -> DataFrame:
    """Four-month trails of position, growth, size and more; needs the oldest point of both axes."""
    rows = at_asof(metrics, {p: m for p, (m, _) in TRAILS.items()}, REGION.series_keys, asof)
    rows = rows.filter(F.col("x3").isNotNull() & F.col("y3").isNotNull())
    points = [
        (F.col(f"{p}{k}") if dp is None else rnd(F.col(f"{p}{k}").cast("double"), dp)).alias(f"{p}{k}")
        for p, (_, dp) in TRAILS.items()
        for k in (3, 2, 1, 0)
    ]
    return rows.select("brand_name", "region_name", "territory_name", *points)


def slope(metrics: DataFrame, spec: SignalSpec, asof: str | None = None) -> DataFrame:
    """Least-squares slope per month over the window of a template, oldest to now."""
    n = spec.oldest + 1
    rows = at_asof(metrics, {"m": spec.metric}, spec.grain.series_keys, asof, spec.oldest)
    mean_t = (n - 1) / 2.0
    spread = sum((t - mean_t) ** 2 for t in range(n))
    weighted = F.lit(0.0)
    for t, value in enumerate(oldest_first("m", spec.oldest)):
        weighted = weighted + value * F.lit(t - mean_t)
    return rows.filter(complete("m", range(n))).select(
        "brand_name", spec.grain.entity, rnd(rnd(weighted, 6) / F.lit(spread), 4).alias("slope")
    )
