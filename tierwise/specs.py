"""Definitions and default settings of the engine: plain configuration, no data."""

from __future__ import annotations

from dataclasses import dataclass, field

PERIODS = ("Month", "RollQ", "YTD", "MAT")

# Rows in a full window, and rows back to the prior period.
WINDOW_ROWS = {"RollQ": 3, "MAT": 12}
PRIOR_PERIOD_ROWS = {"Month": 1, "RollQ": 3, "YTD": 12, "MAT": 1}
PRIOR_YEAR_ROWS = 12

# Rank column -> ranked measure.
RANKED = {
    "rank_units": "units",
    "rank_sales_eur": "sales_eur",
    "rank_mshare_dev": "mshare_deviation",
    "rank_growth_py": "growth_py_sales",
    "rank_growth_pp": "growth_pp_sales",
    "rank_growth_vs_fcst_eur": "growth_vs_fcst_eur",
    "rank_growth_vs_fcst_units": "growth_vs_fcst_units",
    "rank_growth_py_mshare_dev": "growth_py_mshare_dev",
    "rank_growth_pp_mshare_dev": "growth_pp_mshare_dev",
}

# Measures of a metric table, in output order.
MEASURES = (
    "units",
    "sales_eur",
    "market_share",
    "mshare_deviation",
    "growth_py_sales",
    "growth_pp_sales",
    "growth_py_units",
    "growth_pp_units",
    "growth_vs_fcst_eur",
    "growth_vs_fcst_units",
    "growth_deviation",
    "growth_py_mshare_dev",
    "growth_pp_mshare_dev",
)

# Coherence cut-offs and relevance horizon per period.
COHERENCE = {"trend": 0.6, "oscillation": 0.3}
RELEVANCE_HORIZON = {"MAT": 4, "YTD": 3, "RollQ": 2, "Month": 1}

# Our defaults: loudness thresholds in percentage points per strength kind.
LOUDNESS = {
    "position": {"moderate": 0.5, "loud": 1.0, "very_loud": 2.0},
    "growth": {"moderate": 5.0, "loud": 10.0, "very_loud": 15.0},
    "territory_position": {"moderate": 0.15, "loud": 0.3, "very_loud": 0.6},
    "territory_growth": {"moderate": 2.5, "loud": 5.0, "very_loud": 7.5},
}

# Thresholds of the two loudness axes.
LOUD_SHARE_OF_PEERS = 0.90
UNUSUAL_DEVIATIONS = 2.0
MIN_PAST_WINDOWS = 4
CONSTANT_HISTORY_SCORE = 6.0


@dataclass(frozen=True)
class Grain:
    """One level of the metric tables: what a series belongs to besides its brand."""

    name: str
    entity: str
    ids: tuple[str, ...]

    @property
    def series_keys(self) -> list[str]:
        """Keys of one series; franchise follows from the brand and is listed first so that
        windows reuse a partitioning by (franchise, entity)."""
        return list(dict.fromkeys(["franchise", "brand_name", self.entity]))

    @property
    def id_columns(self) -> list[str]:
        return ["brand_name", "franchise", *self.ids]


REGION = Grain("region", "region_name", ("region_name", "territory_id", "territory_name"))
TERRITORY = Grain("territory", "territory_name", ("territory_id", "territory_name"))
NATIONAL = Grain("national", "brand_name", ())
GRAINS = {g.name: g for g in (REGION, TERRITORY, NATIONAL)}


@dataclass(frozen=True)
class SignalSpec:
    """A metric followed over time at one grain and period."""

    id: str
    metric: str
    period_type: str = "MAT"
    lags: tuple[int, ...] = (0, 1, 2, 3)
    delta_lags: tuple[int, ...] = ()
    readout: str = "series"
    higher_is_better: bool = True
    strength_kind: str = "position"
    materiality_from: str = "rank_sales_eur"
    grain: Grain = REGION

    def __post_init__(self) -> None:
        if self.period_type not in PERIODS:
            raise ValueError(f"{self.id}: unknown period {self.period_type!r}")
        if self.readout not in ("series", "delta", "slope"):
            raise ValueError(f"{self.id}: unknown readout {self.readout!r}")
        if self.strength_kind not in LOUDNESS:
            raise ValueError(f"{self.id}: unknown strength kind {self.strength_kind!r}")
        missing = [n for n in self.delta_lags if n not in self.lags]
        if missing:
            raise ValueError(f"{self.id}: delta lags {missing} are not among the lags")
        if self.readout == "delta" and not self.delta_lags:
            raise ValueError(f"{self.id}: a delta readout needs delta lags")

    @property
    def oldest(self) -> int:
        return max(self.lags)


# Our default signal templates. The share and growth pairs carry the documented roles; the
# sales-growth pair gives the combination sweep a third signal per grain.
SIGNALS = {
    s.id: s
    for s in (
        SignalSpec("mshare_deviation_mat", "mshare_deviation"),
        SignalSpec("growth_deviation_mat", "growth_deviation", strength_kind="growth"),
        SignalSpec("growth_py_sales_mat", "growth_py_sales", strength_kind="growth"),
        SignalSpec(
            "territory_mshare_deviation_mat",
            "mshare_deviation",
            strength_kind="territory_position",
            grain=TERRITORY,
        ),
        SignalSpec(
            "territory_growth_deviation_mat",
            "growth_deviation",
            strength_kind="territory_growth",
            grain=TERRITORY,
        ),
        SignalSpec(
            "territory_growth_py_sales_mat",
            "growth_py_sales",
            strength_kind="territory_growth",
            grain=TERRITORY,
        ),
    )
}

ROLES = {
    "ui_default": "mshare_deviation_mat",
    "region_position": "mshare_deviation_mat",
    "region_growth": "growth_deviation_mat",
    "territory_position": "territory_mshare_deviation_mat",
}


@dataclass(frozen=True)
class Condition:
    """One comparison of a column with a bound value; lists of them are AND-ed."""

    column: str
    op: str
    value: object


@dataclass(frozen=True)
class GenericSignal:
    """A signal over any table: entity, time and metric columns, filters and segments."""

    entity: str
    time: str
    metric: str
    filters: tuple[Condition, ...] = ()
    segment_by: tuple[str, ...] = ()
    lags: tuple[int, ...] = (0, 1, 2, 3)
    delta_lags: tuple[int, ...] = ()
    higher_is_better: bool = True
    strength_kind: str = "position"
    loud_threshold: float = 1.0
    carry: tuple[str, ...] = ()

    @property
    def oldest(self) -> int:
        return max([n for n in self.lags if n > 0], default=0)


@dataclass(frozen=True)
class Axis:
    name: str
    signal: GenericSignal
    positive_is_good: bool = True
    threshold: float = 0.0


@dataclass(frozen=True)
class Rule:
    """A finding key and the side ("good" or "bad") it asks of some axes."""

    key: str
    label: str
    sides: dict[str, str]


@dataclass(frozen=True)
class FindingSpec:
    id: str
    axes: tuple[Axis, ...]
    rules: tuple[Rule, ...] = ()
    deterioration_delta: float = 0.3
    bands: dict[str, int] = field(default_factory=lambda: {"critical": 5, "high": 3, "moderate": 2})


@dataclass(frozen=True)
class Framing:
    """A persona's text for one finding key, with surface and suppress conditions."""

    id: str
    persona: str
    finding_key: str
    template: str
    surface: tuple[str, ...] = ()
    suppress: tuple[str, ...] = ()


# The share x growth findings, worst first.
QUADRANTS = {
    "losing_both": "Losing on both",
    "slipping": "Slipping",
    "catching_up": "Catching up",
    "star": "Star",
}
SHARE_GROWTH_ID = "fnd_share_growth"


def combinations_by_grain(max_size: int = 3, signals: dict[str, SignalSpec] = SIGNALS) -> list[tuple[str, ...]]:
    """Signal-id subsets of 2..max_size within one grain (configuration only, no data)."""
    from itertools import combinations

    grains: dict[str, list[str]] = {}
    for s in signals.values():
        grains.setdefault(s.grain.name, []).append(s.id)
    return [c for k in range(2, max_size + 1) for ids in grains.values() for c in combinations(ids, k)]


def normalise_weights(ids: tuple[str, ...], weights: list[float] | None) -> dict[str, float]:
    """Factor per signal: weight x count after scaling the weights to sum 1, else 1."""
    usable = (
        weights is not None
        and len(weights) == len(ids)
        and all(w == w and 0 <= w < float("inf") for w in weights)
        and sum(weights) > 0
    )
    if not usable:
        return dict.fromkeys(ids, 1.0)
    return {i: w / sum(weights) * len(ids) for i, w in zip(ids, weights)}
