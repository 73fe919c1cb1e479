"""Documented trajectories, rounding and relevance."""

import pytest
from pyspark.sql import functions as F

from tierwise.functions.numeric import half_up, rnd, short_number
from tierwise.functions.trajectory import persistence, relevance, strength
from tierwise.specs import SignalSpec, combinations_by_grain, normalise_weights

# Documented series and their scores.
GOLDEN = [
    ([-5.60, -4.92, -4.71, -4.36], "position", 1.24, 1.24, 1.0, "improving", "trend"),
    ([-5.23, -5.41, -4.79, -4.55], "position", 1.04, 0.68, 0.654, "improving", "trend"),
    ([-4.39, -4.45, -5.11, -5.39], "position", 1.0, -1.0, -1.0, "deteriorating", "trend"),
    ([0.0, 10.0, 0.0], "position", 20.0, 0.0, 0.0, "flat", "unstable"),
    ([-0.87, -1.63, -2.40, -2.76], "position", 1.89, -1.89, -1.0, "deteriorating", "trend"),
    ([6.33, 1.47, -3.49, -4.82], "growth", 11.15, -11.15, -1.0, "deteriorating", "trend"),
    ([1.0, 1.1, 1.2, 1.3], "position", 0.3, 0.3, 1.0, "improving", "quiet"),
    ([1.0, 1.8, 1.4, 1.6], "position", 1.4, 0.6, 0.429, "improving", "mixed"),
]


@pytest.mark.parametrize("series,kind,v,d,rho,direction,shape", GOLDEN)
def test_strength(spark, series, kind, v, d, rho, direction, shape):
    cols = [F.lit(x) for x in series]
    r = spark.range(1).select(*strength(cols, F.lit(kind))).first()
    assert (r.magnitude, r.net, r.coherence, r.direction, r.shape) == (v, d, rho, direction, shape)


def test_lower_is_better(spark):
    cols = [F.lit(x) for x in (3.0, 2.0)]
    assert spark.range(1).select(*strength(cols, F.lit("position"), False)).first().direction == "improving"


def test_relevance(spark):
    cases = [(90, 1.24, "MAT", 48, "critical"), (75, 1.0, "RollQ", 18, "moderate"), (10, 0.1, "Month", 1, "low")]
    for rank, v, period, score, band in cases:
        r = spark.range(1).select(*relevance(F.lit(rank), F.lit(v), F.lit(period), F.lit("position"))).first()
        assert (r.score, r.band) == (score, band)


def test_rounding(spark):
    r = spark.range(1).select(
        rnd(F.lit(0.125), 2).alias("even"),
        rnd(F.lit(-0.001), 2).alias("zero"),
        half_up(F.lit(0.125), 2).alias("up"),
        half_up(F.lit(-0.125), 2).alias("neg"),
        short_number(F.lit(2.0)).alias("two"),
        short_number(F.lit(10.5)).alias("ten"),
        short_number(F.lit(100.0)).alias("hundred"),
        persistence(F.lit(-0.3)).alias("label"),
    ).first()
    assert (r.even, r.up, r.neg) == (0.12, 0.13, -0.12)
    assert str(r.zero) == "0.0"
    assert (r.two, r.ten, r.hundred, r.label) == ("2", "10.5", "100", "mixed")


def test_specs():
    with pytest.raises(ValueError):
        SignalSpec("x", "m", period_type="Week")
    with pytest.raises(ValueError):
        SignalSpec("x", "m", readout="delta")
    with pytest.raises(ValueError):
        SignalSpec("x", "m", delta_lags=(6,))
    assert normalise_weights(("a", "b"), [3, 1]) == {"a": 1.5, "b": 0.5}
    assert normalise_weights(("a", "b"), [1]) == {"a": 1.0, "b": 1.0}
    assert normalise_weights(("a", "b"), [1, float("nan")]) == {"a": 1.0, "b": 1.0}
    combos = combinations_by_grain(3)
    assert len(combos) == 8 and all(len({i.startswith("territory") for i in c}) == 1 for c in combos)
