"""Signals over hand-made series, loudness and composites."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.operators import composite as comp
from tierwise.operators import loudness as loud
from tierwise.operators import signals as sig
from tierwise.plans import signal_queries as q
from tierwise.specs import SIGNALS, Condition, GenericSignal

LONG = (
    "signal_id string, kind string, better boolean, level string, brand_name string, entity string, "
    "year_month string, rank int, value double"
)


def long(spark, series, signal="s", kind="position", better=True, brand="A"):
    rows = []
    for entity, values in series.items():
        for i, v in enumerate(values):
            ym = f"{2020 + i // 12}-{i % 12 + 1:02d}"
            rows.append((signal, kind, better, "region", brand, entity, ym, 50, v))
    return spark.createDataFrame(rows, LONG)


def test_vs_self_constant_history(spark):
    flat = [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]
    rows = long(spark, {"same": flat, "louder": flat[:-1] + [9.0], "short": [None] * 5 + flat[:3]})
    out = loud.analyze(rows, F.lit("2020-08")).collect()
    got = {r.entity: r.vs_self for r in out}
    assert got == {"same": 0.0, "louder": 6.0}
    assert {r.entity: r.vs_peers for r in out} == {"same": 0.5, "louder": 1.0}


def test_vs_self_needs_four_past_windows(spark):
    out = loud.analyze(long(spark, {"e": [0.0, 1.0, 3.0, 2.0, 5.0, 4.0, 9.0]}), F.lit("2020-07")).collect()
    assert out[0].vs_self is None and out[0].tag == "chronic"


def test_tags_and_reads(spark):
    df = spark.createDataFrame(
        [(0.9, 2.0), (0.95, 1.99), (0.899, 3.5), (0.1, None)], "p double, s double"
    ).withColumn("tag", loud.tag(F.col("p"), F.col("s")))
    assert [r.tag for r in df.collect()] == ["eruption", "chronic", "stirring", "quiet"]
    text = loud.read_text(F.lit("improving"), F.lit("trend"), F.col("tag"), F.col("s"))
    reads = [r.t for r in df.select(text.alias("t")).collect()]
    assert reads[0].startswith("Improving on a clean directional move — loud vs peers and a break")
    assert reads[0].endswith("(≈2σ above its own normal).")
    assert reads[2].endswith("(≈4σ above its own normal).")
    assert reads[3] == "Improving on a clean directional move."


def test_step_scale_fallbacks(spark):
    even = long(spark, {"a": [0.0, 1.0, 2.0, 3.0]}, "even")  # every step 1: MAD 0, deviation 0
    some = long(spark, {"a": [0.0, 1.0, 2.0, 3.0, 8.0]}, "some")  # MAD 0, deviation not
    gap = long(spark, {"a": [0.0, None, 2.0, 5.0]}, "gap")  # steps over the hole: 2 and 3
    got = {r.signal_id: r for r in loud.step_scale(even.union(some).union(gap)).collect()}
    assert got["even"].scale == 1.0
    assert got["some"].scale == pytest.approx(1.732051)
    assert (got["gap"].steps, got["gap"].scale) == (2, 0.5)


def test_generic_signal_rules(spark):
    rows = [("x", "e1", t, float(v)) for t, v in enumerate([1, 5, 2, 9])]
    rows += [("x", "e2", t, float(v)) for t, v in enumerate([1, 5])]  # ends before the as-of time
    rows += [("y", "e1", t, float(v)) for t, v in enumerate([4, 4, 4])]
    t = spark.createDataFrame(rows, "seg string, e string, t int, v double")
    spec = GenericSignal("e", "t", "v", segment_by=("seg",), lags=(0, 1, 2), delta_lags=(2,))
    got = {(r.seg, r.entity): r for r in sig.generic_signal(t, spec).collect()}
    assert set(got) == {("x", "e1"), ("y", "e1")}
    assert (got["x", "e1"].now, got["x", "e1"].v2, got["x", "e1"].delta_2m, got["x", "e1"].magnitude) == (9, 5, 4, 10)
    at = sig.generic_signal(t, spec, asof=2, segment={"seg": "x"}).collect()
    assert [(r.entity, r.now) for r in at] == [("e1", 2.0)]
    with pytest.raises(ValueError):
        sig.generic_signal(t, GenericSignal("e", "t", "nope"))
    with pytest.raises(ValueError):
        sig.filtered(t, [Condition("v", "LIKE", "x")])
    assert sig.filtered(t, [Condition("v", ">=", 5.0), Condition("seg", "IN", ["x"])]).count() == 3


def test_recent_equals_full_history(spark):
    table = q.tables(q.Pipeline(spark, SF_DIR), [q.POSITION])["region", "MAT"]
    cut = sig.at_asof(table, {"m": "mshare_deviation"}, ["brand_name", "region_name"], "2000-05")
    full = sig.with_lags(table, ["brand_name", "region_name"], {"m": "mshare_deviation"}, 3)
    cols = ["brand_name", "region_name", "m0", "m1", "m2", "m3"]
    a, b = cut.select(cols), full.filter("year_month = '2000-05'").select(cols)
    assert a.count() == b.count() == a.intersect(b).count()


def test_composite_invariants(spark):
    combo = [("mshare_deviation_mat", "growth_deviation_mat")]
    parts = q.parts(spark, SF_DIR, combo)
    rows = comp.composite_rows(parts)
    both = parts.groupBy("brand_name", "entity").agg(F.sum("good").alias("g"), F.count("*").alias("n"))
    joined = rows.join(both, ["brand_name", "entity"])
    assert joined.count() == rows.count() > 0
    assert joined.filter("abs(g - composite_net) > 0.001 OR n <> 2").count() == 0
    assert rows.filter("abs(composite_ker) > 1 OR composite_loudness < 0").count() == 0


def test_equal_weights_change_nothing_and_zero_drops(spark):
    pair = [("mshare_deviation_mat", "growth_deviation_mat")]
    cols = ["brand_name", "entity", "composite_loudness", "composite_net"]
    plain = q.rows(spark, SF_DIR, pair).select(cols)
    same = q.rows(spark, SF_DIR, pair, [1.0, 1.0]).select(cols)
    assert plain.exceptAll(same).count() == 0
    off = q.parts(spark, SF_DIR, pair, [1.0, 0.0]).filter("signal_id = 'growth_deviation_mat'")
    assert off.filter("loudness <> 0 OR direction <> 'flat'").count() == 0


def test_mixed_grains_are_refused(spark):
    with pytest.raises(ValueError):
        comp.combo_table(spark, [("mshare_deviation_mat", "territory_mshare_deviation_mat")])
    assert set(SIGNALS) >= {"mshare_deviation_mat", "growth_deviation_mat"}
