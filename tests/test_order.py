"""Order statistics over range partitions."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from conftest import SF_DIR
from oracle_check import differences
from pyspark.sql import functions as F

from tierwise import registry
from tierwise.operators import order
from tierwise.plans.metrics import Pipeline
from tierwise.sources import store


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(5), rng.randrange(1000)])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, value int")
    found = order.numbered(df, F.col("value").desc_nulls_last(), F.col("id"))
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {(r.id, r.value): r.position for r in found.collect()} == {r: i for i, r in enumerate(ordered, 1)}
    assert order.numbered(df.limit(0), F.col("id")).isEmpty()


def plain_shares(rows):
    """(group, key) -> (below, n, known) of each row with a known value"""
    out = {}
    for g in {r[0] for r in rows}:
        known = [v for x, _, v in rows if x == g and v is not None]
        for x, key, v in rows:
            if x == g and v is not None:
                out[g, key] = (sum(y < v for y in known), known.count(v), len(known))
    return out


@pytest.fixture(params=[4096, 3], ids=["all often", "few often"])
def hot(request, monkeypatch):
    monkeypatch.setattr(order, "HOT", request.param)


def test_ranked_with_ties_across_borders(spark, hot):
    """A value that most rows share lies in many partitions' counts; each measure keeps its own type."""
    rng = random.Random(2)
    pick = lambda: rng.choice([None, 0.0, 0.0, 0.0, -0.0, round(rng.gauss(0, 1), 1), rng.random()])
    rows = [(f"g{i % 3}" if i % 50 else "small", f"k{i}", pick(), rng.choice([0, 5, 10**17 + i % 3])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, key string, v double, w long").withColumn("d", F.col("w").cast("decimal(28,4)"))
    score = lambda below, n, known: F.concat_ws(",", below, n, known)
    found = order.ranked(df, ["g"], "key", {"a": "v", "b": "w", "c": "d"}, score).collect()
    for name, at in (("a", 2), ("b", 3)):
        expected = plain_shares([(r[0], r[1], r[at]) for r in rows])
        assert {(r.g, r.key): tuple(map(int, r[name].split(","))) for r in found if r[name]} == expected
    assert all(r.b == r.c for r in found) and len(found) == len(rows)


def test_medians_and_places(spark):
    rng = random.Random(3)
    rows = [(f"g{i % 4}", f"k{i:04}", rng.choice([None, 1.5, 1.5, rng.randrange(9) / 2])) for i in range(1201)]
    rows += [("unknown", "k", None), ("one", "k", 7.0)]
    df = spark.createDataFrame(rows, "g string, key string, v double")
    known = {g: sorted(v for x, _, v in rows if x == g and v is not None) for g in {r[0] for r in rows}}
    expected = {g: statistics.median(v) for g, v in known.items() if v}
    assert {r.g: r.m for r in order.medians(df, ["g"], "v", "m").collect()} == expected
    placed = {(r.g, r.key): (r.place, r.group_size) for r in order.within(df, ["g"], [F.desc("v"), F.col("key")], "key").collect()}
    for g in known:
        own = sorted(((v is None, -(v or 0), k) for x, k, v in rows if x == g))
        assert [placed[g, k] for *_, k in own] == [(i, len(own)) for i in range(1, len(own) + 1)]


DISTRIBUTED = "percentile_ranks territory_metrics vs_peers composite_top peer_gap displacement".split()


def test_large_groups_give_the_same_results(spark, con, tmp_path, monkeypatch):
    """With a limit of 10 entities every brand month goes by ranges, sums are joined back and groups are salted."""
    monkeypatch.setattr(order, "LARGE", 10)
    monkeypatch.setattr(store, "_LOCAL_BASE", {spark.sparkContext.applicationId: f"file://{tmp_path}"})
    monkeypatch.setattr(store.Store, "_written", {})
    monkeypatch.setattr(store, "shared_dir", lambda s: f"file://{tmp_path}")
    assert Pipeline(spark, SF_DIR).large()
    queries, oracle = registry.queries(), registry.oracle_sql()
    wrong = {key: differences(queries[key](spark, SF_DIR), con, oracle[key]) for key in DISTRIBUTED}
    assert not {k: v for k, v in wrong.items() if v}


def stages_of(spark):
    gateway, status = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    return status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())


def most_read(spark, since):
    """Rows that the largest task of the jobs after stage `since` has read from a shuffle."""
    status = spark.sparkContext._jsc.sc().statusStore()
    most, stages = 0, stages_of(spark)
    for i in range(stages.size()):
        stage = stages.apply(i)
        if stage.stageId() > since:
            tasks = status.taskList(stage.stageId(), stage.attemptId(), 100_000)
            for j in range(tasks.size()):
                metrics = tasks.apply(j).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def test_no_task_holds_a_large_group(spark, monkeypatch):
    """Half a million entities of one brand month, a third of them with the same value."""
    n, parts = 500_000, 32
    monkeypatch.setattr(order, "LARGE", n // parts)
    rows = spark.range(n).select(
        F.lit("b").alias("g"), F.col("id").cast("string").alias("key"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("v"),
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages = stages_of(spark)
        since = max((stages.apply(i).stageId() for i in range(stages.size())), default=-1)
        share = order.ranked(rows, ["g"], "key", {"share": "v"}, lambda below, n, known: (below + n) / known)
        low = share.agg(F.count(F.lit(1)), F.min("share"), F.max("share"), F.avg("share")).first()
        middle = order.medians(rows, ["g"], "v", "m").first().m
        last = order.within(rows, ["g"], [F.col("v"), F.col("key")], "key").filter(F.col("place") % 100_000 == 0).count()
        assert 0 < most_read(spark, since) < 4 * n // parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    values = np.sort([r.v for r in rows.select("v").collect()])
    assert low[0] == n and low[2] == 1.0 and low[1] == np.searchsorted(values, 0.0, "right") / n
    assert middle == (values[n // 2 - 1] + values[n // 2]) / 2 and last == 5
