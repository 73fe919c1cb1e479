"""Skew and plan shape: hot keys, shuffles and scans of the main plans."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.operators import signals as sig
from tierwise.operators.grid import dense_sales
from tierwise.plans.metrics import Pipeline, build_metrics
from tierwise.sources import orderlines
from tierwise.specs import REGION, GenericSignal

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def conf(spark):
    old = {}

    def set_(values):
        for k, v in values.items():
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield set_
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def physical(df, final=False):
    if final:
        df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_order_is_split(spark, con, tmp_path, conf):
    """A third of all lines belong to one order; the skew join splits it and the sums stay whole."""
    folder = f"file://{tmp_path}"
    big = SF_DIR.replace("0.001", "0.01")
    lines = spark.read.parquet(f"{big}/lineitem.parquet")
    hot = F.when(F.pmod(F.xxhash64("l_partkey", "l_linenumber"), F.lit(3)) == 0, F.lit(1)).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast("long")).repartition(12).write.parquet(f"{folder}/lineitem.parquet")
    for t in ("orders", "customer", "part", "nation", "region"):
        spark.read.parquet(f"{big}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    conf(SKEW)
    out = orderlines.sales(spark, folder)
    rows = out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    want = con.sql(
        f"""SELECT sum(l_quantity)::BIGINT, sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))
        FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')"""
    ).fetchall()[0]
    assert (sum(r.units for r in rows), sum(r.sales_eur for r in rows)) == want


def test_one_plan_has_three_large_shuffles(spark, conf):
    """Grid, market totals and period windows share one shuffle; national sums and ranks another."""
    pipe = Pipeline(spark, SF_DIR)
    sales, plan = pipe.sales(), pipe.brand_forecast()
    text = physical(build_metrics(dense_sales(sales, pipe.regions()), plan, REGION))
    large = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "region_name" in x or "year_month" in x]
    assert len(large) == 3
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scan_reads_needed_columns_only(spark):
    text = physical(orderlines.sales(spark, SF_DIR, own_only=True))
    scan = next(x for x in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if "l_orderkey" in x)
    assert {c.split("#")[0] for c in scan.split(",")} == {
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    }


def test_asof_read_prunes_columns_and_months(spark):
    table = Pipeline(spark, SF_DIR).metrics("region")
    text = physical(sig.scatter(table))
    assert "EqualTo(year_month,ScalarSubquery" in text
    assert "rank_units" not in text


def test_hot_series_is_limited_before_the_shuffle(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 50)).alias("e"),
        F.col("id").alias("t"),
        (F.col("id") * 1.0).alias("v"),
    )
    out = sig.generic_signal(rows, GenericSignal("e", "t", "v"), asof=2997)
    assert [(r.entity, r.now, r.v3) for r in out.collect()] == [("hot", 2997.0, 2988.0)]
    text = physical(out)
    exchange, partial = text.index("Exchange hashpartitioning"), text.rindex("WindowGroupLimit")
    assert partial > exchange  # printed below the exchange: it runs before it


def test_no_broadcast_gives_the_same_metrics(spark, conf):
    pipe = Pipeline(spark, SF_DIR)
    cols = ["year_month", "period_type", "brand_name", "region_name", "mshare_deviation", "growth_vs_fcst_eur", "rank_units"]
    a = pipe.compute("region", ["MAT"]).select(cols).collect()
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "31"})
    b = pipe.compute("region", ["MAT"]).select(cols).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tierwise.sources.store import shared_dir

    def fake(named, set_, master):
        context = SimpleNamespace(getCheckpointDir=lambda: set_, master=master, applicationId="app-x")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=context)

    assert shared_dir(fake("hdfs:///shared/", None, "yarn")) == "hdfs:///shared"
    assert shared_dir(fake(None, "hdfs:///set", "yarn")) == "hdfs:///set"
    with pytest.raises(RuntimeError):
        shared_dir(fake(None, None, "yarn"))
