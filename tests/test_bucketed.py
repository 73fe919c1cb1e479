"""The bucketed layout of lines and orders: equal cells, no shuffle of lines, hot orders, and a kept folder."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.sources import bucketed, orderlines
from tierwise.sources.bucketed import BucketedLines
from tierwise.sources.store import Store


@pytest.fixture
def unbroadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def rows(df):
    return sorted(tuple(r) for r in df.select(*orderlines.CELL, "units", "sales_eur").collect())


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_cells_without_a_shuffle_of_lines(spark, tmp_path, unbroadcast):
    layout = BucketedLines(Store(spark, SF_DIR, str(tmp_path)))
    cells = layout.cells()
    assert rows(cells) == rows(orderlines.cells(spark, SF_DIR)) != []
    text = plan(cells)[1]
    text = text.split("== Initial Plan ==")[-1]
    assert text.count("Exchange") == 1 and "Exchange hashpartitioning(ship_month" in text
    assert "SortMergeJoin" in text


def test_later_application_reads_the_kept_layout(spark, tmp_path, unbroadcast):
    first = BucketedLines(Store(spark, SF_DIR, str(tmp_path)), buckets=3)
    expected = rows(first.cells())
    for side in ("lines", "orders"):
        spark.sql(f"DROP TABLE {first._name(side)}")  # another session knows no tables; the files stay
    again = BucketedLines(Store(spark, SF_DIR, str(tmp_path)))
    cells = again.cells()
    assert rows(cells) == expected
    assert plan(cells)[1].split("== Initial Plan ==")[-1].count("Exchange") == 1
    assert spark.table(again._name("lines")).inputFiles() and len(spark.table(again._name("lines")).inputFiles()) <= 3


def test_hot_order_repeated_and_null_keys(spark, tmp_path):
    """An order with most lines is a row a month and brand; repeated orders count twice, null keys nowhere."""
    source = str(tmp_path / "source")
    for name in ("orders", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{source}/{name}.parquet")
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    hot = orders.agg(F.min("o_orderkey")).first()[0]
    key = F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 0, F.lit(hot))
    key = key.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", key.cast(lines.schema["l_orderkey"].dataType)).write.parquet(f"{source}/lineitem.parquet")
    orders.where(F.col("o_orderkey") == hot).write.mode("append").parquet(f"{source}/orders.parquet")
    layout = BucketedLines(Store(spark, source, str(tmp_path / "kept")))
    assert rows(layout.cells()) == rows(orderlines.cells(spark, source)) != []
    lines = layout.tables()[0]
    kept = lines.where(F.col("l_orderkey") == hot)
    assert kept.count() == kept.select("ship_month", "p_brand").distinct().count()
    assert lines.where("l_orderkey is null").isEmpty()


def test_empty_lines(spark, tmp_path):
    source = str(tmp_path / "source")
    for name in ("orders", "customer", "nation", "region", "part", "lineitem"):
        rows_of = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        (rows_of.limit(0) if name == "lineitem" else rows_of).write.parquet(f"{source}/{name}.parquet")
    assert BucketedLines(Store(spark, source, str(tmp_path / "kept"))).cells().isEmpty()


def test_tasks_hold_no_more_when_files_grow(spark, tmp_path, monkeypatch):
    """buckets and splits of bounded size; before, a task read 128 MB of lines and sorted as much, whatever that takes."""
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    assert bucketed.BUCKET_BYTES <= 16 << 20 and bucketed.SPLIT_BYTES <= 16 << 20
    size = spark.read.format("binaryFile").load(f"{SF_DIR}/lineitem.parquet").first().length
    monkeypatch.setattr(bucketed, "BUCKET_BYTES", size // 12)
    assert bucketed.bucket_count(spark, SF_DIR) >= 12
    monkeypatch.setattr(bucketed, "MOST_BUCKETS", 10)
    assert bucketed.bucket_count(spark, SF_DIR) == 10
    monkeypatch.setattr(bucketed, "SPLIT_BYTES", size // 20)
    with bucketed.small_splits(spark):
        assert spark.read.parquet(f"{SF_DIR}/lineitem.parquet").rdd.getNumPartitions() >= 20
    assert spark.conf.get(split) == before
    layout = BucketedLines(Store(spark, SF_DIR, str(tmp_path)))
    assert rows(layout.cells()) == rows(orderlines.cells(spark, SF_DIR)) != [] and spark.conf.get(split) == before
