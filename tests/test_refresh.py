"""Refreshed metric tables against tables built anew."""

from __future__ import annotations

from pathlib import Path

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.plans.refresh import REACH, MetricTables
from tierwise.sources import orderlines
from tierwise.streaming.facts_feed import MonthlyFacts

TABLES = ("monthly", "region", "territory", "national")


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def facts(spark, lines):
    cells = orderlines.cells(spark, SF_DIR, lines)
    sales = orderlines.sales_of_cells(cells, spark, SF_DIR)
    return sales, orderlines.brand_forecast_of_cells(cells), orderlines.regions(spark, SF_DIR)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    part = spark.read.parquet(f"{SF_DIR}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").join(part, "l_partkey")
    path = f"file://{tmp_path_factory.mktemp('lines')}/lines"
    lines.withColumn("ym", F.date_format("l_shipdate", "yyyy-MM")).filter("ym < '1996-04'").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def whole(spark, lines, tmp_path_factory):
    tables = MetricTables(spark, f"file://{tmp_path_factory.mktemp('whole')}")
    tables.build(*facts(spark, lines))
    return {name: rows(tables.read(name)) for name in TABLES}


OWN = "cast(substring(p_brand, 7, 10) as int) <= 6"


def test_a_changed_month(spark, lines, whole, tmp_path):
    """Sales of one franchise in one month come later. Files of months out of reach are unreadable meanwhile and stay as they are."""
    months = sorted(r.ym for r in lines.filter(OWN).select("ym").distinct().collect())
    at = 8
    late = lines.filter((F.col("ym") == months[at]) & F.expr("cast(substring(p_brand, 7, 10) as int) % 5 = 1"))
    # an order of a missing line is booked in another month, so the forecast changes too
    before = lines.join(late, lines.columns, "left_anti")
    tables = MetricTables(spark, f"file://{tmp_path}")
    tables.build(*facts(spark, before))
    broken = {}
    for name in ("region", "territory", "national"):
        for file in Path(tmp_path, name).rglob("*.parquet"):
            month = file.parent.name.split("=")[1]
            if months.index(month) not in range(at, at + REACH + 1):
                broken[file] = file.read_bytes(), file.stat().st_mtime_ns
    sales, forecast, regions = facts(spark, lines)
    old_forecast = facts(spark, before)[1]
    changed = late.select(F.col("ym").alias("year_month"), F.lit("F1").alias("franchise"))
    for file in broken:
        file.write_bytes(b"not parquet")
        Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    written = tables.refresh(sales, old_forecast, regions, changed)
    assert written == months[at : at + REACH + 1] and broken
    for file, (data, _) in broken.items():
        assert file.read_bytes() == b"not parquet"
        file.write_bytes(data)
    tables.refresh(sales, forecast, regions, changed.limit(0))  # now the forecast
    assert {name: rows(tables.read(name)) for name in TABLES} == whole


def test_new_months_and_a_new_brand(spark, lines, whole, tmp_path):
    """A month between others, the last months and all of one own brand come later."""
    months = sorted(r.ym for r in lines.filter(OWN).select("ym").distinct().collect())
    brand = F.col("p_brand") == lines.filter(OWN).agg(F.min("p_brand")).first()[0]
    first = lines.filter(~brand & (F.col("ym") != months[9]) & (F.col("ym") < months[-5]))
    tables = MetricTables(spark, f"file://{tmp_path}", ("region",))
    tables.build(*facts(spark, first))
    second = lines.filter(~brand)
    franchise = orderlines.brand_number(F.col("p_brand")) % 5
    keys = [F.col("ym").alias("year_month"), F.concat(F.lit("F"), franchise.cast("string")).alias("franchise")]
    tables.refresh(*facts(spark, second), second.join(first, lines.columns, "left_anti").select(keys))
    tables.refresh(*facts(spark, lines), lines.filter(brand).select(keys))
    assert {name: rows(tables.read(name)) for name in TABLES[:2]} == {name: whole[name] for name in TABLES[:2]}


def test_a_stream_of_lines_refreshes_the_tables(spark, lines, whole, tmp_path):
    feed, tables = MonthlyFacts(spark, SF_DIR, f"file://{tmp_path}/facts"), MetricTables(spark, f"file://{tmp_path}/tables", ("region",))
    plain = lines.drop("ym", "p_brand")
    late = F.pmod(F.xxhash64(*plain.columns), F.lit(300)) == 0
    feed.add(plain.filter(~late), 0)

    def now():
        cells = feed.cells()
        return feed.sales(), orderlines.brand_forecast_of_cells(cells), orderlines.regions(spark, SF_DIR)

    tables.build(*now())
    feed.add(plain, 1)
    n = orderlines.brand_number(F.col("brand_name"))
    changed = feed.changed(1).select("year_month", F.concat(F.lit("F"), (n % orderlines.FRANCHISES).cast("string")).alias("franchise"))
    assert not changed.isEmpty()
    tables.refresh(*now(), changed)
    assert {name: rows(tables.read(name)) for name in TABLES[:2]} == {name: whole[name] for name in TABLES[:2]}
