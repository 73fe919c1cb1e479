"""Monthly cells from a stream of line files against the batch build."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.sources import orderlines
from tierwise.streaming.facts_feed import KEY, MEASURED, MonthlyFacts, feed_facts


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def lines(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    assert lines.select(*KEY, *MEASURED).distinct().count() == lines.count()
    return lines


@pytest.fixture(scope="module")
def expected(spark):
    return rows(orderlines.cells(spark, SF_DIR))


def test_late_and_repeated_files(spark, lines, expected, tmp_path):
    """Files by time of shipment, with late lines, repeated lines and whole repeated files: the sums are those of one batch."""
    folder = f"file://{tmp_path}"
    facts = MonthlyFacts(spark, SF_DIR, f"{folder}/facts")
    deal = F.pmod(F.xxhash64(*KEY), F.lit(10))
    year = F.year("l_shipdate")
    arrivals = [
        lines.filter((year < 1994) & (deal > 0)),
        lines.filter((year.between(1994, 1996)) & (deal > 1)).unionByName(lines.filter((year == 1993) & (deal == 5))),  # some again
        lines.filter((year < 1994) & (deal > 0)),  # a whole file again
        lines.filter(((year < 1994) & (deal == 0)) | (year.between(1994, 1996) & (deal == 1))),  # late
        lines.filter(year > 1996).unionByName(lines.filter(year > 1996)),  # lines twice in one file
        lines.filter(year.between(1994, 1996) & (deal == 0)).unionByName(lines.limit(50).withColumn("l_shipdate", F.lit(None).cast(lines.schema["l_shipdate"].dataType))),
    ]

    def run(checkpoint):
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrived")
        feed_facts(stream, facts, f"{folder}/{checkpoint}").awaitTermination()

    for file in arrivals:
        file.coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
        run("c1")
    assert rows(facts.cells()) == expected
    late = facts.corrections().collect()
    assert {r.batch for r in late} == {3, 5} and all(r.ship_month < facts.closed_before() for r in late)
    assert rows(facts.sales()) == rows(orderlines.sales_of_cells(orderlines.cells(spark, SF_DIR), spark, SF_DIR))
    run("c2")  # everything again under a new checkpoint
    assert rows(facts.cells()) == expected


def test_a_repeated_batch_replaces_its_first_attempt(spark, lines, expected, tmp_path, monkeypatch):
    facts = MonthlyFacts(spark, SF_DIR, f"file://{tmp_path}/facts")
    half = F.pmod(F.xxhash64(*KEY), F.lit(2)) == 0
    facts.add(lines.filter(half), 0)
    whole = MonthlyFacts._put
    before = rows(facts.cells())

    def breaks(self, df, name, *by):
        if name == "marks":
            raise OSError("lost")
        whole(self, df, name, *by)

    monkeypatch.setattr(MonthlyFacts, "_put", breaks)
    with pytest.raises(OSError):
        facts.add(lines, 1)
    assert rows(facts.cells()) == before  # a batch without its mark isn't read
    monkeypatch.setattr(MonthlyFacts, "_put", whole)
    facts.add(lines, 1)
    assert rows(facts.cells()) == expected
    facts.add(lines, 1)
    assert rows(facts.cells()) == expected
    facts.add(lines.limit(0), 2)
    assert rows(facts.cells()) == expected and facts.changed(2).isEmpty() and not facts.changed(1).isEmpty()


def test_only_touched_months_of_the_ledger_are_read(spark, lines, tmp_path):
    facts = MonthlyFacts(spark, SF_DIR, f"file://{tmp_path}/facts")
    facts.add(lines, 0)
    seen = spark.read.schema("l_orderkey long, l_linenumber long, content long, feed string, batch long, ship_month int").parquet(f"file://{tmp_path}/facts/ledger")
    text = seen.filter("ship_month in (23935) and l_orderkey between 5 and 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ship_month" in text and "GreaterThanOrEqual(l_orderkey,5)" in text
