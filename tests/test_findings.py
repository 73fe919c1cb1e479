"""Findings, memory, catalog, insights, readouts and sources."""

from decimal import Decimal

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tierwise.operators import findings as fnd
from tierwise.operators import insights as ins
from tierwise.operators import market, neighbours, peers, readout
from tierwise.operators.catalog import Catalog, catalog_rows
from tierwise.plans import finding_queries as q
from tierwise.sources.files import copy_table, read_copy, read_regions_csv, replace_table
from tierwise.sources.store import Store
from tierwise.specs import FindingSpec, Framing, Rule

METRICS = (
    "year_month string, brand_name string, franchise string, region_name string, territory_name string, "
    "mshare_deviation double, growth_deviation double, market_share double, rank_sales_eur int, period_type string"
)


def metrics(spark, share, growth, region="R", start=0):
    rows = [
        (f"2020-{i + 1:02d}", "A", "F", region, "T", s, g, 40.0, 82, "MAT")
        for i, (s, g) in enumerate(zip(share, growth), start)
    ]
    return spark.createDataFrame(rows, METRICS)


def test_documented_finding(spark):
    m = metrics(spark, [-0.87, -1.63, -2.40, -2.76], [6.33, 1.47, -3.49, -4.82])
    r = fnd.flagged(fnd.findings(m)).first()
    assert (r.finding_key, r.severity_score, r.severity_band) == ("losing_both", 6, "critical")
    assert (r.months_red, r.improved, r.escalate) == (1, False, False)


def test_memory(spark):
    share = [-1.0, -2.0, -3.0, -4.0, -5.0, -6.0, 1.0]
    growth = [-1.0, -12.0, -23.0, -34.0, -45.0, -56.0, 1.0]
    m = metrics(spark, share, growth)
    by_month = {r.year_month: r for r in fnd.findings(m, history=True).collect()}
    assert [by_month[f"2020-0{i}"].months_red for i in range(3, 8)] == [0, 1, 2, 3, 0]
    assert by_month["2020-06"].escalate and by_month["2020-07"].improved
    assert fnd.findings(m, asof="2020-06").first().months_red == 3
    assert fnd.findings(m).first().improved


def test_recovered_needs_a_missing_row(spark):
    share, growth = [-1.0, -2.0, -3.0, -4.0, None], [-1.0, -12.0, -23.0, -34.0, 5.0]
    gone = fnd.findings(metrics(spark, share, growth), history=True)
    assert [r.region_name for r in fnd.recovered(gone).collect()] == ["R"]


def test_rules_first_match_and_octants(spark):
    m = metrics(spark, [-0.87, -1.63, -2.40, -2.76], [6.33, 1.47, -3.49, -4.82])
    rules = (Rule("first", "First", {"share": "bad"}), Rule("second", "Second", {"share": "bad", "growth": "bad"}))
    r = fnd.classify_findings(m, FindingSpec("f", (q.SHARE, q.GROWTH), rules)).first()
    assert (r.finding_key, r.share_sev, r.growth_sev, r.severity_band) == ("first", 3, 3, "critical")
    none = (Rule("x", "X", {"share": "good"}),)
    assert fnd.classify_findings(m, FindingSpec("f", (q.SHARE,), none)).first().finding_key == "unclassified"
    assert fnd.classify_findings(m, FindingSpec("f", (q.SHARE, q.GROWTH))).first().finding_key == "bad_bad"
    with pytest.raises(ValueError):
        fnd.axis_readings(m, FindingSpec("f", ()))


def test_axes_over_different_tables_are_joined(spark):
    a = metrics(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], "R1")
    b = a.union(metrics(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], "R2"))
    spec = FindingSpec("f", (q.SHARE, q.GROWTH))
    assert [r.entity for r in fnd.axis_readings({"share": a, "growth": b}, spec).collect()] == ["R1"]


def test_summary_lists_zeros(spark):
    m = metrics(spark, [-0.87, -1.63, -2.40, -2.76], [6.33, 1.47, -3.49, -4.82])
    got = fnd.summary(fnd.flagged(fnd.findings(m))).orderBy("position").collect()
    assert [(r.finding_key, r.entities) for r in got] == [
        ("losing_both", 1), ("slipping", 0), ("catching_up", 0), ("star", 0)
    ]


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    m = metrics(spark, [-1.0, -2.0, -3.0, -4.0, -5.0], [-1.0, -2.0, -3.0, -4.0, -5.0])
    rows = catalog_rows(fnd.flagged(fnd.findings(m, history=True)))
    first = catalog.append(rows.filter("year_month = '2020-04'"))
    assert (first.inserted, first.skipped, first.total_rows) == (1, 0, 1)
    again = catalog.append(rows.withColumn("severity_score", F.lit(99)))
    assert (again.inserted, again.skipped, again.total_rows) == (1, 1, 2)
    scores = {r.year_month: r.severity_score for r in catalog.read().collect()}
    assert scores["2020-04"] != 99 and scores["2020-05"] == 99
    forced = catalog.upsert(rows.filter("year_month = '2020-05'"))
    assert (forced.inserted, forced.total_rows) == (0, 2)
    scores = {r.year_month: r.severity_score for r in catalog.read().collect()}
    assert scores["2020-05"] != 99
    assert catalog.append(rows).inserted == 0
    assert catalog.stats().first().asDict() == {"total_rows": 2, "periods": 2}
    assert [r.year_month for r in catalog.history("A", "R").collect()] == ["2020-04", "2020-05"]
    snapshot = catalog.read().first().axes_snapshot
    assert '"ms_series":[' in snapshot and '"shape":"' in snapshot


def test_templates(spark):
    known = {"region": F.lit("R"), "rank": F.lit("7")}
    text = ins.render("{{ region }}/{{rank}}: {{what}}{{", known)
    assert spark.range(1).select(text).first()[0] == "R/7: {{UNKNOWN:what}}{{"


def test_gate(spark):
    df = spark.createDataFrame([("critical", 30), ("critical", 90), ("low", 90), (None, 10)], "band string, rank int")
    strict = Framing("f", "p", "k", "", surface=("band = 'critical'",), suppress=("rank < 40",))
    assert [r[0] for r in df.select(ins.gate(strict)).collect()] == [False, True, False, False]
    assert [r[0] for r in df.select(ins.gate(Framing("f", "p", "k", ""))).collect()] == [True] * 4


def test_plan_attainment_drops_incomplete_periods(spark):
    act = [("A", f"2020-{m:02d}", p, Decimal(m * 10)) for m in range(1, 13) for p in ("Month", "RollQ", "YTD", "MAT")]
    rows = spark.createDataFrame(act, "brand_name string, year_month string, period_type string, sales_eur decimal(28,4)")
    plan = spark.createDataFrame(
        [("A", f"2020-{m:02d}", Decimal(100)) for m in range(2, 13)],
        "brand_name string, year_month string, sales_eur decimal(28,4)",
    )
    got = {r.period_type: (r.fcst, r.pct) for r in readout.plan_attainment(rows, plan).collect()}
    assert got == {"Month": (100.0, 120.0), "RollQ": (300.0, 40.0)}


def test_table_page(spark):
    df = spark.range(20).withColumn("k", F.col("id") % 2)
    page = readout.table_page(df, ["id"], {"k": 1}, limit=3, offset=2)
    assert [(r.id, r.total) for r in page.collect()] == [(5, 10), (7, 10), (9, 10)]


def test_displacement_sums_the_rises(spark):
    def rows(month, moves):
        return [(month, "MAT", "F", r, Decimal(now), Decimal(py)) for r, now, py in moves]

    df = spark.createDataFrame(
        rows("2020-01", [("a", 0, 100), ("b", 50, 0), ("c", 60, 10), ("e", 50, 50)])  # 100 lost, 50 and 50 gained
        + rows("2020-02", [("a", 0, 100), ("b", 30, 0), ("d", 80, 100)]),
        "year_month string, period_type string, franchise string, region_name string, tot_u decimal(28,4), tot_u_py decimal(28,4)",
    )
    got = {(r.year_month, r.region_name): (r.risen_elsewhere, r.destination_region, r.diagnosis) for r in market.displacement(df).collect()}
    assert got == {
        ("2020-01", "a"): (100.0, "c", "displaced_volume"),
        ("2020-02", "a"): (30.0, None, "true_demand_loss"),
        ("2020-02", "d"): (30.0, None, "true_demand_loss"),
    }


def test_catalog_keeps_one_row_per_key(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    m = metrics(spark, [-1.0, -2.0, -3.0, -4.0, -5.0], [-1.0, -2.0, -3.0, -4.0, -5.0])
    rows = catalog_rows(fnd.flagged(fnd.findings(m, history=True)))
    assert catalog.read().count() == 0
    report = catalog.append(rows.unionByName(rows.withColumn("severity_score", F.lit(0))))
    assert (report.inserted, report.skipped, report.total_rows) == (2, 2, 2)
    seen = catalog.read()
    forced = catalog.upsert(rows.unionByName(rows).filter("year_month = '2020-05'").withColumn("severity_score", F.lit(1)))
    assert (forced.inserted, forced.skipped, forced.total_rows) == (0, 2, 2)
    assert {r.year_month: r.severity_score for r in catalog.read().collect()}["2020-05"] == 1
    assert seen.count() == 2 and all(r.severity_score > 1 for r in seen.collect())  # as it was when read
    assert catalog.append(rows.limit(0)).total_rows == 2


def test_regions_are_read_by_name(spark, tmp_path):
    from tierwise.sources.files import read_regions_csv

    (tmp_path / "t.csv").write_text("Territory_ID,Name,Territory_Name\n07,R1,North\n")
    assert [tuple(r) for r in read_regions_csv(spark, f"file://{tmp_path}/t.csv").collect()] == [("R1", "07", "North")]
    (tmp_path / "u.csv").write_text("Territory_ID,Name\n07,R1\n")
    with pytest.raises(ValueError):
        read_regions_csv(spark, f"file://{tmp_path}/u.csv")


def test_page_limit_is_refused_above_the_bound(spark):
    with pytest.raises(ValueError):
        readout.table_page(spark.range(3), ["id"], limit=1000)


def brute_nearest(points, k):
    out = {}
    for a in points:
        d = sorted(
            (round(sum((a[c] - b[c]) ** 2 for c in ("growth", "deviation", "rank")), 9), b["entity"])
            for b in points
            if b["entity"] != a["entity"]
        )
        out[a["entity"]] = [e for _, e in d[:k]]
    return out


@pytest.mark.parametrize("seed,n,spread,leaf", [(1, 120, 1.0, 64), (1, 400, 1.0, 8), (2, 60, 200.0, 4), (2, 60, 200.0, 64), (3, 4, 1.0, 64), (4, 1, 1.0, 64), (5, 9, 1.0, 2)])
def test_nearest_is_exact(spark, seed, n, spread, leaf, monkeypatch):
    """By the whole group, and by space with small leaves, where the top of the tree goes by ranges and with salts."""
    import random

    monkeypatch.setattr(neighbours.order, "LARGE", 50)

    rng = random.Random(seed)
    pts = []
    for i in range(n):
        if i % 3 == 0:  # a third of all points are piled up in one place
            xyz = (1.5, -0.5, 2.0)
        else:
            xyz = (rng.gauss(0, spread), rng.gauss(0, 2), rng.randint(1, 100) / 25.0)
        pts.append({"entity": f"e{i:03d}", "growth": xyz[0], "deviation": xyz[1], "rank": xyz[2]})
    df = spark.createDataFrame(
        [("A", "2020-01", "MAT", p["entity"], p["growth"], p["deviation"], p["rank"]) for p in pts],
        "brand_name string, year_month string, period_type string, entity string, growth double, deviation double, rank double",
    )
    got = {}
    for r in neighbours.nearest(df, 5, leaf).orderBy("place").collect():
        got.setdefault(r.me.entity, []).append(r.peer.entity)
    want = {e: near for e, near in brute_nearest(pts, 5).items() if near}
    assert got == want


def test_gap_status_bounds(spark):
    df = spark.createDataFrame(
        [(10.0, "widening"), (5.0, "stable"), (-5.0, "shrinking"), (-10.0, "widening"), (None, "stable"), (3.0, None)],
        "gap double, movement string",
    )
    got = [(r.size_class, r.status) for r in peers.gap_status(df, peers.GROWTH_STATUS, peers.GROWTH_SIZES).collect()]
    assert got == [
        ("Strong", "Exceptional & accelerating"),
        ("Moderate", "Consistently strong"),
        ("Moderate", "Weak & worsening"),
        ("Strong", "Far behind but recovering"),
        (None, None),
        ("Weak", None),
    ]


def test_csv_and_copy(spark, tmp_path):
    (tmp_path / "regions.csv").write_text("Name,Territory_ID,Territory_Name\nR1,7,North\nR2,8,\n")
    df = read_regions_csv(spark, f"file://{tmp_path}/regions.csv")
    assert [tuple(r) for r in df.collect()] == [("R1", "7", "North"), ("R2", "8", None)]
    src, dst = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    replace_table(df, src)
    for _ in range(2):  # idempotent
        assert copy_table(spark, src, dst).first()[0] == 2
    assert spark.read.parquet(dst).filter("territory_name IS NULL").count() == 1


def test_store_writes_once(spark):
    store = Store(spark, SF_DIR + "/once")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert store.table("t", build).count() == 3 and store.table("t", build).count() == 3
    assert len(calls) == 1
    store.forget()
    store.table("t", build)
    assert len(calls) == 2


def test_kept_store_is_taken_over(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    first = Store(spark, "src", folder)
    first.table("t", lambda: spark.range(3))
    Store._written.pop(first.base)  # as in a later application
    later = Store(spark, "src", folder)
    assert later.table("t", lambda: spark.range(9)).count() == 3
    later.forget()
    assert later.table("t", lambda: spark.range(9)).count() == 9
    assert later.table("t", lambda: spark.range(1)).count() == 9


def test_a_source_that_grows_gets_new_tables(spark, tmp_path):
    source, folder = f"file://{tmp_path}/src", f"file://{tmp_path}/kept"
    rows = lambda: Store(spark, source, folder).table("n", lambda: spark.read.parquet(f"{source}/orders.parquet"))
    for t in ("lineitem", "orders", "customer", "nation", "region", "part"):
        spark.range(3).write.parquet(f"{source}/{t}.parquet")
    assert rows().count() == 3
    spark.range(7).write.mode("append").parquet(f"{source}/orders.parquet")
    assert rows().count() == 10


def test_stream_feeds_the_catalog_once(spark, tmp_path):
    from tierwise.streaming.catalog_feed import feed_catalog

    m = metrics(spark, [-1.0, -2.0, -3.0, -4.0, -5.0], [-1.0, -2.0, -3.0, -4.0, -5.0])
    folder = f"file://{tmp_path}"
    m.write.parquet(f"{folder}/metrics")
    catalog = Catalog(spark, f"{folder}/catalog")

    def run(checkpoint):
        arrivals = spark.readStream.schema(METRICS).parquet(f"{folder}/arrived")
        feed_catalog(
            arrivals, lambda: spark.read.parquet(f"{folder}/metrics"), catalog, f"{folder}/{checkpoint}"
        ).awaitTermination()
        return sorted(r.year_month for r in catalog.read().collect())

    m.filter("year_month = '2020-04'").write.mode("append").parquet(f"{folder}/arrived")
    assert run("c1") == ["2020-04"]
    m.filter("year_month = '2020-05'").write.mode("append").parquet(f"{folder}/arrived")
    assert run("c1") == ["2020-04", "2020-05"]
    assert run("c2") == ["2020-04", "2020-05"]  # everything replayed under a new checkpoint


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_copy_keeps_nulls(spark, tmp_path, fmt):
    rows = [("a", None, 1), (None, 2.5, 1), ("", 0.0, 2)]
    src, dst = f"file://{tmp_path}/src", f"file://{tmp_path}/dst"
    replace_table(spark.createDataFrame(rows, "s string, v double, k int"), src)
    assert copy_table(spark, src, dst, fmt=fmt).first()[0] == 3
    got = read_copy(spark, dst, spark.read.parquet(src), fmt).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
