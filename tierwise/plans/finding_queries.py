"""Registered queries of tiers 4 and 5, readouts, sinks and sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.operators import findings as fnd
from tierwise.operators import insights as ins
from tierwise.operators import readout
from tierwise.operators.catalog import Catalog, WriteReport, catalog_rows, classified_rows
from tierwise.operators.signals import latest
from tierwise.plans.metrics import Pipeline, grain_rows
from tierwise.sources.files import copy_table, replace_table
from tierwise.specs import (
    GRAINS,
    LOUDNESS,
    QUADRANTS,
    SIGNALS,
    TERRITORY,
    Axis,
    Condition,
    FindingSpec,
    Framing,
    GenericSignal,
    Rule,
)


def _axis(name: str, metric: str, kind: str) -> Axis:
    return Axis(
        name,
        GenericSignal(
            entity="region_name",
            time="year_month",
            metric=metric,
            filters=(Condition("period_type", "=", "MAT"),),
            segment_by=("brand_name",),
            strength_kind=kind,
            loud_threshold=LOUDNESS[kind]["loud"],
            carry=("territory_name", "rank_sales_eur"),
        ),
    )


SHARE = _axis("share", "mshare_deviation", "position")
GROWTH = _axis("growth", "growth_deviation", "growth")
SALES = _axis("sales", "growth_py_sales", "growth")

# The side each share x growth finding asks of its two axes.
SIDES = {
    "losing_both": {"share": "bad", "growth": "bad"},
    "slipping": {"share": "good", "growth": "bad"},
    "catching_up": {"share": "bad", "growth": "good"},
}
SHARE_GROWTH = FindingSpec(
    "share_growth",
    (SHARE, GROWTH),
    tuple(Rule(k, QUADRANTS[k], sides) for k, sides in SIDES.items()),
)
OCTANTS = FindingSpec("share_growth_sales", (SHARE, GROWTH, SALES))

PROMOTED = fnd.promote(
    [SIGNALS["mshare_deviation_mat"], SIGNALS["growth_py_sales_mat"]], "promoted", ("territory_name", "rank_sales_eur")
)

# Our default framings.
FRAMINGS = (
    Framing(
        "manager_losing",
        "sales_manager",
        "losing_both",
        "{{region}} ({{territory}}, rank {{rank}}) is losing on both axes: share gap {{share_now}} pp after "
        "{{share_oldest}} pp, growth gap {{growth_now}} pp. Red for {{ months_red }} months [{{severity_band}}].",
        surface=("severity_band = 'critical'", "mat_rank >= 75"),
    ),
    Framing(
        "ceo_losing",
        "ceo",
        "losing_both",
        "{{finding_label}}: {{region}} scores {{severity_score}}; share path {{share_shape}}, "
        "net {{share_net}}, coherence {{share_coherence}}.",
        surface=("severity_band = 'critical'",),
        suppress=("mat_rank < 40",),
    ),
    Framing(
        "rep_slipping",
        "sales_rep",
        "slipping",
        "{{region}}: growth gap {{growth_now}} pp, path length {{growth_magnitude}} pp. Ask {{owner}}.",
        suppress=("severity_score < 2",),
    ),
)


def _mat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(spark, sf_dir).metrics("region")


def _found(spark: SparkSession, sf_dir: str, history: bool = False) -> DataFrame:
    return fnd.findings(_mat(spark, sf_dir), history=history)


def _classified(spark: SparkSession, sf_dir: str, spec: FindingSpec) -> DataFrame:
    rows = fnd.classify_findings(_mat(spark, sf_dir), spec)
    return rows.withColumnRenamed("rank_sales_eur", "mat_rank").orderBy(
        F.desc("severity_score"), F.desc("mat_rank"), "brand_name", "entity"
    )


def _insight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified rows with their memory, framed for every persona."""
    mem = _found(spark, sf_dir).select("brand_name", F.col("region_name").alias("entity"), "months_red")
    rows = fnd.classify_findings(_mat(spark, sf_dir), SHARE_GROWTH).withColumnRenamed(
        "rank_sales_eur", "mat_rank"
    )
    rows = rows.join(mem, ["brand_name", "entity"], "left").fillna(0, ["months_red"])
    return ins.insights(rows, SHARE_GROWTH, FRAMINGS)


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A new catalog folder for one run of a query."""
    store = Pipeline(spark, sf_dir).store
    return Catalog(spark, store.path(f"catalogs/{uuid.uuid4().hex}"))


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of all months, each twice: a batch may repeat its keys."""
    rows = catalog_rows(fnd.flagged(_found(spark, sf_dir, history=True)))
    return rows.unionByName(rows)


def _report(spark: SparkSession, runs: list[tuple[str, WriteReport]]) -> DataFrame:
    rows = [(name, r.inserted, r.skipped, r.total_rows) for name, r in runs]
    return spark.createDataFrame(rows, "run string, inserted bigint, skipped bigint, total_rows bigint")


def _catalog_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    rows = _all_rows(spark, sf_dir)
    before = rows.filter(F.col("year_month") < latest(_mat(spark, sf_dir)))
    runs = [("months_before", catalog.append(before))]
    runs += [("all_months", catalog.append(rows)), ("again", catalog.append(rows))]
    return _report(spark, runs)


def _catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months are stored with a wrong score, then the latest one is written again by force."""
    catalog = _catalog(spark, sf_dir)
    rows = _all_rows(spark, sf_dir)
    catalog.append(rows.withColumn("severity_score", F.lit(-1)))
    catalog.upsert(rows.filter(F.col("year_month") == latest(_mat(spark, sf_dir))))
    return (
        catalog.read()
        .groupBy("year_month", "brand_name")
        .agg(F.count(F.lit(1)).alias("entities"), F.sum("severity_score").alias("score"))
    )


def _full_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    catalog = _catalog(spark, sf_dir)
    catalog.append(catalog_rows(fnd.flagged(_found(spark, sf_dir, history=True))))
    return catalog


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored findings of every brand in the alphabetically first region."""
    catalog = _full_catalog(spark, sf_dir)
    region = Pipeline(spark, sf_dir).regions().agg(F.min("region_name")).scalar()
    rows = catalog.history(F.col("brand_name"), region)
    return rows.select(
        "year_month",
        "brand_name",
        "region_name",
        F.col("finding_key").alias("finding"),
        "severity_band",
        "severity_score",
        "ms_now",
        "growth_now",
        "mat_rank",
        "months_red",
        "escalate",
        "improved",
    )


def _generic_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Three definitions in one catalog: the report, the octants and a promoted composite."""
    catalog = _full_catalog(spark, sf_dir)
    for spec in (OCTANTS, PROMOTED):
        catalog.append(classified_rows(fnd.classify_findings(_mat(spark, sf_dir), spec), spec))
    return catalog


def _catalog_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generic_catalog(spark, sf_dir).read()
    return rows.groupBy("finding_def_id", "brand_name", "finding_key").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("severity_score").alias("score"), F.max("year_month").alias("last_month")
    )


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored evidence of every finding, as text."""
    rows = _generic_catalog(spark, sf_dir).read()
    return rows.select("finding_def_id", "year_month", "brand_name", "region_name", "axes_snapshot")


def _run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two definitions: the given keys of the quadrants, and the octants that occur."""
    quadrants = fnd.run_summary(fnd.flagged(_found(spark, sf_dir)), QUADRANTS).withColumn("definition", F.lit("quadrants"))
    octants = fnd.run_summary(fnd.classify_findings(_mat(spark, sf_dir), OCTANTS)).withColumn("definition", F.lit("octants"))
    return quadrants.unionByName(octants)


def write_all_metrics(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Rewrite the three metric tables, partitioned by period; returns their paths."""
    pipe = Pipeline(spark, sf_dir)
    out = {}
    for name in GRAINS:
        out[name] = pipe.store.path(f"published/{uuid.uuid4().hex}/{name}_metrics")
        replace_table(pipe.compute(name), out[name], ["period_type"])
    return out


def _write_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, path in write_all_metrics(spark, sf_dir).items():
        t = spark.read.parquet(path).groupBy("period_type").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count("market_share").alias("known_shares"),
            F.sum("sales_eur").cast("double").alias("sales_eur"),
        )
        t = t.select(F.lit(f"{name}_metrics").alias("table_name"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def _copy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tables copied to another folder: rows, and NULLs that survived."""
    pipe = Pipeline(spark, sf_dir)
    pipe.sales(), pipe.brand_forecast(), pipe.metrics("region")
    sources = {
        "sales": (pipe.store.path("sales"), "sales_eur"),
        "forecast": (pipe.store.path("forecast"), "sales_eur"),
        "region_metrics_mat": (pipe.store.path("region_metrics/period_type=MAT"), "growth_vs_fcst_eur"),
    }
    out = None
    for name, (src, column) in sources.items():
        dst = pipe.store.path(f"copies/{uuid.uuid4().hex}/{name}")
        copied = copy_table(spark, src, dst)
        nulls = spark.read.parquet(dst).agg(F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"))
        row = copied.select(F.lit(name).alias("table_name"), "rows_copied", nulls.scalar().alias("nulls"))
        out = row if out is None else out.unionByName(row)
    return out


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _mat(spark, sf_dir)
    brand = table.agg(F.min("brand_name")).scalar()
    rows = table.filter(F.col("brand_name") == brand)
    page = readout.table_page(
        rows, ["year_month", "region_name"], {"period_type": "MAT", "territory_id": "0"}, limit=readout.MAX_PAGE, offset=50
    )
    return page.select(
        "year_month", "brand_name", "region_name", "units", F.col("sales_eur").cast("double").alias("sales_eur"),
        "market_share", "total",
    )


def _territory_rows(pipe: Pipeline) -> DataFrame:
    return grain_rows(pipe.monthly(), TERRITORY).withColumnRenamed("own_s", "sales_eur")


def _covered_attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan attainment up to the last month that has a forecast for some brand."""
    pipe = Pipeline(spark, sf_dir)
    last = pipe.brand_forecast().agg(F.max("year_month")).scalar()
    months = pipe.monthly().select("year_month").distinct().filter(F.col("year_month") <= last)
    return readout.plan_attainment(_territory_rows(pipe), pipe.brand_forecast(), calendar=months)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    keys = ("brand_name", "entity", "territory_name", "finding_key", "finding_label")
    sev = ("severity_score", "severity_band", "mat_rank")
    return {
        "write_metrics": _write_metrics,
        "copy_report": _copy_report,
        "table_page": _page,
        "meta_profile": lambda s, d: readout.meta_profile(Pipeline(s, d).monthly()),
        "classify_findings": lambda s, d: _classified(s, d, SHARE_GROWTH).select(
            *keys, *sev, "share_sev", "growth_sev", "share_now", "growth_now", "share_net", "growth_net"
        ),
        "classify_octants": lambda s, d: _classified(s, d, OCTANTS).select(
            *keys, *sev, "share_sev", "growth_sev", "sales_sev"
        ),
        "promoted_findings": lambda s, d: fnd.classify_findings(
            _mat(s, d),
            fnd.promote([SIGNALS["mshare_deviation_mat"], SIGNALS["growth_py_sales_mat"]], "promoted"),
        ).select("brand_name", "entity", "finding_key", "severity_score", "severity_band"),
        "quadrant_findings": lambda s, d: fnd.flagged(_found(s, d)).select(
            "brand_name",
            "region_name",
            "finding_key",
            "finding_label",
            "ms_sev",
            "growth_sev",
            "severity_score",
            "severity_band",
        ),
        "finding_memory": lambda s, d: fnd.memory(_found(s, d, history=True)),
        "find_findings": lambda s, d: fnd.worst_first(fnd.flagged(_found(s, d)).select(*fnd.FINDING_COLUMNS)),
        "finding_summary": lambda s, d: fnd.summary(fnd.flagged(_found(s, d))),
        "recovered_entities": lambda s, d: fnd.recovered(_found(s, d, history=True)),
        "run_summary": _run_summary,
        "catalog_generic": _catalog_generic,
        "finding_provenance": _provenance,
        "catalog_append": _catalog_append,
        "catalog_upsert": _catalog_upsert,
        "catalog_stats": lambda s, d: _full_catalog(s, d).stats(),
        "finding_history": _history,
        "plan_attainment": _covered_attainment,
        "plan_attainment_latest": lambda s, d: readout.plan_attainment(
            _territory_rows(Pipeline(s, d)), Pipeline(s, d).brand_forecast(),
            calendar=Pipeline(s, d).monthly().select("year_month").distinct(),
        ),
        "national_summary": lambda s, d: readout.national_summary(Pipeline(s, d).metrics("national")),
        "territory_readout": lambda s, d: readout.territory_readout(
            Pipeline(s, d).metrics("territory"), Pipeline(s, d).regions()
        ),
        "render_insights": lambda s, d: _insight_rows(s, d).select(
            "framing_id", "persona", "brand_name", "entity", "finding_key", "text"
        ),
        "insight_topn": lambda s, d: ins.top_insights(_insight_rows(s, d)).select(
            "framing_id", "brand_name", "entity", "severity_score", "place", "text"
        ),
        "insight_gate": lambda s, d: _insight_rows(s, d).select(
            "framing_id", "brand_name", "entity", "severity_band", "mat_rank", "surfaces"
        ),
    }
