"""The catalog of findings: an append-only table with a unique key, first write wins.

A write puts its rows into folders of its own, one a month, and then adds a version: the list of all live folders with
their row counts. Readers take the newest version, so they see a write whole or not at all, and a frame that was read before
a write still finds its files. Counts come from the versions, not from the rows. There is one writer at a time: of two that
add the same version the second fails. Files of older versions stay until the folder is cleared by its owner.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.operators.findings import axes_snapshot, snapshot
from tierwise.sources.files import for_partitions, read_if_exists
from tierwise.specs import SHARE_GROWTH_ID, FindingSpec

KEY = ["finding_def_id", "brand_name", "region_name", "year_month"]
SCHEMA = (
    "finding_def_id string, brand_name string, region_name string, territory_name string, "
    "recorded_at timestamp, finding_key string, severity_band string, severity_score int, "
    "axes_snapshot string, ms_now double, ms_sev int, growth_now double, growth_sev int, mat_rank int, "
    "market_share double, months_red int, escalate int, improved int, year_month string"
)
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]


VERSION = "version int, year_month string, folder string, row_count long"


def catalog_rows(flagged: DataFrame) -> DataFrame:
    """Rows of the share x growth report in the shape of the catalog, with their evidence."""
    made = flagged.withColumns(
        {
            "finding_def_id": F.lit(SHARE_GROWTH_ID),
            "recorded_at": F.current_timestamp(),
            "axes_snapshot": snapshot(),
            "escalate": F.col("escalate").cast("int"),
            "improved": F.col("improved").cast("int"),
        }
    )
    return made.select(*COLUMNS)


def classified_rows(classified: DataFrame, spec: FindingSpec) -> DataFrame:
    """Rows of any classified definition in the shape of the catalog; its axes are the evidence.

    The entity takes the place of the region. Columns that only the share x growth report has are NULL.
    """
    made = {
        "finding_def_id": F.lit(spec.id),
        "region_name": F.col("entity"),
        "recorded_at": F.current_timestamp(),
        "axes_snapshot": axes_snapshot(spec),
    }
    if "mat_rank" not in classified.columns and "rank_sales_eur" in classified.columns:
        made["mat_rank"] = F.col("rank_sales_eur")
    rows = classified.withColumns(made)
    types = dict(field.split() for field in SCHEMA.split(", "))
    return rows.select(
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS]
    )


@dataclass(frozen=True)
class WriteReport:
    inserted: int
    skipped: int
    total_rows: int


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _live(self) -> tuple[int, list]:
        """The newest version and its folders; their number grows with months and writes, not with rows."""
        versions = read_if_exists(self.spark, f"{self.path}/versions", VERSION, recursiveFileLookup=True)
        if versions is None:
            return 0, []
        rows = versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).collect()
        return (rows[0].version, rows) if rows else (0, [])

    def _rows(self, live: list) -> DataFrame:
        folders = [f"{self.path}/{r.folder}" for r in live if r.folder]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """All rows; empty before the first write. A file that is missing is an error."""
        return self._rows(self._live()[1])

    def _stage(self, rows: DataFrame) -> DataFrame:
        """One row for each key of the batch, written: the one recorded first, of equal ones the most severe, then by
        finding; n counts the rows of the key. There is one staging folder, which the next write replaces."""
        order = F.struct("recorded_at", -F.col("severity_score"), "finding_key")
        kept = rows.groupBy(*KEY).agg(F.min_by(F.struct(*COLUMNS), order).alias("row"), F.count(F.lit(1)).alias("n"))
        at = f"{self.path}/staged"
        kept.select("row.*", "n").write.mode("overwrite").parquet(at)
        return self.spark.read.schema(f"{SCHEMA}, n long").parquet(at)

    def _add(self, rows: DataFrame, version: int, kept: list) -> int:
        """Writes rows and a version of them and the kept folders; returns how many rows were written."""
        folder = f"rows/{uuid.uuid4().hex}"
        rows = rows.select(*COLUMNS, F.col("year_month").alias("month"))
        writer = for_partitions(rows, ["month"]).write.partitionBy("month")
        writer.parquet(f"{self.path}/{folder}")
        made = self.spark.read.schema(f"{SCHEMA}, month string").parquet(f"{self.path}/{folder}")
        counts = [(r["month"], r["count"]) for r in made.groupBy("month").count().collect()]
        live = [(version + 1, r.year_month, r.folder, r.row_count) for r in kept]
        live += [(version + 1, m, f"{folder}/month={m}", n) for m, n in counts]
        listed = self.spark.createDataFrame(live or [(version + 1, None, None, 0)], VERSION)
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/v{version + 1:08d}")
        return sum(n for _, n in counts)

    def _begun(self, rows: DataFrame) -> tuple[DataFrame, int, int, list, set[str]]:
        version, live = self._live()
        staged = self._stage(rows)
        months = {r.year_month: r.n for r in staged.groupBy("year_month").agg(F.sum("n").alias("n")).collect()}
        return staged, sum(months.values()), version, live, set(months)

    def append(self, rows: DataFrame) -> WriteReport:
        """Insert rows whose key is absent; existing rows are never touched. Of rows that share a key one is inserted.

        Only the folders of the months that are written are read.
        """
        staged, offered, version, live, months = self._begun(rows)
        before = sum(r.row_count for r in live)
        existing = self._rows([r for r in live if r.year_month in months])
        inserted = self._add(staged.join(existing.select(*KEY), KEY, "left_anti"), version, live) if offered else 0
        return WriteReport(inserted, offered - inserted, before + inserted)

    def upsert(self, rows: DataFrame) -> WriteReport:
        """Replace rows of the same key and insert the others; touched months get new folders.

        ``skipped`` counts the rows that replaced an older one, and those that share a key with another of the batch.
        """
        staged, offered, version, live, months = self._begun(rows)
        before = sum(r.row_count for r in live)
        if not offered:
            return WriteReport(0, 0, before)
        untouched = [r for r in live if r.year_month not in months]
        existing = self._rows([r for r in live if r.year_month in months])
        kept = existing.join(staged.select(*KEY), KEY, "left_anti")
        written = self._add(kept.select(*COLUMNS).unionByName(staged.select(*COLUMNS)), version, untouched)
        total = sum(r.row_count for r in untouched) + written
        return WriteReport(total - before, offered - (total - before), total)

    def stats(self, finding_def_id: str = SHARE_GROWTH_ID) -> DataFrame:
        """Row count and distinct brand months of one finding definition."""
        return (
            self.read()
            .filter(F.col("finding_def_id") == finding_def_id)
            .agg(
                F.count(F.lit(1)).alias("total_rows"),
                F.countDistinct("brand_name", "year_month").alias("periods"),
            )
        )

    def history(self, brand, region, finding_def_id: str = SHARE_GROWTH_ID) -> DataFrame:
        """Rows of one entity, oldest first. Brand and region may be values or subqueries."""
        return (
            self.read()
            .filter(
                (F.col("finding_def_id") == finding_def_id)
                & (F.col("brand_name") == brand)
                & (F.col("region_name") == region)
            )
            .orderBy("year_month")
        )
