"""Dimension files and stored metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header of the territory file.
REGION_CSV_SCHEMA = "Name string, Territory_ID string, Territory_Name string"


def read_regions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Region dimension from a headed CSV file, by column name; all values are text. A missing column is an error."""
    rows = spark.read.option("header", True).csv(path)
    require_columns_of(rows, [field.split()[0] for field in REGION_CSV_SCHEMA.split(", ")], path)
    return rows.select(
        F.col("Name").alias("region_name"),
        F.col("Territory_ID").alias("territory_id"),
        F.col("Territory_Name").alias("territory_name"),
    )


def require_columns_of(df: DataFrame, names: Sequence[str], path: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; it has {df.columns}")


def read_if_exists(spark: SparkSession, path: str, schema: str, **options) -> DataFrame | None:
    """The parquet table at a path, or None where there is none."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def for_partitions(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows brought together by output partition, so that a partition gets few files. Rebalancing
    is adaptive: a partition with a large part of the rows is split over several tasks."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Drop and rewrite a table. ``df`` must not read from ``path``."""
    rows = for_partitions(df, partition_by)
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


# Fixed value: how a missing value is written to text files.
NULL_MARKER = r"\N"


def copy_table(
    spark: SparkSession, src: str, dst: str, partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> DataFrame:
    """Truncate-and-reload copy of a parquet table into another folder and format.

    NULLs stay NULL: text formats carry a marker, so an empty string is not taken for one. Returns one
    row: the rows found in the copy.
    """
    rows = spark.read.parquet(src)
    writer = for_partitions(rows, partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.format(fmt).options(**_text_options(fmt)).save(dst)
    return read_copy(spark, dst, rows, fmt).agg(F.count(F.lit(1)).alias("rows_copied"))


def read_copy(spark: SparkSession, dst: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """A copied table, with the schema of its source."""
    return spark.read.format(fmt).schema(like.schema).options(**_text_options(fmt)).load(dst)


def _text_options(fmt: str) -> dict[str, str]:
    # Spark escapes with a backslash by default, which the marker itself contains.
    return {"header": "true", "nullValue": NULL_MARKER, "escape": '"'} if fmt == "csv" else {}


def require_columns(df: DataFrame, names: Sequence[str], what: str = "column") -> None:
    """Refuse names that are not columns of the table."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown {what} {unknown}; the table has {df.columns}")
