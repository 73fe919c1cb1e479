"""Order lines and orders kept in buckets of the order key, so that they meet without a shuffle.

Written once for a source. Lines carry their brand and are added up by order, ship month and brand before they are dealt, so an
order with a large part of all lines is at most one row a month and brand; orders carry their month and country. Both
sides have the same buckets, so every later build of the cells reads bucket against bucket: the only exchange is that of the
partial sums by cell. Amounts stay the exact whole numbers of the lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.sources.files import read_if_exists
from tierwise.sources.orderlines import CELL, amounts, order_lines, placed_orders, table
from tierwise.sources.store import Store

BUCKET_BYTES = 16 << 20  # bytes of the line files for each bucket, about a million lines: a task sorts one
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000  # Spark refuses more
SPLIT_BYTES = 16 << 20  # bytes of the line files that one task reads: few lines of an order meet there, so it holds nearly all of them

_SPLIT = "spark.sql.files.maxPartitionBytes"

LINES = "l_orderkey bigint, ship_month int, p_brand string, qty bigint, value decimal(29,0)"
ORDERS = "o_orderkey bigint, order_month int, c_nationkey int"


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """Buckets in proportion to the line files; only their listing is read."""
    files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-int(files.agg(F.sum("length")).first()[0] or 0) // BUCKET_BYTES)))


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Files are read in splits of SPLIT_BYTES at most, so what a task holds doesn't follow the size of the files."""
    before = spark.conf.get(_SPLIT)
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(_SPLIT, str(min(SPLIT_BYTES, least)))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def _columns(ddl: str) -> list:
    """The columns of a layout in its types: those of the source may be narrower."""
    return [F.col(name).cast(kind).alias(name) for name, kind in (field.split() for field in ddl.split(", "))]


class BucketedLines:
    """The layout of one source, in the folder of its store; a kept folder serves later applications."""

    def __init__(self, store: Store, buckets: int | None = None):
        self.store, self.spark, self.buckets = store, store.spark, buckets

    def _name(self, side: str) -> str:
        return f"tierwise_{side}_{hashlib.sha256(self.store.path('').encode()).hexdigest()[:12]}"

    def _lines(self) -> DataFrame:
        """Sums of the lines by order, ship month and brand. Lines without an order, a part or a known part count nowhere."""
        part = table(self.spark, self.store.source, "part").select("p_partkey", "p_brand")
        lines = order_lines(table(self.spark, self.store.source, "lineitem")).where("l_orderkey is not null")
        branded = lines.join(part, lines.l_partkey == part.p_partkey)
        return branded.groupBy("l_orderkey", "ship_month", "p_brand").agg(F.sum("qty").alias("qty"), F.sum("value").alias("value"))

    def _write(self, side: str, rows: DataFrame, key: str, ddl: str, n: int) -> None:
        dealt = rows.select(*_columns(ddl)).repartition(n, key)  # one file a bucket
        writer = dealt.write.format("parquet").mode("overwrite").bucketBy(n, key).sortBy(key)
        with small_splits(self.spark):
            writer.option("path", self.store.path(f"bucketed/{side}")).saveAsTable(self._name(side))

    def _register(self, side: str, key: str, ddl: str, n: int) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(side)} ({ddl}) USING parquet "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{self.store.path(f'bucketed/{side}')}'"
        )

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Lines and orders in equal buckets, written on first use."""
        marker = self.store.path("done/bucketed")
        done = read_if_exists(self.spark, marker, "n int")
        if done is None:
            n = self.buckets or bucket_count(self.spark, self.store.source)
            self._write("lines", self._lines(), "l_orderkey", LINES, n)
            orders = placed_orders(self.spark, self.store.source).where("o_orderkey is not null")
            self._write("orders", orders, "o_orderkey", ORDERS, n)
            self.spark.createDataFrame([(n,)], "n int").coalesce(1).write.mode("overwrite").parquet(marker)
        else:
            n = done.first().n
            self._register("lines", "l_orderkey", LINES, n)
            self._register("orders", "o_orderkey", ORDERS, n)
        return self.spark.table(self._name("lines")), self.spark.table(self._name("orders"))

    def cells(self) -> DataFrame:
        """The cells of all lines, as `orderlines.cells` gives them."""
        lines, orders = self.tables()
        met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return met.groupBy(*CELL).agg(*amounts())
