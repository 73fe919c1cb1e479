"""Order lines from a file stream into the monthly cells from which sales and forecast roll up.

Event time is the month of shipment. Each batch adds its sums to the months that its lines fall in, however old they are, so sums
are exact at all times; the watermark only tells what is final. It follows the latest shipment seen by `delay` months: months
before it are closed, and what still arrives for them is kept apart as a correction, so readers of a closed month can tell.

A line is counted once; lines are the same if their order, number and all that is measured of them are. Lines of one batch
meet by these, and those of earlier batches are looked up in a ledger of line keys: of the months that the batch touches, and there
only within the batch's range of order keys, which row groups sorted by order key let a reader skip to. A batch that is repeated after a failure finds what its
first attempt wrote under its own feed and number, doesn't look at it, and replaces it. A feed that starts anew under
another checkpoint reads everything again and adds nothing.

Lines without a shipment date, or whose order, customer or part is unknown when they come, are in no cell, as in the batch build.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierwise.sources import orderlines
from tierwise.sources.files import read_if_exists

KEY = ("l_orderkey", "l_linenumber")
MEASURED = ("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
DELAY = 3  # our default, in months

_LEDGER = "l_orderkey long, l_linenumber long, content long, feed string, batch long, ship_month int"
_CELLS = f"order_month int, p_brand string, c_nationkey long, units {orderlines.MONEY}, sales_eur {orderlines.MONEY}, late boolean, feed string, batch long, ship_month int"
_MARKS = "latest int, feed string, batch long"


@dataclass
class MonthlyFacts:
    """Cells in a folder, built up batch by batch. sf_dir holds orders, customers, parts and countries."""

    spark: SparkSession
    sf_dir: str
    folder: str
    delay: int = DELAY

    def _read(self, name: str, schema: str) -> DataFrame:
        found = read_if_exists(self.spark, f"{self.folder}/{name}", schema)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _put(self, rows: DataFrame, name: str, *by: str) -> None:
        """Replaces what an earlier attempt of the same batch has written; other batches stay."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("feed", "batch", *by).parquet(f"{self.folder}/{name}")

    def _done(self, name: str, schema: str) -> DataFrame:
        """Rows of batches that ended: a batch's mark is written last."""
        marks = self._read("marks", _MARKS).select("feed", "batch").distinct()
        return self._read(name, schema).join(marks, ["feed", "batch"], "left_semi")

    def closed_before(self, others: Column | None = None) -> int | None:
        """The watermark: the month number before which months are closed, as the batches that `others` names (or all) left it."""
        marks = self._read("marks", _MARKS)
        latest = (marks if others is None else marks.filter(others)).agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.delay

    def add(self, lines: DataFrame, batch: int, feed: str = "main") -> None:
        """Counts the lines of a batch that no other batch has counted before."""
        month = orderlines.month_number(F.col("l_shipdate")).cast("int")
        keyed = lines.select(*KEY, *MEASURED).dropDuplicates().filter(F.col("l_orderkey").isNotNull())
        keyed = keyed.withColumns({"ship_month": month, "content": F.xxhash64(*MEASURED)}).filter(F.col("ship_month").isNotNull())
        others = (F.col("feed") != feed) | (F.col("batch") < batch)
        mine = {"feed": F.lit(feed), "batch": F.lit(batch).cast("long")}
        keyed = keyed.persist()  # one batch, read for its range and again for its sums
        try:
            low, high, latest, months = keyed.agg(
                F.min("l_orderkey"), F.max("l_orderkey"), F.max("ship_month"), F.collect_set("ship_month")
            ).first()
            if latest is None:
                return
            # literals, so partitions of other months and row groups of other orders are not read
            seen = self._read("ledger", _LEDGER).filter(
                F.col("ship_month").isin(months) & F.col("l_orderkey").between(low, high) & others
            )
            same = [*KEY, "content"]
            fresh = keyed.join(seen.select(*same), same, "left_anti")
            closed = self.closed_before(others)
            late = F.lit(False) if closed is None else F.col("ship_month") < closed
            cells = orderlines.cells(self.spark, self.sf_dir, fresh)
            self._put(cells.withColumns({"late": late, **mine}), "cells", "ship_month")
            named = fresh.select(*[F.col(k).cast("long") for k in same], "ship_month").withColumns(mine)
            order = ("ship_month", "l_orderkey")
            self._put(named.repartitionByRange(*order).sortWithinPartitions(*order), "ledger", "ship_month")
            self._put(self.spark.createDataFrame([(latest, feed, batch)], _MARKS), "marks")
        finally:
            keyed.unpersist()

    def cells(self) -> DataFrame:
        """The sums of all lines so far, with the columns of orderlines.cells."""
        return self._done("cells", _CELLS).groupBy(*orderlines.CELL).agg(
            *[F.sum(c).cast(orderlines.MONEY).alias(c) for c in ("units", "sales_eur")]
        )

    def sales(self) -> DataFrame:
        return orderlines.sales_of_cells(self.cells(), self.spark, self.sf_dir)

    def corrections(self) -> DataFrame:
        """Sums that came for a month after it was closed: (ship_month, feed, batch, units, sales_eur)."""
        late = self._done("cells", _CELLS).filter("late")
        return late.groupBy("ship_month", "feed", "batch").agg(*[F.sum(c).cast(orderlines.MONEY).alias(c) for c in ("units", "sales_eur")])

    def changed(self, batch: int, feed: str = "main") -> DataFrame:
        """(year_month, brand_name, c_nationkey) to which a batch has added something."""
        touched = self._done("cells", _CELLS).filter((F.col("feed") == feed) & (F.col("batch") == batch))
        return touched.select(orderlines.month_text(F.col("ship_month")).alias("year_month"), F.col("p_brand").alias("brand_name"), "c_nationkey").distinct()


def feed_facts(lines: DataFrame, facts: MonthlyFacts, checkpoint: str) -> StreamingQuery:
    """`lines` is a stream of order lines; what is there is worked off, batch by batch."""
    feed = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return (
        lines.writeStream.foreachBatch(lambda rows, batch: facts.add(rows, batch, feed))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
