"""New metric files as a stream into the catalog.

Each micro-batch names the months that arrived; findings of those months are scored from the stored
metric table and appended. The append ignores keys it already holds, so a batch that is replayed
after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierwise.operators import findings as fnd
from tierwise.operators.catalog import Catalog, catalog_rows


LOOK_BACK = 5  # three lags, and two earlier months of the red memory


def _back(month: str, n: int) -> str:
    year, number = divmod(int(month[:4]) * 12 + int(month[5:]) - 1 - n, 12)
    return f"{year:04d}-{number + 1:02d}"


def feed_catalog(
    arrivals: DataFrame, metrics: Callable[[], DataFrame], catalog: Catalog, checkpoint: str
) -> StreamingQuery:
    """``arrivals`` is a stream with a ``year_month`` column; ``metrics`` reads the metric table."""

    def batch(rows: DataFrame, _batch_id: int) -> None:
        months = sorted(r.year_month for r in rows.select("year_month").distinct().collect() if r.year_month)
        if not months:
            return
        # the months of the batch and what their scores look back on; a literal range prunes the scan
        history = metrics().filter(F.col("year_month").between(_back(months[0], LOOK_BACK), months[-1]))
        scored = fnd.flagged(fnd.findings(history, history=True))
        catalog.append(catalog_rows(scored.filter(F.col("year_month").isin(months))))

    return (
        arrivals.select(F.col("year_month"))
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
