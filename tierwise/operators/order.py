"""Order statistics of groups of any size: places, ranks and shares of peers, medians, without a task that holds a whole group.

Three ways, all exact:

* `numbered` and `within` number rows. They are dealt by ranges of the order, so a large group lies in several partitions one after
  the other; each row is numbered within its partition, and the counts of the partitions before give the offset.
* `tallies` counts the rows of each distinct value first, so ties meet before they travel, and adds the counts up in the order of the
  values the same way. A value's tally tells how many rows of its group lie below, at and above it, wherever
  a border between partitions falls.
* `ranked` brings tallies back to the rows, `medians` reads the middle values off them, `beside` sets a row of each group beside
  the group's rows.

Groups that fit a task are cheaper in one window; the callers take that way up to LARGE rows, with equal results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.sources.store import shared_dir

LARGE = 100_000  # rows of a group from which it is no longer worked off in one task
HOT = 4096  # values that more than one row in so many have are joined by broadcast: there are fewer than HOT of a measure

_INDEX_BITS = 33  # of monotonically_increasing_id: the partition's number stands above them


def written(df: DataFrame) -> DataFrame:
    """df as a written table, the same in each reading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tierwise-order/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dealt(rows: DataFrame, order: Sequence) -> DataFrame:
    """Written rows in ranges of the order: `_part` is the range, `_at` the place within it from 0."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    index = F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return written(spread).select(*rows.columns, F.shiftright("_at", _INDEX_BITS).alias("_part"), index.alias("_at"))


def numbered(rows: DataFrame, *order: Column, position: str = "position") -> DataFrame:
    """rows with their place 1, 2, 3, ... in the order, as a long.

    The order should tell rows apart, or rows that tie in all of it share one partition. What a single task sums up is
    one row a partition.
    """
    stored = _dealt(rows, order)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = stored.join(F.broadcast(offsets), "_part")  # a row a partition
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias(position))


def salts_for(rows: int | None) -> int:
    """Tasks that share a group of so many rows."""
    return 1 + (rows or 0) // LARGE


def beside(rows: DataFrame, few: DataFrame, group: Sequence[str], salts: int = 1, by: str | None = None) -> DataFrame:
    """Each row with the one row of its group in `few`; rows without one go.

    Spark broadcasts `few` where it is small. Where it isn't, the rows of a group are dealt to `salts` tasks by their column
    `by`, and the group's row goes to each of them.
    """
    group = list(group)
    if salts == 1:
        return rows.join(few, group)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*group, "_salt"]).drop("_salt")


def within(rows: DataFrame, group: Sequence[str], order: Sequence[Column], key: str) -> DataFrame:
    """rows with `place` 1, 2, 3, ... in the order of their group, and `group_size`. key tells the rows of a group apart."""
    placed = numbered(rows, *[F.col(c) for c in group], *order, position="_position")
    starts = placed.groupBy(*group).agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("group_size"))
    starts = written(starts)
    salts = salts_for(starts.agg(F.max("group_size")).first()[0])
    placed = beside(placed, starts, group, salts, key)
    return placed.select(*rows.columns, (F.col("_position") - F.col("_first") + 1).alias("place"), "group_size")


def _stacked(rows: DataFrame, keep: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row a known value: `keep`, measure, value. The values are of one type."""
    each = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).alias("value")) for v in values])
    return rows.select(*keep, F.inline(each)).filter(F.col("value").isNotNull())


def tallies(rows: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(group, measure, value, n, below, known): for each distinct known value the rows that have it, the rows of the group
    with smaller ones, and all rows of the group with a known one. A written table. The values are of one type."""
    by = [*group, "measure"]
    counted = _stacked(rows, group, values).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    stored = _dealt(counted, [*by, "value"])
    inside = W.partitionBy("_part", *by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    ranges = stored.groupBy("_part", *by).agg(F.sum("n").alias("_n"))  # a row a range and group
    across = W.partitionBy(*by)
    before = F.sum("_n").over(across.orderBy("_part")) - F.col("_n")
    offsets = ranges.select("_part", *by, before.alias("_before"), F.sum("_n").over(across).alias("known"))
    summed = stored.withColumn("_upto", F.sum("n").over(inside)).join(offsets, ["_part", *by])
    return written(summed.select(*by, "value", "n", (F.col("_before") + F.col("_upto") - F.col("n")).alias("below"), "known"))


def ranked(
    rows: DataFrame, group: Sequence[str], key: str, named: dict[str, str], score: Callable[[Column, Column, Column], Column]
) -> DataFrame:
    """rows with a column for each name of `named` (name -> value column): score(below, n, known) of the row's value among
    the group's; null where the value is unknown. key tells the rows of a group apart.

    Only (group, key, value) travel to the tallies. A value that many rows share, say zero, is looked up in a broadcast
    of the few such values, so its rows stay where they are.
    """
    group = list(group)
    rows = written(rows)
    kinds: dict[str, list[str]] = {}
    for v in dict.fromkeys(named.values()):
        kinds.setdefault(rows.schema[v].dataType.simpleString(), []).append(v)
    scored = []
    for values in kinds.values():
        known = tallies(rows, group, values)
        total = rows.count() * len(values)
        on = [*group, "measure", "value"]
        long = _stacked(rows, [*group, key], values)
        result = score(F.col("below"), F.col("n"), F.col("known"))
        often = known.filter(F.col("n") * HOT > total).select(*on, result.alias("_often"))
        looked = long.join(F.broadcast(often), on, "left")
        rest = looked.filter(F.col("_often").isNull()).drop("_often")
        rest = rest.join(known.filter(F.col("n") * HOT <= total), on).withColumn("_score", result)
        columns = [*group, key, "measure", "_score"]
        scored.append(looked.filter(F.col("_often").isNotNull()).withColumn("_score", F.col("_often")).select(columns))
        scored.append(rest.select(columns))
    pivoted = reduce(DataFrame.unionByName, scored).groupBy(*group, key).agg(
        *[F.max(F.when(F.col("measure") == v, F.col("_score"))).alias(name) for name, v in named.items()]
    )
    return rows.join(pivoted, [*group, key], "left").select(*rows.columns, *named)


def medians(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """(group, name): the exact median of the known values of each group that has one."""
    known = tallies(rows, group, [value])
    middles = F.array(F.floor((F.col("known") - 1) / 2), F.floor(F.col("known") / 2))
    inside = F.size(F.filter(middles, lambda m: (m >= F.col("below")) & (m < F.col("below") + F.col("n"))))
    held = known.withColumn("_hits", inside).filter(F.col("_hits") > 0)  # one or two rows a group
    return held.groupBy(*group).agg((F.sum(F.col("value") * F.col("_hits")) / 2).alias(name))
