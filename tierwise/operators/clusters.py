"""Clusters of entities in every brand month, and entities that move from one to another.

Each brand month of each period has clusters of its own. All of them are fitted at once: a step compares every point with the
centres of its brand month and sums the points of each cluster in one aggregation over all brand months. Sums are whole
numbers, so a centre doesn't depend on the order in which partial sums meet, and a repeated task gives the same clusters.

Cluster numbers of two months don't correspond by themselves. Centres of neighbouring months are matched one to one at the least
total squared distance, and an entity has moved if its cluster isn't the one that its former cluster is matched with.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.operators import order
from tierwise.operators.neighbours import GROUP, SCALES
from tierwise.sources.store import shared_dir

# Our defaults: clusters of a brand month, and steps of the fit.
CLUSTERS = 4
STEPS = 8
UNIT = 10_000  # scaled features are whole numbers of 1 / UNIT

SERIES = ["brand_name", "period_type"]
AXES = list(SCALES)


def whole(points: DataFrame) -> DataFrame:
    """Points whose coordinates are whole numbers."""
    return points.select(*GROUP, "entity", *[F.rint(F.col(a) * UNIT).cast("long").alias(a) for a in AXES])


def _centre(j: int, axis: str) -> str:
    return f"c{j}_{axis}"


def _names(k: int) -> list[str]:
    return [_centre(j, a) for j in range(k) for a in AXES]


def starts(points: DataFrame, k: int) -> DataFrame:
    """One row a brand month: its number of points, and k centres spread evenly from the least to the largest coordinates."""
    ends = [f(a).alias(f"{a}_{name}") for a in AXES for f, name in ((F.min, "low"), (F.max, "high"))]
    held = points.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *ends)

    def at(j: int, a: str) -> Column:
        return F.expr(f"{a}_low + (({a}_high - {a}_low) * {2 * j + 1}) div {2 * k}")

    return held.select(*GROUP, "n", *[at(j, a).alias(_centre(j, a)) for j in range(k) for a in AXES])


def _distance(x, y) -> Column:
    """Squared distance of two places given as functions of the axis; the terms are added in the order of the axes."""
    total = None
    for a in AXES:
        d = (x(a) - y(a)).cast("double")
        total = d * d if total is None else total + d * d
    return total


def nearest_centre(k: int) -> Column:
    """The number of the nearest centre, the smaller one of a tie."""
    away = [F.struct(_distance(F.col, lambda a, j=j: F.col(_centre(j, a))).alias("d"), F.lit(j).alias("j")) for j in range(k)]
    return F.array_min(F.array(*away)).getField("j")


def step(points: DataFrame, centres: DataFrame, k: int, salts: int) -> DataFrame:
    """The centres moved to the means of their points; a centre without points stays."""
    near = order.beside(points, centres, GROUP, salts, "entity").withColumn("_near", nearest_centre(k))
    sums = [F.max("n").alias("n")]
    for j in range(k):
        inside = F.col("_near") == j
        sums.append(F.count(F.when(inside, 1)).alias(f"n{j}"))
        for a in AXES:
            sums.append(F.sum(F.when(inside, F.col(a))).alias(f"s{j}_{a}"))
            sums.append(F.max(_centre(j, a)).alias(f"was{j}_{a}"))  # the same in all rows
    held = near.groupBy(*GROUP).agg(*sums)

    def moved(j: int, a: str) -> Column:
        return F.expr(f"if(n{j} > 0, s{j}_{a} div n{j}, was{j}_{a})")

    return held.select(*GROUP, "n", *[moved(j, a).alias(_centre(j, a)) for j in range(k) for a in AXES])


def fit(points: DataFrame, k: int = CLUSTERS, steps: int = STEPS) -> tuple[DataFrame, int]:
    """The written centres of every brand month, one row each, and the salts that its largest one needs."""
    spark = points.sparkSession
    base = f"{shared_dir(spark)}/tierwise-clusters/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
    centres = starts(points, k)
    centres.write.parquet(f"{base}/start")
    centres = spark.read.schema(centres.schema).parquet(f"{base}/start")
    salts = order.salts_for(centres.agg(F.max("n")).first()[0])
    for _ in range(steps):
        centres = step(points, centres, k, salts)
    centres.write.parquet(f"{base}/centres")
    return spark.read.schema(centres.schema).parquet(f"{base}/centres"), salts


def matched(centres: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """Centres with the month before of the same brand and period, and `now_of`: for each cluster of that month its counterpart.

    All k! ways to match are compared; of equal costs the first in the order of the numbers is taken. A series has one row a month.
    """
    months = W.partitionBy(*SERIES).orderBy("year_month")
    before = {f"b_{c}": F.lag(c).over(months) for c in _names(k)}
    pairs = centres.withColumns({**before, "month_before": F.lag("year_month").over(months)})

    def cost(i: int, j: int) -> Column:
        return _distance(lambda a: F.col(f"b_{_centre(i, a)}"), lambda a: F.col(_centre(j, a)))

    pairs = pairs.withColumns({f"_{i}{j}": cost(i, j) for i in range(k) for j in range(k)})
    ways = []
    for way in permutations(range(k)):
        total = F.col(f"_0{way[0]}")
        for i in range(1, k):
            total = total + F.col(f"_{i}{way[i]}")
        ways.append(F.struct(total.alias("cost"), F.array(*[F.lit(j) for j in way]).alias("way")))
    least = F.when(F.col("month_before").isNotNull(), F.array_min(F.array(*ways)).getField("way"))
    return pairs.select(*GROUP, "n", "month_before", *_names(k), least.alias("now_of"))


def _name(near: Column, k: int) -> Column:
    """HighGrowthLowRank and the like: the centre against the mean of the k centres."""
    out = []
    for a, title in (("growth", "Growth"), ("rank", "Rank")):
        of = F.array(*[F.col(_centre(j, a)) for j in range(k)])
        total = F.aggregate(of, F.lit(0).cast("long"), lambda x, y: x + y)
        out.append(F.when(F.get(of, near) * k >= total, f"High{title}").otherwise(f"Low{title}"))
    return F.concat(*out)


def placed(points: DataFrame, k: int = CLUSTERS, steps: int = STEPS) -> DataFrame:
    """Every point with its cluster, the cluster's name, and what its brand month's clusters were a month before."""
    points = whole(points)
    centres, salts = fit(points, k, steps)
    near = order.beside(points, matched(centres, k), GROUP, salts, "entity").withColumn("cluster", nearest_centre(k))
    return near.select(*GROUP, "entity", "cluster", _name(F.col("cluster"), k).alias("name"), "month_before", "now_of")


def cluster_change(points: DataFrame, k: int = CLUSTERS, steps: int = STEPS) -> DataFrame:
    """Entities with a place in two neighbouring months of a brand and period: clusters now and before, and whether they moved.

    cluster_before is the former cluster's counterpart of now, so equal numbers mean the same cluster. The finding's strength is high.
    """
    series = W.partitionBy(*SERIES, "entity").orderBy("year_month")
    before = {f"{c}_before": F.lag(c).over(series) for c in ("year_month", "cluster", "name")}
    both = placed(points, k, steps).withColumns(before).filter(F.col("year_month_before") == F.col("month_before"))
    now_of = F.get("now_of", F.col("cluster_before"))
    changed = now_of != F.col("cluster")
    return both.select(
        *GROUP,
        "entity",
        F.col("cluster").alias("cluster_now"),
        now_of.alias("cluster_before"),
        F.col("name").alias("name_now"),
        F.col("name_before"),
        changed.alias("changed"),
        F.when(changed, "high").alias("strength"),
    )
