"""Nearest peers of an entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tierwise.functions.numeric import rnd
from tierwise.operators import order

GROUP = ["brand_name", "year_month", "period_type"]

# Our defaults: what counts as one unit of distance, and as deviating, per compared metric.
SCALES = {"growth": 10.0, "deviation": 1.0, "rank": 25.0}
OFF = 1.0
NEIGHBOURS = 5
LEAF = 64  # places of a leaf; a brand month with no more points is compared whole
SLACK = 1e-8  # more than the rounding of a squared distance


def features(metrics: DataFrame, entity: str = "region_name") -> DataFrame:
    """Scaled growth, share deviation and rank of entities that have all three."""
    return (
        metrics.select(
            *GROUP,
            F.col(entity).alias("entity"),
            (F.col("growth_py_sales") / SCALES["growth"]).alias("growth"),
            (F.col("mshare_deviation") / SCALES["deviation"]).alias("deviation"),
            (F.col("rank_sales_eur") / SCALES["rank"]).alias("rank"),
        )
        .filter("growth IS NOT NULL AND deviation IS NOT NULL AND rank IS NOT NULL")
    )


AXES = list(SCALES)
PLACE = [*GROUP, *AXES]


def _squared(x: Column, y: Column) -> Column:
    """Squared distance of two structs, at 9 decimals."""
    total = F.lit(0.0)
    for a in AXES:
        d = x.getField(a) - y.getField(a)
        total = total + d * d
    return rnd(total, 9)


def _closest(me: Column, others: Column, k: int) -> Column:
    """The first k of `others`, structs of entity and axes, as structs (d2, entity, axes); ties by entity."""
    each = F.transform(
        others, lambda p: F.struct(_squared(me, p).alias("d2"), p.getField("entity").alias("entity"), *[p.getField(a).alias(a) for a in AXES])
    )
    return F.slice(F.sort_array(each), 1, k)


def nearest_lists(points: DataFrame, k: int = NEIGHBOURS, leaf: int = LEAF) -> DataFrame:
    """Each point with `near`, its k nearest peers of the brand month as structs (d2, entity, axes); ties by entity.

    Brand months of up to `leaf` points are gathered and compared whole. Where there is a larger one, space is split for all brand
    months at once, see _by_space. Points without a peer have no row.
    """
    n = points.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    me = F.struct("entity", *AXES)
    if n > leaf:
        return _by_space(points, k, leaf, n)
    # a set number of partitions: few bytes, but much work for each, so they shouldn't be put together
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *GROUP)
    gathered = dealt.groupBy(*GROUP).agg(F.collect_list(me).alias("all")).filter(F.size("all") > 1)
    each = gathered.select(*GROUP, "all", F.explode("all").alias("me"))
    return each.select(*GROUP, "me", _without(F.col("me.entity"), _closest(F.col("me"), F.col("all"), k + 1), k).alias("near"))


def _without(entity: Column, near: Column, k: int) -> Column:
    """The first k of the k + 1 closest, the point itself left out."""
    return F.slice(F.filter(near, lambda x: x.getField("entity") != entity), 1, k)


def _places(points: DataFrame, k: int) -> DataFrame:
    """Different places with the first k + 1 names at each: of points in one place no more can be among anyone's nearest."""
    pile = W.partitionBy(*PLACE).orderBy("entity")
    heads = points.withColumn("_n", F.row_number().over(pile)).filter(F.col("_n") <= k + 1)
    return heads.groupBy(*PLACE).agg(F.collect_list("entity").alias("names")).withColumn("_id", F.xxhash64(*AXES))


def _split(places: DataFrame, levels: int, n: int) -> DataFrame:
    """places with `node`, the number of their leaf: the root is 1, the halves of a node are 2 node and 2 node + 1.

    Nodes are halved by count, along one axis after the other. Nodes too large for a task are numbered over ranges.
    """
    places = places.withColumn("node", F.lit(1).cast("long"))
    for level in range(levels):
        turn = [AXES[(level + i) % len(AXES)] for i in range(len(AXES))]
        group = [*GROUP, "node"]
        if n >> level > order.LARGE:
            placed = order.within(places, group, [F.col(a) for a in turn], "_id")
        else:
            inside = W.partitionBy(*group)
            size = F.count(F.lit(1)).over(inside)
            placed = places.withColumns({"place": F.row_number().over(inside.orderBy(*turn)), "group_size": size})
        half = (F.col("place") * 2 > F.col("group_size") + 1).cast("long")
        places = placed.withColumn("node", F.col("node") * 2 + half).drop("place", "group_size")
    return order.written(places)


def _by_space(points: DataFrame, k: int, leaf: int, n: int) -> DataFrame:
    """nearest_lists by a tree of boxes, exactly.

    The (k + 1)-th distance within a place's own leaf bounds the true one. From the root down, a place goes on to those halves whose box
    comes within that distance; in the leaves it arrives at, the closest names are taken. All places of all brand months descend
    in one join a level, and none is compared with all others.
    """
    levels = math.ceil(math.log2(n / leaf))
    places = _split(_places(points, k), levels, n)
    ups = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda i: F.call_function("shiftright", F.col("node"), i))
    bounds = [f(a).alias(f"{a}_{name}") for a in AXES for f, name in ((F.min, "low"), (F.max, "high"))]
    leaves = places.groupBy(*GROUP, "node").agg(*bounds)
    above = [F.min(f"{a}_low").alias(f"{a}_low") for a in AXES] + [F.max(f"{a}_high").alias(f"{a}_high") for a in AXES]
    boxes = leaves.withColumn("node", F.explode(ups)).groupBy(*GROUP, "node").agg(*above)
    boxes = order.written(boxes)

    entry = F.struct(*AXES, "names")
    held = places.groupBy(*GROUP, "node").agg(F.collect_list(entry).alias("held"))  # a leaf
    spread = F.flatten(
        F.transform("held", lambda p: F.transform(p.getField("names"), lambda e: F.struct(e.alias("entity"), *[p.getField(a).alias(a) for a in AXES])))
    )
    held = order.written(held.select(*GROUP, "node", "held", spread.alias("others")))
    own = held.select(*GROUP, "node", "others", F.explode("held").alias("me"))
    own = own.select(*GROUP, "node", "me", _closest(F.col("me"), F.col("others"), k + 1).alias("near"))
    reach = F.coalesce(F.get("near", F.lit(k)).getField("d2"), F.lit(float("inf"))) + SLACK
    own = order.written(own.select(*GROUP, *[F.col(f"me.{a}").alias(a) for a in AXES], "node", "near", reach.alias("reach")))

    seeking = own.select(*PLACE, "reach", F.col("node").alias("_own"), F.lit(1).cast("long").alias("node"))
    seeking = seeking.withColumn("_id", F.xxhash64(*AXES))
    for level in range(1, levels + 1):
        away = F.lit(0.0)
        for a in AXES:
            d = F.greatest(F.col(f"{a}_low") - F.col(a), F.col(a) - F.col(f"{a}_high"), F.lit(0.0))
            away = away + d * d
        down = seeking.withColumn("node", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)))
        met = order.beside(down, boxes, [*GROUP, "node"], order.salts_for(n >> level), "_id")
        seeking = met.filter(away <= F.col("reach")).select(*seeking.columns)
    seeking = seeking.filter(F.col("node") != F.col("_own"))
    arrived = seeking.join(held.select(*GROUP, "node", "others"), [*GROUP, "node"])
    found = arrived.select(*PLACE, _closest(F.struct(*AXES), F.col("others"), k + 1).alias("near"))
    lists = found.unionByName(own.select(*PLACE, "near")).groupBy(*PLACE).agg(F.flatten(F.collect_list("near")).alias("near"))
    near = _without(F.col("entity"), F.slice(F.sort_array("near"), 1, k + 1), k)
    named = points.join(lists, PLACE).select(*GROUP, F.struct("entity", *AXES).alias("me"), near.alias("near"))
    return named.filter(F.size("near") > 0)


def nearest(points: DataFrame, k: int = NEIGHBOURS, leaf: int = LEAF) -> DataFrame:
    """One row a point and peer: me, peer, d2 and place 1 to k."""
    rows = nearest_lists(points, k, leaf).select(*GROUP, "me", F.posexplode("near").alias("place", "x"))
    peer = F.struct(F.col("x.entity").alias("entity"), *[F.col(f"x.{a}").alias(a) for a in AXES])
    return rows.select(*GROUP, "me", peer.alias("peer"), F.col("x.d2").alias("d2"), (F.col("place") + 1).alias("place"))


def _median(axis: str) -> Column:
    """The median of an axis over the nearest peers, a short array."""
    ordered, n = F.array_sort(F.transform("near", lambda x: x.getField(axis))), F.size("near")
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def outliers(points: DataFrame, k: int = NEIGHBOURS, off: float = OFF, leaf: int = LEAF) -> DataFrame:
    """Entities that differ from the median of their nearest peers on at least two metrics."""
    lists = nearest_lists(points, k, leaf)
    count = F.lit(0)
    for a in AXES:
        middle = rnd(_median(a), 6)
        count = count + (F.abs(F.col(f"me.{a}") - middle) > off).cast("int")
    d2 = F.aggregate("near", F.lit(0.0), lambda total, x: total + x.getField("d2"))
    neighbours = F.size("near").cast("long")
    return lists.withColumn("metrics_off", count).select(
        *GROUP,
        F.col("me.entity").alias("entity"),
        neighbours.alias("neighbours"),
        rnd(F.sqrt(rnd(d2, 6) / neighbours), 4).alias("distance"),
        "metrics_off",
        (F.col("metrics_off") >= 2).alias("outlier"),
    )
