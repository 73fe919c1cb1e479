"""Connected components of an undirected graph of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwise.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b); component is the smallest id that can be reached.

    Alternating large-star and small-star steps: each id's neighbours are moved to its smallest neighbour,
    so paths shorten by about half a step and a hub's rows are reduced on the map side. Each step
    is a written table; the driver sees one count and one checksum a step. Without links the result is empty.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = written(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a <> b")
        edges = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
