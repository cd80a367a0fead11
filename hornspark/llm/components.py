"""Connected components of a distributed graph, by alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond (2014). Each step hangs a vertex's neighbours
on the least one. Minima are aggregated before the shuffle. Edges then meet the minimum of their vertex: those of vertices with very many neighbours, of
which there can only be few, by a broadcast that leaves them where they are; the others by a join on the vertex. So no task gets all edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.sources.scratch import Scratch

#: A vertex is a hub if it has this share of all edges, but at least HUB of them: there are at most 2 * HUB_SHARE hubs.
HUB, HUB_SHARE = 256, 2000


def _with_least(around: DataFrame, hub: int) -> DataFrame:
    """a, b, m: each edge with the least of its vertex a and of all neighbours of a."""
    least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("edges"))
    hubs = F.broadcast(least.filter(F.col("edges") > hub).select("a", "m"))
    met = around.join(hubs, "a", "left")  # in both branches below, which share the one broadcast
    # The other side grows with the edges: it is merged, at any size, rather than sent through the driver.
    others = met.filter("m is null").drop("m").join(least.filter(F.col("edges") <= hub).select("a", "m").hint("merge"), "a")
    return others.unionByName(met.filter("m is not null"))


def _star(edges: DataFrame, *, large: bool, hub: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(both if large else both.filter("b < a"), hub)
    if large:
        out = found.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = found.select(F.col("b").alias("a"), F.col("m").alias("b")).union(found.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: every vertex that isn't the least of its component, with the least one."""
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    edges, n = scratch.write_counted(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        hub = max(HUB, n // HUB_SHARE)
        large = scratch.write(_star(edges, large=True, hub=hub))
        new, n, now = scratch.write_counted(_star(large, large=False, hub=hub), mark=mark)
        scratch.forget(edges, large)
        edges = new
        if (n, now) == before:
            return edges
        before = n, now
