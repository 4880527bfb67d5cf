"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import observed, removed


def _moved(near: DataFrame, least: DataFrame) -> DataFrame:
    """Each neighbour v of u with the node m that u's neighbours move to.

    The second key, which follows from the first, has both sides dealt out for the join;
    so the many neighbours of one node can be split over tasks while the job runs.
    """
    near, least = (rows.withColumn("h", F.xxhash64("u")) for rows in (near, least))
    return near.join(least, ["u", "h"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to itself."""
    near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _moved(near.where("v > u"), least)


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (edges go from larger to smaller) and its smaller neighbours move to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _moved(edges, least).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of an edge table (u, v).

    component is the smallest node that can be reached. Large-star and small-star
    steps alternate until the edges no longer change, however many rounds that takes;
    it always ends, as edges only ever move to smaller nodes. Each round is written to
    the shared folder, so that no plan grows and a lost executor costs one round at
    most; the table of the round before is deleted. Count and hash of the edges are
    taken while they are written. Edges with a null end are ignored; loops keep their
    node. An empty table gives an empty one.
    """
    sums = {"n": F.count(F.lit(1)), "s": F.bit_xor(F.xxhash64("u", "v")), "loops": F.count_if(F.col("u") == F.col("v"))}
    named = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    first, mark, _ = observed(named.distinct(), "edges", **sums)
    loops, now, before, old = mark["loops"], first.where("u <> v"), None, None
    while mark["n"] and mark != before:
        before = mark
        now, mark, path = observed(_small_star(_large_star(now)), "edges", **sums)
        if old:
            removed(now.sparkSession, old)
        old = path
    known = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    known = known.union(now.select("v", "v").distinct())
    if loops:
        alone = first.where("u = v").select(F.col("u").alias("node")).join(known.select("node"), "node", "left_anti")
        known = known.union(alone.select("node", F.col("node").alias("component")))
    return known
