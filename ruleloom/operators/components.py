"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.lineage import release, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has an edge.

    Every node first joins its smallest neighbour, which settles stars and cliques at once; what is left, the edges
    between different such labels, is small and goes through large-star and small-star steps (Kiveris et al. 2014)
    until it consists of stars. Each step is a shuffle of at most as many edges, a hub is aggregated and never
    collected, and every round is written to the shared folder. Null ends and self-loops are ignored; an empty edge
    list gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = settle(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    label = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc")
    ends = e.join(label.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(label.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    rest = settle(ends.where("lu <> lv").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct(), "cc")
    if rest.isEmpty():
        return label.select("node", F.col("label").alias("component"))
    stars = _stars(rest).select(F.col("node").alias("label"), "component")
    return label.join(stars, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def _stars(e: DataFrame) -> DataFrame:
    """Components of distinct edges (u > v) by alternating large-star and small-star steps."""
    last = None
    while True:
        # large star: larger neighbours of u point to the smallest of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, e = e, settle(small.where("u <> v").distinct(), "cc")
        release(before)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
        last = state
