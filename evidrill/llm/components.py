"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.functions.unions import all_stars, stars
from evidrill.llm.common import cut, packed

#: Edges that are connected in one task; of more, each partition's are thinned to a forest first and then connected in rounds.
ONE_TASK = 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Up to ONE_TASK edges are connected in one task, which takes one job and sends nothing to the driver. Of more, each
    partition leaves a forest of its edges. Then each round points all larger neighbours of a node to its smallest neighbour
    (large star), then all smaller ones (small star); it ends when no edge changes, after a number of rounds that grows
    with the logarithm of the longest path. Nothing is broadcast: a hub's rows meet only in partial minima and in joins
    that adaptive execution splits. Edges with a null end are ignored, self loops give a node
    its own component, and an empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    selves = e.where("x = y").select(F.col("x").alias("u"), F.col("x").alias("v"))
    e, rows = packed(e.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    schema = ", ".join(f"{c} {kind}" for c, kind in e.dtypes)
    if rows > ONE_TASK:
        e, rows = packed(e.mapInArrow(stars, schema).distinct())
    whole = rows <= ONE_TASK
    if whole and rows:
        e = cut(e.coalesce(1).mapInArrow(all_stars, schema))
    before = None
    while not whole:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, rows = packed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = (rows, e.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0])
        if mark == before:
            break
        before = mark
    # every edge now leads from a node to its component's smallest node
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(selves.select(F.col("u").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
