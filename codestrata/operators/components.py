"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codestrata.session import durable


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the least node of each component, for every node that has an edge.

    Alternating large-star and small-star contraction: logarithmically many rounds, until nothing changes, each one aggregation per node with no
    group collected; lineage is cut after each round. Self loops make a component of their own; null ends are passed over.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = durable(e.select("u").unionByName(e.select(F.col("v").alias("u"))).dropDuplicates())
    cur = durable(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates())
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").dropDuplicates()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).dropDuplicates()
        cur = durable(small)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen is not None and (now.n, now.h) == seen:
            break
        seen = (now.n, now.h)
    return nodes.join(cur.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
