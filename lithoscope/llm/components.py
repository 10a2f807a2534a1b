"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a vertex with very many links (a hub) meets pre-aggregation and a join that
adaptive execution can split; nothing is collected. Each round ends in the shared checkpoint folder. Vertices may be of any
type with an order, structs too, so that a component can bear the name that the caller wants it to have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``u, root`` for each vertex of ``links(u, v)`` that isn't the smallest of its component; ``root`` is.

    Links may repeat, point either way or join a vertex to itself; an empty table gives no rows. Rounds go on until
    nothing changes, which takes about as many as the logarithm of the longest path.
    """
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == before:
            return edges.select("u", F.col("v").alias("root"))
        before = (state["n"], state["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())


def named_by_least(things: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """``key, component, component_id`` for ``things(key, least)`` (the key of its smallest vertex, and its least id), whose ``links(u, v)`` are pairs of keys.

    A vertex is known by its least id and its key, nulls last, so a component's smallest vertex bears its least id, and no
    join over whole components is needed to find it. A null id names a component only if there is no other.
    """
    vertex = F.struct(F.col("least").isNull().alias("unnamed"), F.col("least"), F.col(key).alias("key"))
    known = things.select(F.col(key).alias("k"), vertex.alias("x"))
    edges = links.join(known.select(F.col("k").alias("u"), F.col("x").alias("a")), "u").join(known.select(F.col("k").alias("v"), F.col("x").alias("b")), "v")
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return things.join(roots.select(F.col("u.key").alias(key), "root"), key, "left").select(
        key, F.coalesce(F.col("root.key"), F.col(key)).alias("component"),
        F.when(F.col("root").isNotNull(), F.col("root.least")).otherwise(F.col("least")).alias("component_id"),
    )
