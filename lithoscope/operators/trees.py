"""Hashes of subtrees of trees in a table, bottom-up and level by level: equal subtrees have equal hashes.

``nodes(tree, id, parent, place, type)`` holds a tree's nodes, ``parent`` null at the root. A leaf's hash is that of its type,
an inner node's that of its type and its children's hashes, joined by colons, in the order of ``place``; or sorted, for types
that are commutative. Each level is one grouped pass; children of one node are gathered, as a node's source text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def combined(kind, hashes):
    """The hash of a type and its children's hashes."""
    return F.md5(F.concat_ws(":", kind, F.array_join(hashes, ":")).cast("binary"))


def subtree_hashes(nodes: DataFrame, commutative: list[str] = (), most_levels: int = 64) -> DataFrame:
    """``tree, id, hash`` of all nodes of trees of at most ``most_levels`` levels; deeper ones raise an error."""
    depth = nodes.where(F.col("parent").isNull()).select("tree", "id", F.lit(0).alias("depth"))
    levels = [depth]
    while len(levels) <= most_levels:
        below = nodes.join(levels[-1].select("tree", F.col("id").alias("parent")), ["tree", "parent"]).select("tree", "id", F.lit(len(levels)).alias("depth"))
        if below.isEmpty():
            break
        levels.append(below)
    else:
        raise ValueError(f"a tree has more than {most_levels} levels")
    done = None
    for level in reversed(levels):
        own = nodes.join(level.select("tree", "id"), ["tree", "id"])
        if done is None:
            hashed = own.select("tree", "id", "parent", "place", "type", F.md5(F.col("type").cast("binary")).alias("hash"))
        else:
            children = done.groupBy("tree", F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("c"))
            hashes = F.transform("c", lambda c: c["hash"])
            ordered = F.when(F.col("type").isin(list(commutative)), F.sort_array(hashes)).otherwise(hashes)
            hashed = own.join(children, ["tree", "id"], "left").select(
                "tree", "id", "parent", "place", "type",
                F.when(F.col("c").isNull(), F.md5(F.col("type").cast("binary"))).otherwise(combined(F.col("type"), ordered)).alias("hash"))
        out = hashed.select("tree", "id", "hash") if done is None else out.unionByName(hashed.select("tree", "id", "hash"))
        done = hashed
    return out


def children_first(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``visit`` and ``post_visit``: the places of a flat tree's nodes (a root and its children) in a walk that
    visits a node before, or after, its children. Rows of no tree drop out. Nodes that are sorted by tree are not sorted again."""
    inner = F.col("parent").isNotNull()
    n = F.count(F.when(inner, 1)).over(Window.partitionBy("tree"))
    return nodes.where(F.col("tree").isNotNull()).withColumns({
        "visit": F.when(inner, F.col("place") + 1).otherwise(0).cast("long"), "post_visit": F.when(inner, F.col("place")).otherwise(n).cast("long")})
