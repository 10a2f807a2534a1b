"""Import and call graphs as edge tables: resolution, reverse edges, ends, reachability, blast radius, layers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_first(wanted: DataFrame, candidates: Column, key: list[str], files: DataFrame, path: str = "path") -> DataFrame:
    """``wanted`` with ``resolved``: the first of the array ``candidates`` that is a path of ``files``, else null."""
    tried = wanted.select(*key, F.posexplode(candidates).alias("place", "candidate"))
    hit = tried.join(files.select(F.col(path).alias("candidate")).distinct(), "candidate")
    first = hit.groupBy(*key).agg(F.min_by("candidate", "place").alias("resolved"))
    return wanted.join(first, key, "left")


def module_candidates(directory: Column, source: Column, extensions: list[str]) -> Column:
    """Paths that a relative import may mean, in order: as written, with each extension, as a folder's index file."""
    base = F.concat_ws("/", directory, F.regexp_replace(source, r"^\./", ""))
    stem = F.regexp_replace(base, r"\.[cm]?jsx?$", "")
    return F.concat(
        F.array(base), F.array(*[F.concat(base, F.lit(e)) for e in extensions]), F.array(*[F.concat(stem, F.lit(e)) for e in extensions]),
        F.array(*[F.concat(base, F.lit(f"/index{e}")) for e in extensions]),
    )


def reverse(edges: DataFrame) -> DataFrame:
    """``dst, sources``: distinct sources of each target, sorted."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("sources"))


def entry_points(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias(node)).distinct(), node, "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that no edge leads from."""
    return nodes.join(edges.select(F.col("src").alias(node)).distinct(), node, "left_anti")


def first_definitions(nodes: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One node for each name: the first in ``order``. A grouped minimum, so a common name costs no window."""
    return nodes.groupBy(name).agg(F.min_by(F.struct(*nodes.columns), F.struct(*order)).alias("n")).select("n.*")


def transitions(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``src, dst, n``: how often one value follows another within a key."""
    following = F.lead(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("dst", following).where(F.col("dst").isNotNull()).groupBy(F.col(value).alias("src"), "dst").agg(F.count("*").alias("n"))


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the session's shared folder; a temporary one will do for a local master only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="lithoscope-"))
    return df.checkpoint()


#: Frontiers that are kept apart before they are written as one table.
FRONTIERS = 8


def reachable(edges: DataFrame, start: DataFrame, most_steps: int | None = None) -> DataFrame:
    """``node, steps`` of all nodes that edges lead to from ``start(node)``, which has 0 steps. Cycles end by themselves.

    A frontier meets the edges, what was seen before goes out by an anti join; each step ends in the shared folder. Only the new
    frontier is written at a step; those before are written again every ``FRONTIERS`` steps.
    """
    edges = edges.select("src", "dst").distinct()
    seen = [_checkpointed(start.select("node").distinct().withColumn("steps", F.lit(0)))]
    step = 0
    while most_steps is None or step < most_steps:
        step += 1
        following = edges.join(seen[-1].where(F.col("steps") == step - 1).select("node"), F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        new = _checkpointed(following.join(_all(seen).select("node"), "node", "left_anti").withColumn("steps", F.lit(step)))
        if new.isEmpty():
            break
        seen.append(new)
        if len(seen) > FRONTIERS:
            seen = [_checkpointed(_all(seen[:-1])), new]
    return _all(seen)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def is_reachable(edges: DataFrame, source: str, target: str) -> bool:
    """Whether ``target`` leads to ``source`` along edges; false for one node."""
    if source == target:
        return False
    start = edges.sparkSession.createDataFrame([(target,)], "node string")
    return not reachable(edges, start).where(F.col("node") == source).isEmpty()


def blast_radius(kind: str, file: str, edges: DataFrame, definitions: DataFrame | None = None, references: DataFrame | None = None, symbol: str | None = None) -> DataFrame:
    """``file``s touched: of a rename the definition and those referring files that reach it; of an extraction the file;
    of a move the file and its direct importers."""
    spark = edges.sparkSession
    own = spark.createDataFrame([(file,)], "file string")
    if kind == "extract":
        return own
    if kind == "move":
        return own.union(edges.where(F.col("dst") == file).select("src")).distinct()
    backwards = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), own.select(F.col("file").alias("node")))
    using = references.where(F.col("symbol") == symbol).select("file").distinct()
    return own.union(using.join(backwards.select(F.col("node").alias("file")), "file", "left_semi")).distinct()


def layers(edges: DataFrame, layer_of_node) -> DataFrame:
    """``layer, depends_on, n_depends_on`` from the layers of the ends of edges, fewest dependencies first."""
    pairs = edges.select(layer_of_node(F.col("src")).alias("layer"), layer_of_node(F.col("dst")).alias("other"))
    found = pairs.groupBy("layer").agg(F.sort_array(F.collect_set(F.when(F.col("layer") != F.col("other"), F.col("other")))).alias("depends_on"))
    return found.withColumn("n_depends_on", F.size("depends_on")).orderBy("n_depends_on", "layer")
