"""The library's queries over the driver's tables, by name, each with the SQL that gives the same rows.

These tables hold no source code: the queries apply the operators to documents, pages, events and orders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoscope.functions.text import layer_of, normalised_space
from lithoscope.operators import changes, graph, incremental, lookup, outcome, patterns, quality, similarity, stats, symbols, trees, views
from lithoscope.plans import project
from lithoscope.sources import project as project_manifests

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: MB of files for one task of a grouped pass, so that a task's memory stays as it is when tables grow.
TASK_MB = 4


def tasks_by_size(rows: DataFrame) -> int:
    """Tasks for a grouped pass over the files that ``rows`` are read from, at least as many as the session has for a shuffle."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >> 60 else max(least, math.ceil(size / (TASK_MB * 2**20)))  # a size that isn't known is a huge one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""SELECT md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body_md5, count(*) AS n, min(doc_id) AS first_id
           FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicates(spark, sf_dir):
    """Groups of documents whose texts are equal but for white space."""
    return quality.duplicate_groups(table(spark, sf_dir, "documents"), normalised_space(F.col("text")), "doc_id")


@query(r"""WITH d AS (SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body_md5 FROM documents WHERE text IS NOT NULL)
           SELECT doc_id, body_md5 FROM d WHERE body_md5 IN (SELECT body_md5 FROM d GROUP BY 1 HAVING count(*) > 1)""")
def duplicate_members(spark, sf_dir):
    """Every document of such a group."""
    return quality.duplicate_members(table(spark, sf_dir, "documents"), normalised_space(F.col("text"))).select("doc_id", "body_md5")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_brand = 'Brand#23'")
def find_exact(spark, sf_dir):
    return lookup.find(table(spark, sf_dir, "part"), "Brand#23", "p_brand").select("p_partkey", "p_name", "p_type")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer
          WHERE c_mktsegment = 'BUILDING' AND (c_acctbal > 0) = true AND contains(c_name, '1')""")
def list_filter(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") > 0).alias("exported"), F.col("c_name").alias("file_path")
    )
    return lookup.list_units(units, "BUILDING", True, "1").select("id", "name")


def _orders_as_units(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity"))).alias("lines"))
    return lines.select("l_orderkey", F.transform("lines", lambda x: F.struct(x["l_linenumber"].cast("string").alias("name"), x["l_returnflag"].alias("type"))).alias("params"))


@query("""SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1
          HAVING string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_quantity) = 'N,N'""")
def search_signature(spark, sf_dir):
    """Orders whose ordered list of line flags is exactly N, N."""
    return lookup.search_signature(_orders_as_units(spark, sf_dir), ["N", "N"], 2).select("l_orderkey", F.size("params").cast("long").alias("n_lines"))


@query("""SELECT DISTINCT conv_id FROM conversations c WHERE turn = 0
          AND EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')""")
def search_pattern_semi(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    light = turns.where("turn = 0").select(F.col("conv_id").cast("string").alias("name"), F.lit("conversations").alias("file_path"), F.lit("function").alias("kind"), "conv_id")
    deep = turns.select(F.col("conv_id").cast("string").alias("name"), F.lit("conversations").alias("file_path"), F.array(F.struct(F.col("role").alias("name"))).alias("members"))
    return lookup.search_pattern(light, deep, kind="function", has_member="system").select("conv_id").distinct()


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def stats_by_kind(spark, sf_dir):
    return stats.by_kind(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT (SELECT count(*) FROM labels) AS units, (SELECT count(*) FROM labels WHERE quality = 1) AS exported,
                 (SELECT count(DISTINCT doc_id) FROM documents) AS files""")
def index_stats(spark, sf_dir):
    units = table(spark, sf_dir, "labels").withColumn("exported", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return stats.index_stats(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")), units)


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS name FROM benchmark)
           SELECT name, count(*) AS n_rows FROM w WHERE name <> '' GROUP BY 1""")
def inverted_index(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return stats.frequencies(table(spark, sf_dir, "benchmark").withColumn("names", words), "names", "item_id")


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS name FROM benchmark)
           SELECT name, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS files FROM w WHERE name <> '' GROUP BY 1""")
def name_to_files(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    found = stats.inverted(table(spark, sf_dir, "benchmark").withColumn("names", words), "names", "item_id")
    return found.select("name", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))


@query(r"""
WITH tokens AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM benchmark),
placed AS (SELECT item_id, generate_subscripts(w, 1) AS place, unnest(w) AS t FROM tokens),
led AS (SELECT *, lead(t, 1) OVER (PARTITION BY item_id ORDER BY place) AS t2, lead(t, 2) OVER (PARTITION BY item_id ORDER BY place) AS t3 FROM placed),
grams AS (
  SELECT item_id, t AS g FROM led UNION ALL SELECT item_id, t || ':' || t2 FROM led WHERE t2 IS NOT NULL
  UNION ALL SELECT item_id, t || ':' || t2 || ':' || t3 FROM led WHERE t3 IS NOT NULL),
gn AS (SELECT item_id, g, count(*) AS n FROM grams GROUP BY ALL),
bn AS (SELECT item_id, t AS g, count(*) AS n FROM placed GROUP BY ALL),
gs AS (SELECT a.item_id, sum(least(a.n, coalesce(b.n, 0))) AS both, sum(a.n) AS own FROM gn a LEFT JOIN gn b ON a.g = b.g AND b.item_id = 0 GROUP BY 1),
bs AS (SELECT a.item_id, sum(least(a.n, coalesce(b.n, 0))) AS both, sum(a.n) AS own FROM bn a LEFT JOIN bn b ON a.g = b.g AND b.item_id = 0 GROUP BY 1),
tg AS (SELECT coalesce(sum(n), 0) AS n FROM gn WHERE item_id = 0), tb AS (SELECT coalesce(sum(n), 0) AS n FROM bn WHERE item_id = 0),
scored AS (
  SELECT d.item_id AS unit,
         CASE WHEN coalesce(gs.own, 0) + tg.n = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(gs.both, 0)::DOUBLE / (coalesce(gs.own, 0) + tg.n)::DOUBLE END AS structural,
         CASE WHEN coalesce(bs.own, 0) + tb.n = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(bs.both, 0)::DOUBLE / (coalesce(bs.own, 0) + tb.n)::DOUBLE END AS token
  FROM benchmark d LEFT JOIN gs USING (item_id) LEFT JOIN bs USING (item_id), tg, tb WHERE d.item_id <> 0)
SELECT unit, structural, token, 0.6::DOUBLE * structural + 0.4::DOUBLE * token AS score FROM scored
WHERE 0.6::DOUBLE * structural + 0.4::DOUBLE * token >= 0.05::DOUBLE ORDER BY score DESC, unit LIMIT 20""")
def similar_topk(spark, sf_dir):
    """The passages most like passage 0."""
    units = table(spark, sf_dir, "benchmark").withColumns({"words": F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""), "kind": F.lit("passage")})
    return similarity.similar(units, F.col("item_id") == 0, "item_id", "kind", F.col("words"), F.col("words"), least=0.05)


@query(r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages)
           SELECT page_id, dst, starts_with(dst, '/') AS internal, count(*) AS n FROM e GROUP BY ALL""")
def graph_edges(spark, sf_dir):
    """Links of pages."""
    edges = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("dst"))
    return edges.groupBy("page_id", "dst").agg(F.first(F.col("dst").startswith("/")).alias("internal"), F.count("*").alias("n"))


def _supply(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("""SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources
          FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) GROUP BY 1""")
def reverse_edges(spark, sf_dir):
    return graph.reverse(_supply(spark, sf_dir)).select("dst", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("SELECT doc_id AS node FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def entry_points(spark, sf_dir):
    """Documents that no label points to."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"))
    return graph.entry_points(nodes, table(spark, sf_dir, "labels").select(F.lit(None).cast("long").alias("src"), F.col("doc_id").alias("dst")))


@query("SELECT o_orderkey AS node FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def leaves(spark, sf_dir):
    """Orders with no returned line."""
    edges = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.leaves(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")), edges)


@query("""SELECT count(DISTINCT l_suppkey) AS modules, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS internal_edges,
                 count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS external_sources FROM lineitem""")
def dep_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return stats.graph_stats(lines.select(F.col("l_suppkey").alias("src"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("dst"), F.col("l_shipdate").alias("source")))


@query("""WITH c AS (SELECT s_suppkey, unnest([s_suppkey * 7, s_suppkey * 3, s_suppkey + 1]) AS candidate, unnest([0, 1, 2]) AS place FROM supplier),
          hit AS (SELECT s_suppkey, arg_min(candidate, place) AS resolved FROM c WHERE candidate IN (SELECT p_partkey FROM part) GROUP BY 1)
          SELECT s_suppkey, resolved FROM supplier LEFT JOIN hit USING (s_suppkey)""")
def resolve_first_match(spark, sf_dir):
    """For each supplier the first of its ranked candidates that is a part."""
    s = F.col("s_suppkey")
    found = graph.resolve_first(table(spark, sf_dir, "supplier"), F.array(s * 7, s * 3, s + 1), ["s_suppkey"], table(spark, sf_dir, "part"), "p_partkey")
    return found.select("s_suppkey", "resolved")


@query("""WITH e AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
          SELECT src, dst, count(*) AS n FROM e WHERE dst IS NOT NULL GROUP BY ALL""")
def call_edges(spark, sf_dir):
    return graph.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name, min(c_custkey) AS c_custkey FROM customer GROUP BY 1""")
def first_definition(spark, sf_dir):
    return graph.first_definitions(table(spark, sf_dir, "customer").select("c_nationkey", "c_name", "c_custkey"), "c_nationkey", ["c_custkey"])


def _chains(spark, sf_dir):
    """A sparse directed graph: an order's first line leads from its supplier to the supplier whose key its part has."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_partkey <> l_suppkey")
    return lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey),
          seen(node) AS (SELECT 1::BIGINT UNION SELECT dst FROM edges JOIN seen ON src = node)
          SELECT node FROM seen""")
def reachability(spark, sf_dir):
    return graph.reachable(_chains(spark, sf_dir), spark.createDataFrame([(1,)], "node long")).select("node")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey),
          seen(node) AS (SELECT 5::BIGINT UNION SELECT src FROM edges JOIN seen ON dst = node)
          SELECT CAST(node AS VARCHAR) AS file FROM seen WHERE node = 5 OR node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def blast_radius(spark, sf_dir):
    """What a rename touches: suppliers in credit refer to the symbol; those that reach node 5 count."""
    edges = _chains(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    uses = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.lit("s").alias("symbol"), F.col("s_suppkey").cast("string").alias("file"))
    return graph.blast_radius("rename", "5", edges, references=uses, symbol="s")


@query(r"""WITH p AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS layer, split_part(split_part(split_part(url, '://', 2), '/', 2), '?', 1) AS other FROM pages)
           SELECT layer, string_agg(DISTINCT other, ',' ORDER BY other) AS depends_on, count(DISTINCT other) AS n_depends_on FROM p GROUP BY 1""")
def layers(spark, sf_dir):
    """Hosts and the first parts of their paths."""
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    edges = table(spark, sf_dir, "pages").select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("src"), F.split_part(F.split_part(rest, F.lit("/"), F.lit(2)), F.lit("?"), F.lit(1)).alias("dst"))
    return graph.layers(edges, lambda c: c).select("layer", F.array_join("depends_on", ",").alias("depends_on"), F.col("n_depends_on").cast("long").alias("n_depends_on"))


@query("""SELECT count(DISTINCT l.doc_id) AS covered, count(DISTINCT d.doc_id) AS files,
                 CAST(floor(100.0::DOUBLE * count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id) + 0.5) AS BIGINT) AS percent
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def coverage_percent(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t).select(F.col("doc_id").alias("file_path")) for t in ("documents", "labels"))
    return patterns.coverage(labels, docs)


@query("""WITH r AS (
            SELECT 'credit' AS rule, c_custkey AS id, least(0.5::DOUBLE + CASE WHEN c_acctbal > 5000 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.2::DOUBLE ELSE 0 END, 0.95::DOUBLE) AS confidence
            FROM customer WHERE c_acctbal > 0
            UNION ALL SELECT 'large-order', o_orderkey, least(0.4::DOUBLE + CASE WHEN o_totalprice > 200000 THEN 0.3::DOUBLE ELSE 0 END, 0.95::DOUBLE) FROM orders WHERE o_totalprice > 100000)
          SELECT rule, id, confidence FROM r WHERE confidence >= 0.5""")
def rule_confidence(spark, sf_dir):
    """Additive, capped confidences of two rules, as one union."""
    add = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    credit = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        F.lit("credit").alias("rule"), F.col("c_custkey").alias("id"), F.least(F.lit(0.5) + add(F.col("c_acctbal") > 5000, 0.3) + add(F.col("c_mktsegment") == "BUILDING", 0.2), F.lit(0.95)).alias("confidence"))
    large = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(
        F.lit("large-order").alias("rule"), F.col("o_orderkey").alias("id"), F.least(F.lit(0.4) + add(F.col("o_totalprice") > 200000, 0.3), F.lit(0.95)).alias("confidence"))
    return credit.unionByName(large).where("confidence >= 0.5")


@query("SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL HAVING count(*) >= 2")
def strategy_having(spark, sf_dir):
    """Nations as interfaces, which their suppliers implement."""
    none = F.lit(None).cast("string")
    unit = lambda df, name, kind, line, own: df.select(none.alias("file_path"), name.cast("string").alias("name"), F.lit(kind).alias("kind"), line.cast("int").alias("line"), own.alias("implements"))
    nations = table(spark, sf_dir, "nation")
    units = unit(nations, F.col("n_nationkey"), "interface", F.col("n_nationkey"), F.array().cast("array<string>")).unionByName(
        unit(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), "class", F.lit(0), F.array(F.col("s_nationkey").cast("string"))))
    found = patterns.strategy(units).select(F.col("line").alias("n_nationkey"))
    counted = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return nations.join(found, "n_nationkey").join(counted, "n_nationkey").select("n_nationkey", "n_name", "n")


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'made' ELSE 'kept' END AS state, n_chars FROM documents""")
def incremental_diff(spark, sf_dir):
    """A snapshot in which a third of the documents had another time: those are made anew, others are kept."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime_ms"))
    snapshot = docs.select(F.col("doc_id").alias("path"), F.when(F.col("n_chars") % 3 == 0, -1).otherwise(F.col("n_chars")).alias("mtime_ms"), F.lit("kept").alias("state"))
    out = incremental.refreshed(found, snapshot, lambda rows: rows.withColumn("state", F.lit("made")))
    return out.select(F.col("path").alias("doc_id"), "state", F.col("mtime_ms").alias("n_chars"))


def _edits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return changes.change_set(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("original"), F.regexp_replace("text", r"\bthe\b", "<the>").alias("modified")))


@query(r"""SELECT doc_id AS path, md5(text) AS before_md5, md5(regexp_replace(text, '\bthe\b', '<the>', 'g')) AS after_md5 FROM documents
           WHERE text <> regexp_replace(text, '\bthe\b', '<the>', 'g')""")
def change_set(spark, sf_dir):
    return _edits(spark, sf_dir).select("path", F.md5(F.col("original").cast("binary")).alias("before_md5"), F.md5(F.col("modified").cast("binary")).alias("after_md5"))


@query(r"""SELECT doc_id AS path, md5(text) AS restored_md5 FROM documents WHERE text <> regexp_replace(text, '\bthe\b', '<the>', 'g')""")
def undo(spark, sf_dir):
    """The reversed set gives the original texts."""
    back = changes.reversed_set(_edits(spark, sf_dir))
    return back.select("path", F.md5(F.col("modified").cast("binary")).alias("restored_md5"))


@query("""SELECT o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
          WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                            WHERE l.l_orderkey = o.o_orderkey AND s.s_nationkey <> c.c_nationkey)""")
def dead_code_anti(spark, sf_dir):
    """Orders with no line from another nation: an anti join with an inequality."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    exports = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("name"), F.col("c_nationkey").alias("file_path"))
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    references = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]).select(F.col("l_orderkey").alias("name"), F.col("s_nationkey").alias("file_path"))
    return quality.dead_exports(exports, references).select(F.col("name").alias("o_orderkey"))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place
          FROM customer QUALIFY place <= 5""")
def top_per_group(spark, sf_dir):
    """The five best of each group."""
    return views.top(table(spark, sf_dir, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", "place")


@query("""SELECT DISTINCT CASE WHEN split_part(path, '/', 1) = 'src' AND len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS layer,
                 count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'src/' || lang || '/' || source ELSE source || '/' || lang END AS path FROM documents) GROUP BY 1""")
def layer_names(spark, sf_dir):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("/", F.lit("src"), "lang", "source")).otherwise(F.concat_ws("/", "source", "lang"))
    return table(spark, sf_dir, "documents").where("lang is not null and source is not null").groupBy(layer_of(path).alias("layer")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS tree, md5(o_orderstatus || ':' || string_agg(md5(l_returnflag), ':' ORDER BY md5(l_returnflag))) AS hash
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def subtree_hashes(spark, sf_dir):
    """Orders as trees over their lines, whose order doesn't count."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    used = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    roots = used.select(F.col("o_orderkey").alias("tree"), F.lit(0).alias("id"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("place"), F.col("o_orderstatus").alias("type"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice"))
    own = lines.select(F.col("l_orderkey").alias("tree"), place.alias("id"), F.lit(0).alias("parent"), place.alias("place"), F.col("l_returnflag").alias("type"))
    found = trees.subtree_hashes(roots.unionByName(own), ["O", "F", "P"])
    return found.where("id = 0").select("tree", "hash")


@query("""SELECT o_orderkey AS tree, l_linenumber AS id, CAST(row_number() OVER w AS BIGINT) AS visit, CAST(row_number() OVER w - 1 AS BIGINT) AS post_visit
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice)""")
def tree_walk(spark, sf_dir):
    """Places of an order's lines in a walk that takes the order first, and in one that takes it last."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    n = tasks_by_size(lines)
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").repartition(n, "l_orderkey").join(orders.repartition(n, "l_orderkey"), "l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice"))
    own = lines.select(F.col("l_orderkey").alias("tree"), F.col("l_linenumber").alias("id"), F.lit(0).alias("parent"), (place - 1).alias("place"))
    return trees.children_first(own).select("tree", "id", "visit", "post_visit")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R'),
               more AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R')
          SELECT src, dst FROM e WHERE src NOT IN (SELECT src FROM more) UNION SELECT src, dst FROM more""")
def graph_insert(spark, sf_dir):
    """A graph of suppliers and parts, with new entries for the suppliers of returned lines."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lambda test: lines.where(test).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return symbols.add_entry(edges("l_returnflag <> 'R'").distinct(), edges("l_returnflag = 'R'"))


@query("""SELECT DISTINCT 'importer' AS role, l_suppkey AS node FROM lineitem WHERE l_partkey = 7
          UNION ALL SELECT DISTINCT 'import', l_partkey FROM lineitem WHERE l_suppkey = 3""")
def graph_lookups(spark, sf_dir):
    edges = _supply(spark, sf_dir)
    return symbols.importers_of(edges, 7).select(F.lit("importer").alias("role"), "node").unionByName(symbols.imports_of(edges, 3).select(F.lit("import").alias("role"), "node"))


@query("""SELECT o_orderkey AS op_id,
                 CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'failed' WHEN count(*) FILTER (l_linestatus = 'O') = 0 THEN 'unchanged' ELSE 'apply' END AS status,
                 CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 0 ELSE count(*) FILTER (l_linestatus = 'O') END AS n_files
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def plan_outcomes(spark, sf_dir):
    """Orders as planned change sets: a returned line is an error, an open one a change."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    plans = lines.select(F.col("l_orderkey").alias("op_id"), F.col("l_linenumber").cast("string").alias("path"), F.lit("F").alias("original"), F.col("l_linestatus").alias("modified"), F.when(F.col("l_returnflag") == "R", "returned").alias("error"))
    return outcome.outcome(plans)


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, sf_dir):
    return views.by_category(table(spark, sf_dir, "documents").select(F.col("lang").alias("category")))


@query("""WITH f AS (SELECT doc_id, coalesce(source, '') AS source FROM documents), p AS (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL)
          SELECT split_part(source, '/', 1) AS layer, count(DISTINCT f.doc_id) AS n_files, coalesce(string_agg(DISTINCT CAST(quality AS VARCHAR), ',' ORDER BY CAST(quality AS VARCHAR)), '') AS patterns
          FROM f LEFT JOIN p USING (doc_id) GROUP BY 1""")
def layer_patterns(spark, sf_dir):
    """Sources as layers, with the labels that occur in each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part(F.coalesce("source", F.lit("")), F.lit("/"), F.lit(1)).alias("layer"))
    placed = docs.select(F.concat_ws("/", "layer", F.col("doc_id").cast("string")).alias("file_path"), "doc_id")
    marks = placed.join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id").select("file_path", F.col("quality").cast("string").alias("pattern"))
    return views.layer_patterns(placed, marks).select("layer", "n_files", F.array_join("patterns", ",").alias("patterns"))


def _manifests(spark, sf_dir) -> DataFrame:
    """Three manifests for each nation: a package, one of its workspaces, and compiler settings."""
    key, name = F.col("n_nationkey"), F.lower("n_name")
    root = F.concat(F.lit("/w/"), key.cast("string"))
    framework = F.element_at(F.array(*map(F.lit, ["vue", "next", "react", "express"])), (key % 4 + 1).cast("int"))
    package = F.to_json(F.struct(name.alias("name"), F.create_map(framework, F.lit("1")).alias("dependencies"), F.array(F.lit("packages/*")).alias("workspaces")))
    inner = F.to_json(F.struct(F.create_map(F.lit("zod"), F.lit("3")).alias("dependencies")))
    settings = F.when(key % 2 == 0, F.lit('{"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}')).otherwise("// no JSON")
    files = F.array(*[F.struct(F.concat(root, F.lit(p)).alias("path"), t.alias("text")) for p, t in (("/package.json", package), ("/packages/core/package.json", inner), ("/tsconfig.json", settings))])
    return table(spark, sf_dir, "nation").select(F.explode(files).alias("f")).select("f.*")


@query("""SELECT '/w/' || n_nationkey AS root, lower(n_name) AS name, 'monorepo' || CASE n_nationkey % 4 WHEN 0 THEN ',vue' WHEN 1 THEN ',next' WHEN 2 THEN ',react' ELSE '' END AS types,
                 CASE n_nationkey % 4 WHEN 0 THEN 'vue' WHEN 1 THEN 'next' WHEN 2 THEN 'react' END AS framework, n_nationkey % 2 = 0 AS has_typescript,
                 CASE WHEN n_nationkey % 2 = 0 THEN '@/*' ELSE '' END AS aliases, 'packages/*' AS workspaces FROM nation
          UNION ALL SELECT '/w/' || n_nationkey || '/packages/core', NULL, 'node', NULL, false, '', '' FROM nation""")
def project_kinds(spark, sf_dir):
    found = project_manifests.projects(_manifests(spark, sf_dir))
    keys = F.coalesce(F.array_join(F.map_keys("aliases"), ","), F.lit("")).alias("aliases")
    return found.select("root", "name", F.array_join("types", ",").alias("types"), "framework", "has_typescript", keys, F.array_join("workspaces", ",").alias("workspaces"))


@query("""SELECT '/w/' || n_nationkey AS root, '/w/' || n_nationkey || '/packages/core' AS path, 'core' AS name, 'zod' AS dependencies FROM nation""")
def workspace_packages(spark, sf_dir):
    return project_manifests.workspace_packages(_manifests(spark, sf_dir)).select("root", "path", "name", F.array_join("dependencies", ",").alias("dependencies"))


QUERIES |= project.QUERIES
ORACLE_SQL |= project.oracle_sql()
