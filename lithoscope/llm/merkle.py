"""Operator 9, document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

A text's paragraphs are its lines; a section is ``FAN`` consecutive paragraphs. The leaves are spans (sentences, cut after
60 characters, which cover every character): a leaf's digest is the MD5 of its text and two digits for its length. A
paragraph's digest is the MD5 of its leaves', a section's the MD5 of its paragraphs', and the root, which is the fingerprint,
the SHA-256 of the sections'. So roots test equality, and from two trees the first differing section, and in it the first
differing paragraph, locate an edit without a look at the texts. The likeness of two trees is the share of characters in
leaves that both have, ``2 |A and B| / (|A| + |B|)`` over distinct leaf digests.

``with_next`` gives each row the next one in the order of ids without a single-task window: ids are cut at quantiles, a
row at a cut goes to the bucket before it too, and a window runs in each bucket.

Edge cases: a null text is an empty one, which has one empty paragraph; two texts without leaves have likeness 1, one of
them 0; null ids come first, rows of one id are ordered by text; of one row alone the next is itself; an empty table gives
no rows; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoscope.llm.common import read

#: Paragraphs of a section; a span by pattern (at most 64 characters, so that two digits hold its length).
FAN = 8
SPAN = r"[^.!?\n]{1,60}[.!?\n]{0,4}|[.!?\n]{1,60}"
#: Rows of a bucket, and most buckets (their cuts come to the driver).
BUCKET_ROWS, MOST_BUCKETS = 1_000, 100_000


def leaves(text: Column) -> Column:
    """Digests of the leaves, by paragraph."""
    spans = lambda p: F.regexp_extract_all(p, F.lit(SPAN), F.lit(0))
    return F.transform(F.split(text, "\n", -1), lambda p: F.transform(spans(p), lambda s: F.concat(F.md5(s.cast("binary")), F.lpad(F.length(s).cast("string"), 2, "0"))))


def paragraphs(leaf_digests: Column) -> Column:
    """Digests of the paragraphs over their leaves' digests."""
    return F.transform(leaf_digests, lambda own: F.md5(F.array_join(own, "").cast("binary")))


def sections(digests: Column) -> Column:
    """Digests of the sections over the paragraphs' digests."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FAN).cast("int")),
        lambda i: F.md5(F.array_join(F.slice(digests, i * FAN + 1, FAN), "").cast("binary")),
    )


def root(section_digests: Column) -> Column:
    return F.sha2(F.array_join(section_digests, "").cast("binary"), 256)


def distinct_leaves(leaf_digests: Column) -> Column:
    return F.array_distinct(F.flatten(leaf_digests))


def weight(own: Column) -> Column:
    """Characters of the leaves."""
    return F.aggregate(own, F.lit(0).cast("long"), lambda n, s: n + F.substring(s, 33, 2).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct leaf digests: 0 to 1."""
    both = weight(a) + weight(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * weight(F.array_intersect(a, b)).cast("double") / both.cast("double"))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first differing element of two arrays, null if there is none."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at > 0, at - 1)


def _bucket(value: Column, cuts: list, fan: int = 100) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: in two steps of about a root of their number each."""
    if not cuts:
        return F.lit(0)
    coarse = F.size(F.filter(F.lit(cuts[::fan]), lambda c: c <= value))
    fine = F.size(F.filter(F.slice(F.lit(cuts), F.greatest(F.lit(1), (coarse - 1) * fan + 1), F.lit(fan)), lambda c: c <= value))
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * fan + fine)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, leaves, distinct, next_text, next_distinct``: each row and the next by (id, text); after the last comes the first."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select(id_col)
    size = ids.agg(F.count("*").alias("n"), F.min(id_col).alias("least"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
    buckets = min(MOST_BUCKETS, -(-size["n"] // BUCKET_ROWS))
    cuts = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = ids.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * buckets)).alias("q")).first()["q"] or []
        # Cuts are ids of rows, so each bucket but the first begins with its cut.
        cuts = sorted({c for c in found if c is not None and (size["nulls"] or c > size["least"])})
    own = _bucket(F.col(id_col), cuts)
    at_cut = F.array_contains(F.slice(F.lit(cuts), F.greatest(own, F.lit(1)), F.lit(1)), F.col(id_col)) & (own > 0) if cuts else F.lit(False)
    is_first = F.col(id_col).isNull() if size["nulls"] else F.col(id_col) == F.lit(size["least"])
    place = F.concat(
        F.array(F.struct(own.alias("bucket"), F.lit(False).alias("extra"))),
        F.when(F.coalesce(at_cut, F.lit(False)), F.array(F.struct((own - 1).alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array()),
        F.when(is_first, F.array(F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array()),
    )
    dealt = rows.select(id_col, "text", F.explode(place).alias("p")).select(id_col, "text", "p.bucket", "p.extra").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("extra", id_col, "text")
    known = dealt.withColumn("leaves", leaves(F.col("text"))).withColumn("distinct", distinct_leaves(F.col("leaves")))
    following = known.select(
        id_col, "text", "leaves", "distinct", "extra", F.lead("text").over(order).alias("next_text"), F.lead("distinct").over(order).alias("next_distinct")
    )
    return following.where(~F.col("extra")).drop("extra")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, and the digests of its tree: ``sections`` and ``paragraphs``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tree = docs.withColumn("paragraphs", paragraphs(leaves(text)))
    tree = tree.withColumn("sections", sections(F.col("paragraphs")))
    return tree.withColumn("fingerprint", root(F.col("sections")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text, and their likeness."""
    rows = with_next(read(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.select(
        "doc_id", "text", "leaves", "distinct", "next_distinct", n.cast("long").alias("n_chars"),
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    trees = edited.withColumn("b_leaves", leaves(F.col("edited")))
    trees = trees.withColumns({"a_paragraphs": paragraphs(F.col("leaves")), "b_paragraphs": paragraphs(F.col("b_leaves"))})
    trees = trees.withColumns({"a_sections": sections(F.col("a_paragraphs")), "b_sections": sections(F.col("b_paragraphs"))})
    return trees.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("a_sections")).alias("fingerprint"), root(F.col("b_sections")).alias("edited_fingerprint"),
        likeness(F.col("distinct"), distinct_leaves(F.col("b_leaves"))).alias("near_edited"), likeness(F.col("distinct"), F.col("next_distinct")).alias("near_next"),
        first_difference(F.col("a_sections"), F.col("b_sections")).cast("long").alias("edit_section"),
        first_difference(F.col("a_paragraphs"), F.col("b_paragraphs")).cast("long").alias("edit_paragraph"),
    )


OP9_SQL = rf"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text
  FROM own),
edited AS (SELECT *, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM paired),
leaves AS (
  SELECT *, list_transform(string_split(text, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{SPAN}'), lambda s: md5(s) || lpad(CAST(length(s) AS VARCHAR), 2, '0'))) AS al,
         list_transform(string_split(edited, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{SPAN}'), lambda s: md5(s) || lpad(CAST(length(s) AS VARCHAR), 2, '0'))) AS bl,
         list_transform(string_split(next_text, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{SPAN}'), lambda s: md5(s) || lpad(CAST(length(s) AS VARCHAR), 2, '0'))) AS nl
  FROM edited),
digests AS (
  SELECT *,
         list_transform(al, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))) AS ap, list_transform(bl, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))) AS bp,
         list_distinct(flatten(al)) AS s, list_distinct(flatten(bl)) AS es, list_distinct(flatten(nl)) AS ns
  FROM leaves),
trees AS (
  SELECT *,
         list_transform(range(0, (len(ap) - 1) // {FAN} + 1), lambda i: md5(list_aggregate(ap[i * {FAN} + 1:i * {FAN} + {FAN}], 'string_agg', ''))) AS a_s,
         list_transform(range(0, (len(bp) - 1) // {FAN} + 1), lambda i: md5(list_aggregate(bp[i * {FAN} + 1:i * {FAN} + {FAN}], 'string_agg', ''))) AS b_s,
         coalesce(list_sum(list_transform(s, lambda x: CAST(x[33:34] AS BIGINT))), 0) AS sw, coalesce(list_sum(list_transform(es, lambda x: CAST(x[33:34] AS BIGINT))), 0) AS ew,
         coalesce(list_sum(list_transform(ns, lambda x: CAST(x[33:34] AS BIGINT))), 0) AS nw,
         coalesce(list_sum(list_transform(list_intersect(s, es), lambda x: CAST(x[33:34] AS BIGINT))), 0) AS both_e,
         coalesce(list_sum(list_transform(list_intersect(s, ns), lambda x: CAST(x[33:34] AS BIGINT))), 0) AS both_n
  FROM digests)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
       sha256(list_aggregate(a_s, 'string_agg', '')) AS fingerprint, sha256(list_aggregate(b_s, 'string_agg', '')) AS edited_fingerprint,
       CASE WHEN sw + ew = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * both_e::DOUBLE / (sw + ew)::DOUBLE END AS near_edited,
       CASE WHEN sw + nw = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * both_n::DOUBLE / (sw + nw)::DOUBLE END AS near_next,
       CAST(list_min(list_filter(range(0, greatest(len(a_s), len(b_s))), lambda i: a_s[i + 1] IS DISTINCT FROM b_s[i + 1])) AS BIGINT) AS edit_section,
       CAST(list_min(list_filter(range(0, greatest(len(ap), len(bp))), lambda i: ap[i + 1] IS DISTINCT FROM bp[i + 1])) AS BIGINT) AS edit_paragraph
FROM trees
"""
