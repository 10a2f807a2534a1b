"""Operator 10, exact top-k search: norm-sorted inner products with SVD-rotated partial sums and Cauchy-Schwarz bounds.

All vectors are range-partitioned by descending length and packed into blocks of ``BLOCK`` rows; a rotation onto the principal
axes (from the second moments of all rows, a d x d sum) gathers most of each length in the first coordinates, so that after
a few coordinates the rest of an inner product is bounded by the product of the residual lengths. Queries are packed into
blocks of like length too. First each query block meets the block of the longest vectors, which gives every query a floor for
its k-th score. Then a pair of a query block and a row block is looked at only if the row block's length can reach the lowest
ratio of floor to length of the queries; within the pair, partial sums and residual bounds leave few pairs of vectors, and
these are scored exactly in integers. Each task works on one pair of blocks, keeps at most k rows for each query, and the k
best of these are ranked by a bounded merge. No pruning is approximate: a margin above the rounding error of the partial sums
is added. Plans don't grow with the data: what comes to the driver is one length for each of at most ``GROUPS`` partitions.

Edge cases: vectors that are null or hold null or non-finite components take no part; empty ones do, and shorter vectors
count as padded with zeros; repeated ids are rows of their own, and a query's own id is excluded in all its rows; the rows of
a repeated query id share one list, of the best scores of any of them; ties go to the smaller id; fewer than k candidates
give all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoscope.llm.common import checkpoint, read, received, sent

#: Rows in a block, queries in a block, and most range partitions of blocks.
BLOCK, QUERY_BLOCK, GROUPS = 4_096, 4_096, 10_000
FOUND = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``vec_id, v array<long>`` with v = floor(scale * x) in double, for the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(whole)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))
    )


def _matrix(vectors, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Principal axes (columns, by falling weight) of the second moments of all rows, from a d x d sum of partials."""

    def partial(batches):
        total = np.zeros((d, d))
        for b in batches:
            m = _matrix(b["v"], d).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(d), "row": list(total)})

    rows = vectors.mapInPandas(partial, "i int, row array<double>").groupBy("i").agg(
        F.array(*[F.sum(F.col("row")[j]) for j in range(d)]).alias("row")
    ).collect()
    gram = np.zeros((d, d))
    for r in rows:
        gram[r["i"]] = r["row"]
    return np.linalg.svd((gram + gram.T) / 2)[0]


def _search(q_ids, q, c_ids, c, floors, turn, k: int, head: int, step: int = 512):
    """The k best candidates of each query in one pair of blocks, as lists of query, id and score; ``step`` queries at a time."""
    cr = c @ turn
    c_rest, c_len = np.sqrt((cr[:, head:] ** 2).sum(1)), np.sqrt((cr**2).sum(1))
    out = ([], [], [])
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        qr = part @ turn
        q_rest, q_len = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((qr**2).sum(1))
        bound = qr[:, :head] @ cr[:, :head].T
        bound += np.outer(q_rest, c_rest)
        bound += 1e-9 * np.outer(q_len, c_len) + 1e-6  # more than the rounding error
        qi, ci = np.nonzero(bound >= floors[lo : lo + step, None])
        if not len(qi):
            continue
        starts = np.searchsorted(qi, np.arange(len(part) + 1))
        for i in np.flatnonzero(np.diff(starts)).tolist():
            own = ci[starts[i] : starts[i + 1]]
            own = own[c_ids[own] != q_ids[lo + i]]
            if not len(own):
                continue
            score = c[own] @ part[i]
            if len(own) > k:
                edge = np.partition(score, len(own) - k)[len(own) - k]
                near = score >= edge
                own, score = own[near], score[near]
            first = np.lexsort((c_ids[own], -score))[:k]
            out[0].extend([q_ids[lo + i]] * len(first))
            out[1].extend(c_ids[own[first]].tolist())
            out[2].extend(score[first].tolist())
    return out


def packed(vectors: DataFrame, d: int, rows: int, groups: int) -> DataFrame:
    """``grp, block, len, ids, matrix``: blocks of at most ``rows`` vectors by descending length, as bytes; ``len`` is the
    largest in the block. Equal lengths are dealt by id, so that no length fills a partition."""

    def pack(batches):
        part, n = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def block(f):
            nonlocal n
            n += 1
            ids, matrix = f["vec_id"].to_numpy(np.int64), _matrix(f["v"], d)
            return pd.DataFrame({"grp": [part], "block": [part << 32 | n], "len": [float(f["len"].max())], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]})

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= rows:
                whole = pd.concat(held, ignore_index=True)
                cut = len(whole) - len(whole) % rows
                for lo in range(0, cut, rows):
                    yield block(whole.iloc[lo : lo + rows])
                held = [whole.iloc[cut:]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    order = (F.desc("len"), F.xxhash64("vec_id", "v"))
    dealt = vectors.select("vec_id", "v", "len").repartitionByRange(groups, *order).sortWithinPartitions(*order)
    return checkpoint(dealt.mapInPandas(pack, "grp int, block long, len double, ids binary, matrix binary"))


def top_k(vectors: DataFrame, is_query, k: int = 5, head: int = 16, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    vectors = checkpoint(vectors.withColumn("len", length))
    queries = vectors.where(is_query).dropDuplicates(["vec_id", "v"])
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.count_if(is_query).alias("q")).first()
    if not size["n"] or not size["q"]:
        return spark.createDataFrame([], schema)
    d = max(1, size["d"])
    head = min(head, d)
    turn = rotation(vectors, d)
    groups = lambda n, rows: max(1, min(GROUPS, -(-n // rows)))
    c_side = packed(vectors, d, block, groups(size["n"], 4 * block))
    q_side = packed(queries, d, query_block, groups(size["q"], 4 * query_block))

    def vectors_of(ids, matrix):
        return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(-1, d)

    def search(q_ids, q, c_ids, c, floors):
        found = _search(q_ids, q, c_ids, c, floors, turn, k, head)
        return pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]}).astype("int64")

    # The block of the longest vectors meets every query block: a table of one row, of bounded size.
    longest = c_side.orderBy(F.desc("len"), "block").limit(1).select(F.col("block").alias("longest"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c"))
    seeded = q_side.withColumn("one", F.lit(1)).join(F.broadcast(longest.withColumn("one", F.lit(1))), "one").drop("one")

    def meet_longest(batches):
        for b in batches:
            for r in b.itertuples():
                (q_ids, q), (c_ids, c) = vectors_of(r.ids, r.matrix), vectors_of(r.c_ids, r.c)
                f = search(q_ids, q, c_ids, c, np.full(len(q), -np.inf))
                low = pd.Series(f["score"].to_numpy(), f["query_id"].to_numpy()).groupby(level=0).agg(["min", "size"])
                low = {i: s for i, s, n in low.itertuples() if n >= k}
                floors = np.array([low.get(i, -np.inf) for i in q_ids.tolist()], np.float64)
                lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                # The length that a row must have for some query of the block: floor over length; any, if a floor is open.
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(lengths > 0, floors / lengths, np.where(floors > 0, np.inf, -np.inf))
                yield pd.DataFrame({"block": [r.block], "longest": [r.longest], "least": [float(least.min())], "floors": [floors.tobytes()], "query_ids": [f["query_id"].tolist()], "vec_ids": [f["vec_id"].tolist()], "scores": [f["score"].tolist()]})

    first = checkpoint(seeded.select("block", "ids", "matrix", "longest", "c_ids", "c").mapInPandas(
        meet_longest, "block long, longest long, least double, floors binary, query_ids array<long>, vec_ids array<long>, scores array<long>"
    ))
    reach = sorted((r["grp"], r["len"]) for r in c_side.groupBy("grp").agg(F.max("len").alias("len")).collect())
    held = sent(vectors, (np.array([g for g, _ in reach]), np.array([n for _, n in reach])))

    def reached(batches):
        grp, longest_of = received(held)
        for b in batches:
            for q_block, least in zip(b["block"], b["least"]):
                own = grp[longest_of * (1 + 1e-9) + 1e-6 >= least]
                yield pd.DataFrame({"q_block": q_block, "grp": own, "least": least})

    near = first.select("block", "least").mapInPandas(reached, "q_block long, grp int, least double").join(c_side.select("grp", F.col("block").alias("c_block"), "len"), "grp")
    near = near.where(F.col("len") * (1 + 1e-9) + 1e-6 >= F.col("least")).select("q_block", "c_block")
    asked = q_side.join(first.select("block", "longest", "floors"), "block").select(F.col("block").alias("q_block"), "longest", "floors", "ids", "matrix")
    pairs = near.join(asked, "q_block").where(F.col("c_block") != F.col("longest"))
    pairs = pairs.join(c_side.select(F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c")), "c_block")

    def meet(batches):
        for b in batches:
            for r in b.itertuples():
                yield search(*vectors_of(r.ids, r.matrix), *vectors_of(r.c_ids, r.c), np.frombuffer(r.floors, np.float64))

    rest = pairs.select("floors", "ids", "matrix", "c_ids", "c").mapInPandas(meet, FOUND)
    seeds = first.select(F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("f")).select(
        F.col("f.query_ids").alias("query_id"), F.col("f.vec_ids").alias("vec_id"), F.col("f.scores").alias("score")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = seeds.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each row of ``embeddings`` whose id is divisible by 50, among all other rows."""
    vectors = quantised(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(50)) == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
