"""One unit against all others: multiset Dice of n-gram shingles blended with the overlap of token bags.

Shingles of a sequence are, at each place, its 1-, 2- and 3-gram. They are never gathered: both multisets live as
``(unit, gram, n)`` rows that are counted before the join, and only the target's (one unit) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of structure and tokens, and the least score of a result.
STRUCTURE, TOKENS, LEAST_SCORE, LIMIT = 0.6, 0.4, 0.3, 20


def shingles(units: DataFrame, unit: str, tokens: Column) -> DataFrame:
    """``unit, gram, n``: counts of the 1-, 2- and 3-grams of the array ``tokens``."""
    placed = units.select(F.col(unit).alias("unit"), F.posexplode(tokens).alias("place", "t"))
    order = Window.partitionBy("unit").orderBy("place")
    second, third = F.lead("t", 1).over(order), F.lead("t", 2).over(order)
    grams = placed.withColumns({"t2": second, "t3": third}).select(
        "unit", F.explode(F.array(F.col("t"), F.when(F.col("t2").isNotNull(), F.concat_ws(":", "t", "t2")), F.when(F.col("t3").isNotNull(), F.concat_ws(":", "t", "t2", "t3")))).alias("gram")
    )
    return grams.where(F.col("gram").isNotNull()).groupBy("unit", "gram").agg(F.count("*").alias("n"))


def bags(units: DataFrame, unit: str, tokens: Column) -> DataFrame:
    """``unit, gram, n``: the bag of the array ``tokens``."""
    return units.select(F.col(unit).alias("unit"), F.explode(tokens).alias("gram")).groupBy("unit", "gram").agg(F.count("*").alias("n"))


def dice(both: Column, a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|); 1 if both are empty, 0 if one is."""
    a, b, both = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)), F.coalesce(both, F.lit(0))
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.lit(2.0) * both.cast("double") / (a + b).cast("double"))


def overlap(grams: DataFrame, target: DataFrame) -> DataFrame:
    """``unit, n_both, n_own``: multiset intersection with ``target(gram, n)`` (one unit, hence broadcast) and size."""
    t = F.broadcast(target.select(F.col("gram").alias("t_gram"), F.col("n").alias("t_n")))
    return grams.join(t, F.col("gram") == F.col("t_gram"), "left").groupBy("unit").agg(
        F.sum(F.least("n", F.coalesce("t_n", F.lit(0)))).alias("n_both"), F.sum("n").alias("n_own")
    )


def similar(units: DataFrame, target: Column, unit: str, kind: str, sequence: Column, tokens: Column, least: float = LEAST_SCORE, limit: int | None = LIMIT) -> DataFrame:
    """``unit, structural, token, score`` of units of the target's kind, best first; ties by unit.

    The comparison starts from the candidates and joins intersections by left joins, so units without shingles are kept
    (two empty ones score 1).
    """
    chosen = units.where(target)
    candidates = units.where(~F.coalesce(target, F.lit(False))).join(F.broadcast(chosen.select(F.col(kind).alias("__kind")).limit(1)), F.col(kind) == F.col("__kind"), "left_semi")
    parts = []
    for name, make, column in (("structural", shingles, sequence), ("token", bags, tokens)):
        own = make(chosen, unit, column)
        total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts.append((name, overlap(make(candidates, unit, column), own), total))
    out = candidates.select(F.col(unit).alias("unit"))
    for name, found, total in parts:
        out = out.join(found.withColumnsRenamed({"n_both": f"{name}_both", "n_own": f"{name}_own"}), "unit", "left")
        out = out.withColumn(name, dice(F.col(f"{name}_both"), F.col(f"{name}_own"), F.lit(total)))
    out = out.withColumn("score", F.lit(STRUCTURE) * F.col("structural") + F.lit(TOKENS) * F.col("token")).where(F.col("score") >= least)
    ordered = out.select("unit", "structural", "token", "score").orderBy(F.desc("score"), "unit")
    return ordered.limit(limit) if limit is not None else ordered


def reasons(structural: Column, same_params: Column, any_params: Column, same_return: Column, same_count: Column) -> Column:
    """Array of the reasons that hold, in fixed order."""
    each = [
        F.when(structural > 0.8, F.lit("identical structure")).when(structural > 0.5, F.lit("similar structure")),
        F.when(same_params & any_params, F.lit("same parameter types")),
        F.when(same_return, F.lit("same return type")),
        F.when(same_count, F.lit("same parameter count")),
    ]
    return F.array_compact(F.array(*each))
