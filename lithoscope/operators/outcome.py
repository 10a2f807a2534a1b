"""What becomes of a planned change set: errors, previews, writing, and the undo log.

Changes are staged as a table, whose write is complete or absent, before files are replaced; a file is replaced by a rename
where the file system has one. The log holds reversed sets by a growing number; what was undone is recorded, not deleted.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.operators import changes

LOG = "op_id bigint, description string, path string, original string, modified string"


def outcome(plans: DataFrame, json: bool = False, dry_run: bool = False) -> DataFrame:
    """``op_id, status, n_files`` of ``plans(op_id, path, original, modified, error)``: an error stands over all, a set without
    changes is ``unchanged``; ``json`` and ``dry_run`` write nothing."""
    changed = F.count_if(~F.col("original").eqNullSafe(F.col("modified")) & F.col("error").isNull())
    each = plans.groupBy("op_id").agg(F.count("error").alias("errors"), changed.alias("n_files"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("n_files") == 0, "unchanged").when(F.lit(json), "json").when(F.lit(dry_run), "preview").otherwise("apply")
    return each.select("op_id", status.alias("status"), F.when(status == "failed", 0).otherwise(F.col("n_files")).cast("long").alias("n_files"))


def applicable(plans: DataFrame) -> DataFrame:
    """The changes of the sets that are to be applied."""
    wanted = outcome(plans).where("status = 'apply'").select("op_id")
    return changes.change_set(plans.join(wanted, "op_id", "left_semi").drop("error"))


def apply_changes(staged: DataFrame, root: str = "") -> None:
    """Replace each file by its ``modified`` text, under ``root``, in tasks. The folder must be one that executors share."""

    def write(rows):
        for r in rows:
            path = f"{root}{r['path']}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.new", "w", encoding="utf-8", newline="") as f:
                f.write(r["modified"])
            os.replace(f"{path}.new", path)

    staged.select("path", "modified").foreachPartition(write)


def append_undo(log_path: str, applied: DataFrame, op_id: int, description: str) -> None:
    """Append the reverse of a change set to the log."""
    back = changes.reversed_set(applied).select(F.lit(op_id).cast("long").alias("op_id"), F.lit(description).alias("description"), "path", "original", "modified")
    back.write.mode("append").parquet(f"{log_path}/log")


def undo_log(spark: SparkSession, log_path: str) -> tuple[DataFrame, DataFrame]:
    """The log and the numbers that were undone; both empty at first."""
    out = []
    for name, schema in (("log", LOG), ("undone", "op_id bigint")):
        try:
            out.append(spark.read.schema(schema).parquet(f"{log_path}/{name}"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out.append(spark.createDataFrame([], schema))
    return out[0], out[1]


def undo(spark: SparkSession, log_path: str, root: str = "") -> int | None:
    """Apply the latest set that was not undone, and record it; its number, or None if there is none."""
    log, undone = undo_log(spark, log_path)
    last = changes.next_undo(log, undone)
    row = last.agg(F.max("op_id").alias("op_id")).first()
    if row["op_id"] is None:
        return None
    apply_changes(last, root)
    spark.createDataFrame([(row["op_id"],)], "op_id bigint").write.mode("append").parquet(f"{log_path}/undone")
    return row["op_id"]
