"""The call graph with its nodes: functions, what they call, who calls them, and statistics.

A node is known by file and name; of several functions of one name in a file the last counts. A call counts for the first
function (by path and line) of that name in any file. Callers of one function may be as many as the project has, so they are
rows (``called_by``); a node carries their number only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.text import is_test_file
from lithoscope.operators import graph, modules
from lithoscope.sources import extract


def functions(extracted: DataFrame) -> DataFrame:
    """``file_path, name, line, exported, is_test`` of functions and arrows, one for each file and name."""
    own = extract.units(extracted).where(F.col("kind").isin("function", "arrow"))
    return own.groupBy("file_path", "name").agg(F.max(F.struct("line", "exported")).alias("u")).select(
        "file_path", "name", "u.line", "u.exported", is_test_file(F.col("file_path")).alias("is_test"))


def called_by(extracted: DataFrame) -> DataFrame:
    """``file_path, name, by_file, by_name``: distinct callers of each function."""
    pair = lambda c: (F.regexp_extract(c, r"^(.*):[^:]*$", 1), F.regexp_extract(c, r"([^:]*)$", 1))
    (src_file, src_name), (dst_file, dst_name) = pair("src"), pair("dst")
    return modules.call_edges(extracted).select(dst_file.alias("file_path"), dst_name.alias("name"), src_file.alias("by_file"), src_name.alias("by_name")).distinct()


def nodes(extracted: DataFrame) -> DataFrame:
    """``file_path, name, line, exported, is_test, calls, n_called_by``; ``calls`` are the names called from its body."""
    own = functions(extracted)
    calls = extract.calls(extracted).groupBy("file_path", F.col("caller_name").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "target_name"))), lambda c: c["target_name"]).alias("calls"))
    callers = called_by(extracted).groupBy("file_path", "name").agg(F.count("*").alias("n_called_by"))
    return own.join(calls, ["file_path", "name"], "left").join(callers, ["file_path", "name"], "left").select(
        "file_path", "name", "line", "exported", "is_test", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), F.coalesce("n_called_by", F.lit(0)).alias("n_called_by"))


def call_stats(extracted: DataFrame) -> DataFrame:
    """One row: functions, calls within them (not deduplicated), exported functions, test and source files."""
    own = nodes(extracted).agg(
        F.count("*").alias("functions"), F.coalesce(F.sum(F.size("calls")), F.lit(0)).cast("long").alias("call_edges"), F.count_if("exported").alias("exported"))
    test = is_test_file(F.col("path"))
    files = extracted.agg(F.count_if(test).alias("test_files"), F.count_if(~test).alias("source_files"))
    return own.withColumn("one", F.lit(1)).join(files.withColumn("one", F.lit(1)), "one").drop("one")


def of_function(rows: DataFrame, name: str) -> DataFrame:
    """The nodes of a name; several files may have one."""
    return rows.where(F.col("name") == name)


def first_functions(extracted: DataFrame) -> DataFrame:
    return graph.first_definitions(functions(extracted), "name", ["file_path", "line"])
