"""Source trees and JSON manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of source files and folders that are left out.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
EXCLUDED = r"/(node_modules|dist|dist_[^/]*|\.[^/]+)/"


def discover(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """``path, text, mtime_ms`` of the source files below ``root``, one row a file; hidden and built ones are left out."""
    glob = "*{" + ",".join(extensions) + "}"
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    below = F.regexp_replace(path, r"^\Q" + root.rstrip("/") + r"\E", "")
    return raw.select(path.alias("path"), F.col("value").alias("text"), (F.unix_millis("_metadata.file_modification_time")).cast("double").alias("mtime_ms"), below.alias("below")).where(
        ~F.col("below").rlike(EXCLUDED) & ~F.col("below").rlike(r"/\.[^/]*$")
    ).drop("below")


def project_kind(manifests: DataFrame) -> DataFrame:
    """``path, name, kind`` of ``manifests(path, text)`` (package manifests); unreadable JSON gives the kind ``node``.

    Of several frameworks the last of react, next, angular and vue counts.
    """
    deps = lambda part: F.from_json(F.get_json_object("text", f"$.{part}"), "map<string,string>")
    names = F.concat(F.coalesce(F.map_keys(deps("dependencies")), F.array()), F.coalesce(F.map_keys(deps("devDependencies")), F.array()))
    has = lambda n: F.array_contains("names", n)
    kind = F.when(has("vue"), "vue").when(has("@angular/core"), "angular").when(has("next"), "next").when(has("react"), "react").otherwise("node")
    return manifests.withColumn("names", names).select("path", F.get_json_object("text", "$.name").alias("name"), kind.alias("kind"))
