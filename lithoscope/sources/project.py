"""Projects by their manifests: kinds, frameworks, path aliases, workspace packages, and settings.

``manifests(path, text)`` are the files ``package.json``, ``manifest.json`` and ``tsconfig.json`` of any number of projects. A text
that is no JSON counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"tsconfig": "tsconfig.json", "exclude": []}


def _names(text: Column, part: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{part}")), F.array().cast("array<string>"))


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _by_folder(manifests: DataFrame, name: str, alias: str) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return manifests.where(F.col("path").endswith(f"/{name}")).groupBy(folder.alias("root")).agg(F.first(_valid(F.col("text"))).alias(alias))


def projects(manifests: DataFrame) -> DataFrame:
    """``root, name, types, framework, has_typescript, aliases, workspaces``: one row for each folder with a manifest.

    Types come in the order monorepo, react, next, angular, vue, chrome-extension; ``node`` if there is no other. Of several
    frameworks the last counts. ``aliases`` maps a path pattern to its targets.
    """
    each = _by_folder(manifests, "package.json", "pkg").join(_by_folder(manifests, "manifest.json", "ext"), "root", "full").join(_by_folder(manifests, "tsconfig.json", "ts"), "root", "full")
    pkg = F.col("pkg")
    each = each.withColumn("deps", F.concat(_names(pkg, "dependencies"), _names(pkg, "devDependencies")))
    has = lambda *names: F.arrays_overlap("deps", F.array(*map(F.lit, names)))
    angular = F.exists("deps", lambda d: d.startswith("@angular/core"))
    spaces = F.coalesce(F.get_json_object(pkg, "$.workspaces.packages"), F.get_json_object(pkg, "$.workspaces"))
    kinds = F.array_compact(F.array(
        F.when(spaces.isNotNull(), "monorepo"), F.when(has("react", "react-dom"), "react"), F.when(has("next"), "next"), F.when(angular, "angular"),
        F.when(has("vue"), "vue"), F.when(F.get_json_object("ext", "$.manifest_version").isNotNull(), "chrome-extension"),
    ))
    framework = F.when(has("vue"), "vue").when(angular, "angular").when(has("next"), "next").when(has("react", "react-dom"), "react")
    return each.select(
        "root", F.get_json_object(pkg, "$.name").alias("name"), F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("node"))).alias("types"), framework.alias("framework"),
        (F.col("ts").isNotNull() | has("typescript", "@types/node")).alias("has_typescript"),
        F.from_json(F.get_json_object("ts", "$.compilerOptions.paths"), "map<string,array<string>>").alias("aliases"),
        F.coalesce(F.from_json(spaces, "array<string>"), F.array().cast("array<string>")).alias("workspaces"),
    )


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """``root, path, name, dependencies`` of the folders right below a workspace pattern's base that have a ``package.json``;
    without a name the folder's name counts."""
    base = F.regexp_replace("pattern", r"/?\*$", "")
    wanted = projects(manifests).select("root", F.explode("workspaces").alias("pattern")).select("root", F.when(base == "", F.col("root")).otherwise(F.concat_ws("/", "root", base)).alias("parent"))
    own = _by_folder(manifests, "package.json", "pkg").where(F.col("pkg").isNotNull()).select(
        F.col("root").alias("path"), F.regexp_extract("root", r"^(.*)/[^/]*$", 1).alias("parent"), "pkg")
    return wanted.distinct().join(own, "parent").select(
        "root", "path", F.coalesce(F.get_json_object("pkg", "$.name"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"), _names(F.col("pkg"), "dependencies").alias("dependencies"))


def alias_folders(project) -> dict[str, str]:
    """One project's aliases as ``modules.dependency_edges`` takes them: prefixes up to a star, with the first target's folder."""
    out = {}
    for pattern, targets in (project["aliases"] or {}).items():
        if targets:
            out[pattern.rstrip("*")] = "/".join([project["root"], *[p for p in targets[0].rstrip("*").split("/") if p not in ("", ".")]])
    return out


def merged_settings(overrides: dict) -> dict:
    """The defaults, each replaced by an override that is given."""
    return {**DEFAULTS, **overrides}
