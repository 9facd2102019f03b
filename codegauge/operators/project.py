"""Project context: main language, framework, architecture, build system, package manager, version.

Inputs are file listings (project_id, path, is_dir, content for marker files). Every rule is a
per-project aggregate of boolean flags (``bool_or``) or a small ranked aggregate, so one hash
aggregation per project answers all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.operators.graph import graph_language

P = ["project_id"]


def main_language(listing: DataFrame) -> DataFrame:
    """A5: most frequent graph language over all supported files; ties by language name.

    The per-project window runs over at most one row per language (12), after the aggregate.
    """
    d = (listing.select(*P, graph_language("path").alias("language")).filter(F.col("language").isNotNull())
                .groupBy(*P, "language").agg(F.count(F.lit(1)).cast("long").alias("n_files")))
    w = Window.partitionBy(*P).orderBy(F.col("n_files").desc(), F.col("language"))
    return (d.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
             .select(*P, F.col("language").alias("main_language"), "n_files"))


# Dependency names checked in package.json, in rule order.
_PKG_SCHEMA = "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>, version STRING"


def package_json_fields(content) -> dict:
    """Dependency names (dependencies ∪ devDependencies), version (default 0.0.0), validity.

    Valid means the text parses as a JSON object; anything else is ignored like a parse failure.
    """
    j = F.from_json(content, _PKG_SCHEMA)
    valid = F.json_object_keys(content).isNotNull()
    deps = F.array_union(F.coalesce(F.map_keys(j["dependencies"]), F.array().cast("array<string>")),
                         F.coalesce(F.map_keys(j["devDependencies"]), F.array().cast("array<string>")))
    return {"valid": valid, "deps": deps, "version": F.coalesce(j["version"], F.lit("0.0.0"))}


def pyproject_version(content) -> Column:
    """First ``version = "…"`` (or single quotes) in the text; null when absent."""
    v = F.regexp_extract(content, r"""version\s*=\s*["']([^"']+)["']""", 1)
    return F.when(v != "", v)


def project_context(listing: DataFrame) -> DataFrame:
    """A6-A9 + A14: framework, main language, architecture, build system, package manager, version.

    ``listing`` has project_id, path (relative to the project root) and content for marker files.
    One aggregate per project gathers the root-marker flags, the parsed package.json and the
    flags of the top-level directories asked for; the rules are then plain column expressions.
    """
    path, content = F.col("path"), F.col("content")
    pkg = package_json_fields(content)
    is_root = ~path.contains("/")
    top = F.when(path.contains("/"), F.lower(F.substring_index(path, "/", 1)))

    def has(name):
        return F.bool_or(is_root & (path == name)).alias("has_" + name.replace(".", "_").replace("-", "_"))

    names = ["package.json", "requirements.txt", "pyproject.toml", "pom.xml", "go.mod", "webpack.config.js",
             "vite.config.js", "vite.config.ts", "build.gradle", "Makefile", "yarn.lock", "package-lock.json",
             "pnpm-lock.yaml", "Pipfile"]
    folders = ["packages", "apps", "src", "components", "views", "controllers", "models", "services", "repositories"]
    root_pkg = is_root & (path == "package.json")
    agg = listing.groupBy(*P).agg(
        *[has(n) for n in names],
        F.max(F.when(root_pkg & pkg["valid"], F.struct(pkg["deps"].alias("deps"), pkg["version"].alias("v"))))
         .alias("pkg"),
        F.max(F.when(is_root & (path == "pyproject.toml"), pyproject_version(content))).alias("py_version"),
        *[F.coalesce(F.bool_or(top == n), F.lit(False)).alias("dir_" + n) for n in folders],
    )
    c = F.col
    deps = c("pkg.deps")
    dep = lambda n: F.coalesce(F.array_contains(deps, n), F.lit(False))
    framework = (F.when(c("pkg").isNotNull(),
                        F.when(dep("next"), "next").when(dep("react"), "react")
                         .when(dep("@vue/core") | dep("vue"), "vue").when(dep("@angular/core"), "angular")
                         .when(dep("express"), "express").otherwise("node"))
                  .when(c("has_requirements_txt") | c("has_pyproject_toml"), "python")
                  .when(c("has_pom_xml"), "spring").when(c("has_go_mod"), "go").otherwise("unknown"))
    d = lambda n: c("dir_" + n)
    arch = (F.when(d("packages") | d("apps"), "monorepo").when(d("src") & (d("components") | d("views")), "spa")
             .when(d("controllers") & d("models") & d("views"), "mvc")
             .when(d("services") & d("repositories"), "layered").otherwise("unknown"))
    build = (F.when(c("has_webpack_config_js"), "webpack")
              .when(c("has_vite_config_js") | c("has_vite_config_ts"), "vite")
              .when(c("has_pom_xml"), "maven").when(c("has_build_gradle"), "gradle")
              .when(c("has_Makefile"), "make").otherwise("unknown"))
    pm = (F.when(c("has_yarn_lock"), "yarn").when(c("has_package_lock_json"), "npm")
           .when(c("has_pnpm_lock_yaml"), "pnpm").when(c("has_requirements_txt"), "pip")
           .when(c("has_Pipfile"), "pipenv").otherwise("unknown"))
    version = F.coalesce(c("pkg.v"), c("py_version"), F.lit("0.0.0"))
    ctx = agg.select(*P, framework.alias("framework"), arch.alias("architecture"), build.alias("build_system"),
                     pm.alias("package_manager"), version.alias("version"))
    ml = main_language(listing.select(*P, "path"))
    return (ctx.join(ml.select(*P, "main_language"), P, "left")
               .withColumn("main_language", F.coalesce("main_language", F.lit("unknown"))))
