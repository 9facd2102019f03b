"""Project-context queries (A5-A9, A14, P40, P41) over the project-tree listing."""

from __future__ import annotations

from codegauge.operators import project as PR
from codegauge.plans import shared_sql as S
from codegauge.plans.oracle_fixtures import register, with_views
from codegauge.plans.registry import query
from codegauge.sources import fixtures as FX

register("listing", f"""SELECT project_id, {S.LISTING_PATH} AS path, {S.LISTING_CONTENT} AS content
  FROM (SELECT p_partkey, p_size, p_partkey % 20 AS project_id, {S.LISTING_KIND} AS kind,
          p_partkey = min(p_partkey) OVER (PARTITION BY p_partkey % 20, {S.LISTING_KIND}) AS first_of_kind
        FROM part) t""", [])

_ROOT = "strpos(path, '/') = 0"
_CTX = f"""SELECT f.project_id,
    CASE WHEN pk.deps IS NOT NULL THEN
           CASE WHEN list_contains(pk.deps, 'next') THEN 'next' WHEN list_contains(pk.deps, 'react') THEN 'react'
                WHEN list_contains(pk.deps, '@vue/core') OR list_contains(pk.deps, 'vue') THEN 'vue'
                WHEN list_contains(pk.deps, '@angular/core') THEN 'angular'
                WHEN list_contains(pk.deps, 'express') THEN 'express' ELSE 'node' END
         WHEN f.has_req OR f.has_pyproject THEN 'python' WHEN f.has_pom THEN 'spring' WHEN f.has_gomod THEN 'go'
         ELSE 'unknown' END AS framework,
    CASE WHEN list_contains(f.dirs, 'packages') OR list_contains(f.dirs, 'apps') THEN 'monorepo'
         WHEN list_contains(f.dirs, 'src') AND (list_contains(f.dirs, 'components') OR list_contains(f.dirs, 'views')) THEN 'spa'
         WHEN list_contains(f.dirs, 'controllers') AND list_contains(f.dirs, 'models') AND list_contains(f.dirs, 'views') THEN 'mvc'
         WHEN list_contains(f.dirs, 'services') AND list_contains(f.dirs, 'repositories') THEN 'layered'
         ELSE 'unknown' END AS architecture,
    CASE WHEN f.has_webpack THEN 'webpack' WHEN f.has_vite THEN 'vite' WHEN f.has_pom THEN 'maven'
         WHEN f.has_gradle THEN 'gradle' WHEN f.has_make THEN 'make' ELSE 'unknown' END AS build_system,
    CASE WHEN f.has_yarn THEN 'yarn' WHEN f.has_npm THEN 'npm' WHEN f.has_pnpm THEN 'pnpm' WHEN f.has_req THEN 'pip'
         WHEN f.has_pipfile THEN 'pipenv' ELSE 'unknown' END AS package_manager,
    coalesce(pk.version, f.py_version, '0.0.0') AS version,
    coalesce(ml.main_language, 'unknown') AS main_language
  FROM (SELECT project_id,
          bool_or({_ROOT} AND path = 'requirements.txt') AS has_req, bool_or({_ROOT} AND path = 'pyproject.toml') AS has_pyproject,
          bool_or({_ROOT} AND path = 'pom.xml') AS has_pom, bool_or({_ROOT} AND path = 'go.mod') AS has_gomod,
          bool_or({_ROOT} AND path = 'webpack.config.js') AS has_webpack,
          bool_or({_ROOT} AND path IN ('vite.config.js', 'vite.config.ts')) AS has_vite,
          bool_or({_ROOT} AND path = 'build.gradle') AS has_gradle, bool_or({_ROOT} AND path = 'Makefile') AS has_make,
          bool_or({_ROOT} AND path = 'yarn.lock') AS has_yarn, bool_or({_ROOT} AND path = 'package-lock.json') AS has_npm,
          bool_or({_ROOT} AND path = 'pnpm-lock.yaml') AS has_pnpm, bool_or({_ROOT} AND path = 'Pipfile') AS has_pipfile,
          max(CASE WHEN {_ROOT} AND path = 'pyproject.toml' THEN nullif(regexp_extract(content, 'version\\s*=\\s*["'']([^"'']+)["'']', 1), '') END) AS py_version,
          list_distinct(list(CASE WHEN strpos(path, '/') > 0 THEN lower(split_part(path, '/', 1)) END)) AS dirs
        FROM listing GROUP BY project_id) f
  LEFT JOIN (SELECT project_id,
               list_distinct(list_concat(coalesce(json_keys(content, '$.dependencies'), []),
                                         coalesce(json_keys(content, '$.devDependencies'), []))) AS deps,
               coalesce(json_extract_string(content, '$.version'), '0.0.0') AS version
             FROM listing WHERE {_ROOT} AND path = 'package.json' AND json_valid(content)
               AND json_type(content) = 'OBJECT') pk USING (project_id)
  LEFT JOIN (SELECT project_id, language AS main_language FROM (
               SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, language) AS r FROM (
                 SELECT project_id, CASE regexp_extract(path, '[^/]([.][^./]*)$', 1)
                          WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
                          WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java'
                          WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'cpp'
                          WHEN '.h' THEN 'c' WHEN '.hpp' THEN 'cpp' END AS language, count(*) AS n
                 FROM listing GROUP BY 1, 2 HAVING language IS NOT NULL) a) b WHERE r = 1) ml USING (project_id)"""


@query("project_context", with_views(_CTX, ["listing"]))
def project_context(spark, sf):
    return PR.project_context(FX.listing(spark, sf)).select(
        "project_id", "framework", "architecture", "build_system", "package_manager", "version", "main_language")
