"""Knowledge graph as tables: file nodes, entities, import and contains edges, impact, risk.

There is no graph library: nodes and edges are DataFrames keyed by (project_id, path) and the
graph queries are joins and aggregates over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.functions import rules as R
from codegauge.functions.text import py_strip
from codegauge.operators.ordered import global_rank, top_k
from codegauge.session import materialize

P = ["project_id"]


def suffix(path) -> Column:
    """``PurePosixPath(path).suffix`` (last dot of the final component, not a leading dot)."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"[^/]([.][^./]*)$", 1)


def graph_language(path) -> Column:
    """Case-sensitive suffix → language; null when unsupported."""
    m = F.create_map(*[x for k, v in R.GRAPH_LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, suffix(path))


def metric_language(path) -> Column:
    """Lower-cased suffix → language; null when unsupported (``.h``/``.hpp`` are not scorable)."""
    m = F.create_map(*[x for k, v in R.METRIC_LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.lower(suffix(path)))


def file_nodes(files: DataFrame) -> DataFrame:
    """File rows: language, size, non-blank line count (P3), md5 of the decoded text (P10)."""
    n_lines = F.size(F.filter(F.split(F.col("content"), "\n", -1), lambda l: py_strip(l) != ""))
    return files.select(*P, "path", graph_language("path").alias("language"), "size_bytes",
                        n_lines.cast("long").alias("line_count"), F.md5("content").alias("file_hash"))


def last_entities(entities: DataFrame) -> DataFrame:
    """One row per entity key ``path:name``, the last definition in extraction order wins.

    ``max_by`` is a hash aggregate with a map-side partial step, so a name defined very often
    in one file is combined before the shuffle.
    """
    cols = [c for c in entities.columns if c not in (*P, "path", "name")]
    last = entities.groupBy(*P, "path", "name").agg(F.max_by(F.struct(*cols), "seq").alias("e"))
    return (last.select(*P, "path", "name", "e.*")
                .withColumn("entity_key", F.concat_ws(":", "path", "name")))


def _parent(path: Column) -> Column:
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), parent).otherwise(F.lit("."))


def _join_path(d: Column, rest: Column) -> Column:
    """``d / rest`` as segments: empty and "." segments vanish, ".." stays."""
    return F.filter(F.split(F.concat(d, F.lit("/"), rest), "/"), lambda x: (x != "") & (x != "."))


def _fold_parents(parts: Column) -> Column:
    """Each ".." takes the folder before it along; one that has none (or stands after such a one) leaves the
    tree and stays, so it matches nothing."""
    def step(acc, x):
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, x))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def import_stems(imports: DataFrame, normalize: bool = False) -> DataFrame:
    """The relative imports (project_id, path, seq, specifier) with ``stem``: the path they mean without its suffix.

    The specifier's suffix is left out. ``..`` segments are kept as written unless ``normalize=True`` collapses them."""
    spec = F.col("specifier")
    rel = imports.filter(spec.startswith("."))
    rest = (F.when(spec.startswith("./"), F.substring(spec, 3, 1 << 30))
             .when(spec.startswith("../"), spec)
             .otherwise(F.substring(spec, 2, 1 << 30)))
    parts = _join_path(_parent(F.col("path")), rest)
    base = F.array_join(_fold_parents(parts) if normalize else parts, "/")
    stem = F.regexp_replace(base, r"([^/])\.[^./]*$", "$1")
    return rel.select(*P, "path", "seq", "specifier", stem.alias("stem"))


def resolve_imports(imports: DataFrame, listing: DataFrame, normalize: bool = False) -> DataFrame:
    """Relative specifiers → existing paths, trying the 12 suffixes in their fixed order.

    The specifier's suffix is replaced (not appended). ``..`` segments are kept as written, so
    they only match a listing that spells them out, unless ``normalize=True`` collapses them.
    The 12 candidates per import come from exploding a literal array (no join with a table);
    the existence test is an equi join on (project_id, path) with the listing — a hot target
    path is split by AQE's skew-join handling. Returns (project_id, path, seq, specifier, target).
    """
    exts = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext"))
                     for i, e in enumerate(R.GRAPH_LANGUAGES)])
    cand = import_stems(imports, normalize).select(*P, "path", "seq", "specifier", "stem", F.explode(exts).alias("c")).select(
        *P, "path", "seq", "specifier", F.col("c.rank").alias("rank"),
        F.concat("stem", F.col("c.ext")).alias("target"))
    hit = cand.join(listing.select(*P, F.col("path").alias("target")).distinct(), [*P, "target"], "left_semi")
    return (hit.groupBy(*P, "path", "seq", "specifier")
               .agg(F.min_by("target", "rank").alias("target")))


def path_stem(path: Column) -> Column:
    """The path without its last suffix; the whole path where its last part has no dot."""
    stem = F.regexp_extract(path, r"^(.*)[.][^./]*$", 1)
    return F.when(path.rlike(r"[.][^./]*$"), stem).otherwise(path)


def best_targets(listing: DataFrame) -> DataFrame:
    """(project_id, stem, target): of the files that share a stem the one that an import of the stem means (fixed suffix order)."""
    order = F.create_map(*[x for i, e in enumerate(R.GRAPH_LANGUAGES) for x in (F.lit(e), F.lit(i))])
    last = F.try_element_at(order, F.regexp_extract("path", r"([.][^./]*)$", 1))
    d = listing.select(*P, "path", path_stem(F.col("path")).alias("stem"), last.alias("rank")).filter("rank IS NOT NULL")
    return d.groupBy(*P, "stem").agg(F.min_by("path", "rank").alias("target"))


def import_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Keep a resolved target only if it is an analysed file; one edge per (src, dst).

    Returns (project_id, src, dst, relation_type, strength, occurrences).
    """
    ok = resolved.join(files.select(*P, F.col("path").alias("target")), [*P, "target"], "left_semi")
    return (ok.groupBy(*P, F.col("path").alias("src"), F.col("target").alias("dst"))
              .agg(F.count(F.lit(1)).cast("long").alias("occurrences"))
              .withColumn("relation_type", F.lit("imports")).withColumn("strength", F.lit(0.8)))


def contains_edges(entities: DataFrame) -> DataFrame:
    """File → ``path:name`` entity node, strength 1.0 (distinct)."""
    return (entities.select(*P, F.col("path").alias("src"), F.concat_ws(":", "path", "name").alias("dst"))
                    .distinct()
                    .withColumn("occurrences", F.lit(1).cast("long"))
                    .withColumn("relation_type", F.lit("contains")).withColumn("strength", F.lit(1.0)))


def all_edges(imp_edges: DataFrame, cont_edges: DataFrame) -> DataFrame:
    cols = [*P, "src", "dst", "relation_type", "strength", "occurrences"]
    return imp_edges.select(*cols).unionByName(cont_edges.select(*cols))


def dependents(edges: DataFrame) -> DataFrame:
    """(project_id, node, dependent) — every predecessor of every node."""
    return edges.select(*P, F.col("dst").alias("node"), F.col("src").alias("dependent")).distinct()


def dependencies(edges: DataFrame) -> DataFrame:
    """(project_id, node, dependency) — every successor (files and entities)."""
    return edges.select(*P, F.col("src").alias("node"), F.col("dst").alias("dependency")).distinct()


def impact_level(n: Column) -> Column:
    """P35."""
    return F.when(n > 20, "extreme").when(n > 10, "high").when(n > 5, "medium").otherwise("low")


HUB_PAIRS = 1 << 16


def two_hop_counts(e: DataFrame, hub_pairs: int = HUB_PAIRS) -> DataFrame:
    """(project_id, target, indirect_impact): for every node the number of distinct predecessors of its predecessors.

    ``e`` holds distinct edges (project_id, src, dst). A middle node with in- and out-degree i and o makes i x o pairs; up to ``hub_pairs`` the pairs are
    formed and made distinct. A hub above that is joined by sets: its predecessors, numbered densely, are bitmaps of 32,768 nodes each, every
    target of the hub takes these few rows, and the union of a target's bitmaps (with its other pairs) is counted bit by bit.
    """
    direct = e.select(*P, F.col("dst").alias("target"), F.col("src").alias("mid"))
    before = e.select(*P, F.col("dst").alias("mid"), F.col("src").alias("dep"))
    n_in = before.groupBy(*P, "mid").agg(F.count(F.lit(1)).alias("n_in"))
    n_out = direct.groupBy(*P, "mid").agg(F.count(F.lit(1)).alias("n_out"))
    hubs = materialize(n_in.join(n_out, [*P, "mid"]).filter(F.col("n_in") * F.col("n_out") > hub_pairs).select(*P, "mid"), "hubs")
    count = F.count(F.lit(1)).cast("long").alias("indirect_impact")
    if hubs.isEmpty():
        return direct.join(before, [*P, "mid"]).select(*P, "target", "dep").distinct().groupBy(*P, "target").agg(count)
    light = direct.join(hubs, [*P, "mid"], "left_anti").join(before, [*P, "mid"]).select(*P, "target", "dep").distinct()
    numbered = materialize(global_rank(e.select(*P, F.col("src").alias("dep")).distinct(), [*P, "dep"], out="n", start=0), "nodes")
    bits = lambda rows, *keys: rows.join(numbered, [*P, "dep"]).groupBy(*P, *keys, F.bitmap_bucket_number("n").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    of_hubs = direct.join(hubs, [*P, "mid"], "left_semi")
    sets = of_hubs.join(bits(before.join(hubs, [*P, "mid"], "left_semi"), "mid"), [*P, "mid"]).select(*P, "target", "part", "bits")
    fed = of_hubs.select(*P, "target").distinct()
    rest = bits(light.join(fed, [*P, "target"], "left_semi"), "target").select(*P, "target", "part", "bits")
    whole = sets.unionByName(rest).groupBy(*P, "target", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counted = whole.groupBy(*P, "target").agg(F.sum("n").cast("long").alias("indirect_impact"))
    return counted.unionByName(light.join(fed, [*P, "target"], "left_anti").groupBy(*P, "target").agg(count))


def change_impact(files: DataFrame, edges: DataFrame, hub_pairs: int = HUB_PAIRS) -> DataFrame:
    """J8 for every file in one job: direct dependents, the union of their dependents, total.

    ``indirect`` may include direct dependents and the target itself (cycles); the total adds
    the two set sizes, so overlaps count twice. Edges are de-duplicated first; only import edges lead to files, so the
    others are left out. Hubs are joined as sets (:func:`two_hop_counts`).
    """
    e = edges.filter(F.col("relation_type") == "imports").select(*P, "src", "dst").distinct()
    nd = e.groupBy(*P, F.col("dst").alias("target")).agg(F.count(F.lit(1)).cast("long").alias("direct_impact"))
    out = (files.select(*P, F.col("path").alias("target"))
                .join(nd, [*P, "target"], "left").join(two_hop_counts(e, hub_pairs), [*P, "target"], "left")
                .fillna(0, ["direct_impact", "indirect_impact"]))
    total = F.col("direct_impact") + F.col("indirect_impact")
    return out.withColumn("total_impact_files", total).withColumn("risk_level", impact_level(total))


def risk_tenths(size_bytes, line_count, n_entities, n_imports) -> Column:
    """P12 in integer tenths: 3·[size>10000] + 4·[lines>500] + 3·[entities>20] + 2·[imports>15], ≤ 10."""
    t = (F.when(size_bytes > 10000, 3).otherwise(0) + F.when(line_count > 500, 4).otherwise(0)
         + F.when(n_entities > 20, 3).otherwise(0) + F.when(n_imports > 15, 2).otherwise(0))
    return F.least(F.lit(10), t)


def complexity_bucket(tenths: Column) -> Column:
    """<0.3 low, <0.6 medium, <0.8 high, else extreme."""
    return (F.when(tenths < 3, "low").when(tenths < 6, "medium").when(tenths < 8, "high").otherwise("extreme"))


def risk_scores(nodes: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """Risk per file: entity rows and import occurrences counted with duplicates."""
    ne = entities.groupBy(*P, "path").agg(F.count(F.lit(1)).cast("long").alias("n_entities"))
    ni = imports.groupBy(*P, "path").agg(F.count(F.lit(1)).cast("long").alias("n_imports"))
    d = (nodes.join(ne, [*P, "path"], "left").join(ni, [*P, "path"], "left")
              .fillna(0, ["n_entities", "n_imports"]))
    t = risk_tenths(F.col("size_bytes"), F.col("line_count"), F.col("n_entities"), F.col("n_imports"))
    return (d.withColumn("risk_tenths", t.cast("long"))
             .withColumn("risk_score", (F.col("risk_tenths") / 10.0))
             .withColumn("complexity_level", complexity_bucket(F.col("risk_tenths"))))


def complexity_distribution(risk: DataFrame) -> DataFrame:
    """A4: the four-bucket histogram per project (zero-filled by construction)."""
    lvl = F.col("complexity_level")
    return risk.groupBy(*P).agg(*[F.count_if(lvl == b).cast("long").alias(b)
                                  for b in ["low", "medium", "high", "extreme"]])


def project_statistics(risk: DataFrame, entities: DataFrame, edges: DataFrame, imp_edges: DataFrame) -> DataFrame:
    """A3 + A12: files, lines, distinct entities, distinct edges, high-risk files, import occurrences."""
    f = risk.groupBy(*P).agg(F.count(F.lit(1)).cast("long").alias("total_files"),
                             F.sum("line_count").cast("long").alias("total_lines"),
                             F.count_if(F.col("risk_tenths") > 7).cast("long").alias("high_risk_files"))
    e = (entities.select(*P, "path", "name").distinct().groupBy(*P)
                 .agg(F.count(F.lit(1)).cast("long").alias("total_entities")))
    g = edges.select(*P, "src", "dst").distinct().groupBy(*P).agg(
        F.count(F.lit(1)).cast("long").alias("dependency_relationships"))
    o = imp_edges.groupBy(*P).agg(F.sum("occurrences").cast("long").alias("import_occurrences"))
    out = f.join(e, P, "left").join(g, P, "left").join(o, P, "left")
    return out.fillna(0, ["total_entities", "dependency_relationships", "import_occurrences"])


def most_complex_files(risk: DataFrame, k: int = 10) -> DataFrame:
    """K1: top ``k`` files by risk (desc), path asc as the pinned tie-break, per project."""
    d = risk.withColumn("__neg", F.lit(10) - F.col("risk_tenths"))
    top = top_k(d, P, ["__neg", "path"], k)
    return top.select(*P, F.col("rank").cast("long"), "path", "risk_score", "line_count")


def high_risk_files(risk: DataFrame, k: int = 10) -> DataFrame:
    """files with risk > 0.7, first ``k`` by path per project."""
    d = risk.filter(F.col("risk_tenths") > 7)
    top = top_k(d, P, ["path"], k)
    return top.select(*P, F.col("rank").cast("long"), "path", "risk_score")


def search_entities(entities: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """case-sensitive substring match on the name over distinct entity keys, with the total."""
    hit = entities.filter(F.col("name").contains(query))
    tot = hit.groupBy(*P).agg(F.count(F.lit(1)).cast("long").alias("total_found"))
    return (hit if limit is None else top_k(hit, P, ["path", "name"], limit)).join(tot, P)


def file_context(risk: DataFrame, entities: DataFrame, edges: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """The context of every file. One row ``kind = 'file'`` with its language, size, risk and its entity, dependency, dependent and import counts
    (and ``last_modified``, if ``risk`` has it); with ``imports``, below it a row for each entity (every definition, with type, line, signature
    and docstring), dependency, dependent (with the relation) and import specifier (with its number ``n``).

    The lists are rows and not arrays of the file row, so a file with very many entities or dependents never becomes one huge row.
    """
    ne = entities.select(*P, "path", "name").distinct().groupBy(*P, "path").agg(
        F.count(F.lit(1)).cast("long").alias("n_entities_distinct"))
    ns = edges.groupBy(*P, F.col("src").alias("path")).agg(F.count(F.lit(1)).cast("long").alias("n_dependencies"))
    nd = edges.groupBy(*P, F.col("dst").alias("path")).agg(F.count(F.lit(1)).cast("long").alias("n_dependents"))
    more = [c for c in ["last_modified"] if c in risk.columns]
    d = (risk.select(*P, "path", "size_bytes", "line_count", "n_imports", "risk_score", *more)
             .join(ne, [*P, "path"], "left").join(ns, [*P, "path"], "left").join(nd, [*P, "path"], "left")
             .fillna(0, ["n_entities_distinct", "n_dependencies", "n_dependents"]))
    about = d.select(*P, "path", graph_language("path").alias("language"), "size_bytes", "line_count",
                     F.col("n_entities_distinct").alias("n_entities"), "n_dependencies", "n_dependents", "n_imports", "risk_score", *more)
    if imports is None:
        return about
    mine = risk.select(*P, "path")
    of = lambda rows: rows.join(mine, [*P, "path"], "left_semi")
    way = lambda a, b: of(edges.select(*P, F.col(a).alias("path"), F.col(b).alias("item"), F.col("relation_type").alias("item_type")))
    ents = of(entities.select(*P, "path", F.col("name").alias("item"), F.col("entity_type").alias("item_type"), "line_number", "signature", "docstring"))
    imps = of(imports.groupBy(*P, "path", F.col("specifier").alias("item")).agg(F.count(F.lit(1)).cast("long").alias("n")))
    out = about.withColumn("kind", F.lit("file"))
    for kind, rows in (("entity", ents), ("dependency", way("src", "dst")), ("dependent", way("dst", "src")), ("import", imps)):
        out = out.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return out
