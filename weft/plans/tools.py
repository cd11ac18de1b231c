"""The analytic tools over a graph. Each returns flat DataFrames with a total order before every limit."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import ENTRY_POINTS, LIVE_PREFIXES, contains, effort, is_db_interaction, mermaid_id, optional_prefix
from weft.operators.graph import Graph
from weft.operators.paths import leading_back, safe_depth, shallowest, trails
from weft.session import Scratch
from weft.sources.git import history

_last = lambda c: F.asc_nulls_last(c)
# Fixed rules: (name, files whose path contains this, must not import files whose path contains that).
LAYER_RULES = (
    ("repository -> controller", "repository", "controller"),
    ("repository -> router", "repository", "router"),
    ("database -> view", "database", "view"),
    ("database -> ui", "database", "ui"),
    ("model -> controller", "model", "controller"),
    ("model -> router", "model", "router"),
)


def top(df: DataFrame, n: int | None, *order) -> DataFrame:
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


# Discovery


def architecture(g: Graph, repo_root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(languages, totals, packages)."""
    files = optional_prefix(g.file, "path", repo_root)
    languages = files.groupBy("language").agg(F.count("*").alias("file_count")).select(F.coalesce("language", F.lit("unknown")).alias("language"), "file_count")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    totals = count(files, "files").crossJoin(count(optional_prefix(g.class_, "file", repo_root), "classes")).crossJoin(count(optional_prefix(g.method, "file", repo_root), "methods"))
    totals = totals.crossJoin(count(optional_prefix(g.endpoint, "path", repo_root), "endpoints"))
    packages = top(g.imports.where("dst_label = 'Package'").select(F.col("dst").alias("name")).distinct(), 20, "name")
    return top(languages, None, F.desc("file_count"), "language"), totals, packages


def lookup(g: Graph, fqn: str) -> DataFrame:
    """The class or method of that name; the class first where both exist."""
    c = g.class_.where(F.col("fqn") == fqn).select(F.lit("Class").alias("node_type"), "fqn", "name", "file", "line", F.lit(None).cast("string").alias("signature"))
    m = g.method.where(F.col("fqn") == fqn).select(F.lit("Method").alias("node_type"), "fqn", "name", "file", "line", "signature")
    return top(c.unionByName(m), 1, "node_type")


def neighbours(g: Graph, fqn: str, callers: bool) -> DataFrame:
    near, far = ("dst", "src") if callers else ("src", "dst")
    hit = g.calls.where(F.col(near) == fqn).select(F.col(far).alias("fqn"))
    return top(hit.join(g.method, "fqn").select("fqn", "name", "file", "line"), 20, "fqn")


def search(g: Graph, keyword: str) -> DataFrame:
    k = keyword.strip()
    nodes = g.nodes()
    hit = contains(F.coalesce("identifier", F.lit("")), k) | contains(F.coalesce("name", F.lit("")), k)
    return top(nodes.where(hit if k else F.lit(False)), 50, "node_type", "identifier", _last("file"), _last("line"))


def file_metadata(g: Graph, path: str) -> DataFrame:
    """The first file whose path contains the text."""
    return top(g.file.where(contains("path", path)).select("path", "language", "module_name"), 1, "path")


def file_classes(g: Graph, path: str) -> DataFrame:
    return top(g.class_.where(contains("file", path)).select("fqn", "name", "line"), None, _last("line"), "fqn")


def file_methods(g: Graph, path: str) -> DataFrame:
    m = g.method.where(contains("file", path))
    out = g.calls.groupBy(F.col("src").alias("fqn")).agg(F.count("dst").alias("n"))
    return top(m.join(out, "fqn", "left").select("fqn", "name", "line", "signature", F.coalesce("n", F.lit(0)).alias("outgoing_calls")), None, _last("line"), "fqn")


def file_imports(g: Graph, path: str) -> DataFrame:
    return g.imports.where(contains("src", path)).select(F.col("dst_label").alias("target_type"), F.col("dst").alias("target_name")).distinct()


def endpoints(g: Graph, keyword: str = "") -> DataFrame:
    h = g.handled()
    hit = contains("path", keyword) | contains("handler_name", keyword) | contains("handler_fqn", keyword)
    return top(h.where(hit).select("path", "http_method", "handler_fqn", "handler_name", "language", "file", "line"), None, "path", "http_method", "handler_fqn")


# Tracing


def execution_flow(g: Graph, fqn: str, max_depth: int = 5, min_confidence: float = 0.4) -> DataFrame:
    """Trails downstream, edges below the confidence left out before they are walked."""
    m = g.method.select(F.col("fqn").alias("node"), "name", "file", "line")
    t = shallowest(Scratch(m.sparkSession, "flow"), g.calls.where(F.col("confidence") >= min_confidence), m, F.col("from_") == fqn, safe_depth(max_depth, 5), 100)
    out = t.select(F.col("node").alias("fqn"), "name", "file", "line", "depth", F.round("conf", 3).alias("path_confidence"), F.array_join("trail", ">").alias("trail_"), F.col("conf").alias("c_"))
    return top(out, 100, "depth", F.desc("c_"), "fqn", "trail_").drop("trail_", "c_")


def blast_radius(g: Graph, fqn: str, max_depth: int = 5, min_confidence: float = 0.4, fan_out: int = 20) -> DataFrame:
    """Trails upstream whose product keeps the confidence, from callers of bounded out-degree."""
    t = trails(g.calls.where(F.col("confidence") >= min_confidence), F.col("from_") == fqn, safe_depth(max_depth, 5), reverse=True, min_product=min_confidence)
    degree = g.calls.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    m = g.method.select(F.col("fqn").alias("node"), "name", "file", "line", "language")
    out = t.join(m, "node").join(degree, "node", "left").where(F.coalesce("degree", F.lit(0)) <= fan_out)
    out = out.select(F.col("node").alias("fqn"), "name", "file", "line", "language", "depth", F.round("conf", 3).alias("path_confidence"), F.array_join("trail", ">").alias("trail_"), F.col("conf").alias("c_"))
    return top(out, 100, F.desc("c_"), "depth", "fqn", "trail_").drop("trail_", "c_")


def frontend_callers(g: Graph, fqn: str) -> DataFrame:
    own = g.endpoint.where(F.col("handler_fqn") == fqn).select(F.col("path").alias("endpoint_path"), "http_method")
    return g.routes_to.join(own, ["endpoint_path", "http_method"]).select(F.col("source_method_fqn").alias("source_fqn"), F.col("endpoint_path").alias("api_path"), "http_method").distinct()


def network_boundary(g: Graph, query: str, calls: int = 10, backends: int = 5, downstream: int = 20) -> DataFrame:
    """Route calls, the endpoints they reach, and what their handlers call, as one plan with ranks instead of nested loops."""
    m = g.method.select(F.col("fqn").alias("source_method_fqn"), F.col("name").alias("method_name"))
    rc = g.route_call.join(m, "source_method_fqn").where(contains("path", query) | contains("source_method_fqn", query) | contains("method_name", query))
    rc = top(rc.select("source_method_fqn", F.col("path").alias("rc_path"), "http_method"), calls, "rc_path", "source_method_fqn", "http_method")
    edge = g.routes_to.select(F.col("rc_path"), "http_method", "endpoint_path", "match_type").distinct()
    hit = rc.join(edge, ["rc_path", "http_method"]).join(g.handled().select(F.col("path").alias("endpoint_path"), "http_method", "handler_fqn"), ["endpoint_path", "http_method"])
    rank = lambda n, part, *order: F.row_number().over(Window.partitionBy(*part).orderBy(*order)) <= n
    hit = hit.withColumn("ok", rank(backends, ("source_method_fqn", "rc_path", "http_method"), "endpoint_path", "handler_fqn")).where("ok").drop("ok")
    # Seeded by the few handlers found, so the walk never starts from all methods.
    seeds = hit.select(F.col("handler_fqn").alias("seed")).distinct()
    down = trails_from(g.calls, seeds, 3)
    names = g.method.select(F.col("fqn").alias("node"))
    down = down.join(names, "node").select(F.col("root").alias("handler_fqn"), F.col("node").alias("down_fqn"), "trail")
    down = down.withColumn("ok", rank(downstream, ("handler_fqn",), "down_fqn", F.array_join("trail", ">"))).where("ok").select("handler_fqn", "down_fqn")
    return hit.join(down, "handler_fqn", "left").select("source_method_fqn", "rc_path", "http_method", "endpoint_path", "match_type", "handler_fqn", "down_fqn")


def trails_from(calls: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """trails() from a set of roots: the first step is a semi join, later steps follow the frontier."""
    first = calls.join(seeds, calls.src == seeds.seed, "left_semi")
    one = trails(first, None, 1)
    if depth == 1:
        return one
    e = calls.select(F.col("src").alias("from_"), F.col("dst").alias("to_"), F.col("confidence").alias("c_"), F.concat_ws("\x01", "src", "dst").alias("edge_"))
    out, front = one, one
    for k in range(2, depth + 1):
        step = front.join(e, F.col("node") == F.col("from_")).where(~F.array_contains("trail", F.col("edge_")))
        front = step.select("root", F.col("to_").alias("node"), F.lit(k).alias("depth"), (F.col("conf") * F.col("c_")).alias("conf"), F.array_append("trail", F.col("edge_")).alias("trail"))
        out = out.unionByName(front)
    return out


def data_lineage(g: Graph, fqn: str, max_depth: int = 6) -> DataFrame:
    m = g.method.select(F.col("fqn").alias("node"), "name", "file", "language", "source_code")
    t = shallowest(Scratch(m.sparkSession, "lineage"), g.calls, m, F.col("from_") == fqn, safe_depth(max_depth, 6), 50)
    out = t.select(
        F.col("node").alias("fqn"), "name", "file", "language", "depth", F.round("conf", 3).alias("path_confidence"), is_db_interaction(F.col("source_code")).alias("is_db_interaction"),
        F.array_join("trail", ">").alias("trail_"), F.col("conf").alias("c_"),
    )
    return top(out, 50, "depth", F.desc("c_"), "fqn", "trail_").drop("trail_", "c_")


# Health


def import_cycles(g: Graph, scope: str = "") -> DataFrame:
    """Imports between files on cycles: a on a closed trail of 2..6 imports, b leads back to a in 1..5.

    An import of another file whose way back has at most five edges closes such a trail by itself; a file's import of itself counts
    where the file is on one, or imports itself more than once.
    """
    e = g.imports.where("dst_label = 'File'").select("src", "dst")
    pairs = leading_back(e, 5, Scratch(e.sparkSession, "cycles"))
    loops = e.where("src = dst").groupBy("src", "dst").agg(F.count("*").alias("n")).join(pairs.select("src", F.lit(True).alias("on")).distinct(), "src", "left")
    pairs = optional_prefix(e.join(pairs.unionByName(loops.where("n > 1 or on").select("src", "dst")), ["src", "dst"], "left_semi"), "src", scope)
    return top(pairs.select(F.col("src").alias("file_a"), F.col("dst").alias("file_b")), 50, "file_a", "file_b")


def dead_code(g: Graph, scope: str = "") -> DataFrame:
    m = optional_prefix(g.method, "file", scope).where(~F.col("name").isin(*ENTRY_POINTS))
    for p in LIVE_PREFIXES:
        m = m.where(~F.col("name").startswith(p))
    m = m.where(~F.col("fqn").startswith("unresolved.")).join(g.calls.select(F.col("dst").alias("fqn")), "fqn", "left_anti")
    return top(m.select("fqn", "name", "file", "line", "language"), 100, _last("file"), _last("line"), "fqn")


def god_classes(g: Graph, scope: str = "", threshold: int = 10) -> DataFrame:
    c = optional_prefix(g.class_, "file", scope).select("fqn", "name", "file", "language")
    m = g.method.where("class_fqn is not null").select(F.col("class_fqn"), F.col("fqn").alias("m"))
    big = m.groupBy("class_fqn").agg(F.count("*").alias("method_count")).where(F.col("method_count") >= threshold)
    c = c.join(big, c.fqn == big.class_fqn).drop("class_fqn")
    used = m.join(g.calls, F.col("m") == F.col("src")).join(g.method.select(F.col("fqn").alias("dst"), F.col("file").alias("dep_file")), "dst").select("class_fqn", "dst", "dep_file")
    deps = used.join(c.select(F.col("fqn").alias("class_fqn"), F.col("file").alias("own")), "class_fqn").where("dep_file <> own").groupBy("class_fqn").agg(F.countDistinct("dst").alias("deps"))
    out = c.join(deps, c.fqn == deps.class_fqn, "left").select("fqn", "name", "file", "language", "method_count", F.coalesce("deps", F.lit(0)).alias("external_deps"))
    return top(out.withColumn("complexity_score", F.col("method_count") + F.col("external_deps")), 20, F.desc("complexity_score"), "fqn")


def architecture_drift(g: Graph, rules=LAYER_RULES) -> DataFrame:
    """Forbidden imports, at most 20 a rule; the rules are few, so they are folded into one pass over the imports."""
    e = g.imports.where("dst_label = 'File'").select("src", "dst").distinct()
    hits = F.filter(F.array(*(F.when(contains("src", a) & contains("dst", b), F.lit(r)) for r, a, b in rules)), lambda r: r.isNotNull())
    v = e.select(F.explode(hits).alias("rule"), F.col("src").alias("violating_file"), F.col("dst").alias("imported_file"))
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("violating_file", "imported_file"))
    return v.withColumn("nth", nth).where("nth <= 20").drop("nth")


def package_users(g: Graph, package: str) -> DataFrame:
    files = g.imports.where((F.col("dst_label") == "Package") & contains("dst", package)).select(F.col("src").alias("file"), F.col("dst").alias("package"))
    return files


def third_party_methods(g: Graph, package: str) -> DataFrame:
    m = g.method.join(package_users(g, package).select("file").distinct(), "file", "left_semi").select("fqn", "name", "file", "language", "line").distinct()
    return top(m, 100, _last("file"), _last("line"), "fqn")


def third_party_summary(g: Graph, package: str) -> DataFrame:
    return package_users(g, package).agg(F.array_join(F.array_sort(F.collect_set("package")), ",").alias("matched_packages"), F.countDistinct("file").alias("affected_files"))


def interface_violations(g: Graph, scope: str = "") -> DataFrame:
    i = optional_prefix(g.class_.where("is_interface"), "file", scope).select(F.col("fqn").alias("interface_fqn"), F.col("name").alias("interface_name"), F.col("file").alias("interface_file"))
    m = g.method.select("class_fqn", F.col("name").alias("unimplemented_method"), F.col("signature").alias("required_signature"))
    need = i.join(m, i.interface_fqn == m.class_fqn).drop("class_fqn")
    concrete = g.class_.where("not is_interface").select("fqn").join(g.method.select(F.col("class_fqn").alias("fqn"), F.col("name").alias("unimplemented_method")), "fqn").select("unimplemented_method").distinct()
    return top(need.join(concrete, "unimplemented_method", "left_anti").select("interface_fqn", "interface_name", "unimplemented_method", "required_signature", "interface_file"), 50, "interface_fqn", "unimplemented_method", "required_signature")


def migration_cost(g: Graph, package: str) -> DataFrame:
    """One row of totals; no files count where none of them has methods."""
    files = package_users(g, package).select("file").distinct()
    m = g.method.join(files, "file", "left_semi").select("fqn")
    totals = files.agg(F.count("*").alias("f")).crossJoin(m.agg(F.countDistinct("fqn").alias("affected_methods")))
    callers = g.calls.join(m.select(F.col("fqn").alias("dst")), "dst", "left_semi").agg(F.countDistinct("src").alias("dependent_callers"))
    out = totals.crossJoin(callers).select(F.when(F.col("affected_methods") > 0, F.col("f")).otherwise(F.lit(0)).cast("long").alias("affected_files"), "affected_methods", "dependent_callers")
    points = F.col("affected_files") + F.col("affected_methods") + F.col("dependent_callers")
    return out.withColumn("total_touch_points", points).withColumn("effort_estimate", effort(F.col("total_touch_points")))


def migration_files(g: Graph, package: str, most: int = 20) -> DataFrame:
    """The first files that use the package and have methods, with how many."""
    m = g.method.join(package_users(g, package).select("file").distinct(), "file", "left_semi")
    return top(m.groupBy("file").agg(F.countDistinct("fqn").alias("methods")), most, "file")


def migration(g: Graph, from_package: str, to_package: str = "") -> dict:
    """The whole answer: the totals, the packages' names and sample files."""
    return {"from_package": from_package, "to_package": to_package, "migration_cost": migration_cost(g, from_package).first().asDict(), "sample_files": [r.file for r in migration_files(g, from_package).collect()]}


# Change and summary


def test_dependencies(g: Graph, fqn: str) -> DataFrame:
    """Callees to mock: those marked as resolved or not marked at all."""
    known = g.method.withColumn("resolved", F.col("resolved") if "resolved" in g.method.columns else F.lit(None).cast("boolean")).where("resolved or resolved is null")
    hit = g.calls.where(F.col("src") == fqn).select(F.col("dst").alias("fqn"))
    return top(hit.join(known, "fqn").select("fqn", "name"), 20, "fqn")


def change_complexity(g: Graph, path: str) -> DataFrame:
    m = g.method.where(F.col("file") == path).select("fqn")
    out = g.calls.groupBy(F.col("src").alias("fqn")).agg(F.count("*").alias("n"))
    return m.join(out, "fqn", "left").agg(F.count("*").alias("method_count"), F.round(F.coalesce(F.avg(F.coalesce("n", F.lit(0))), F.lit(0.0)), 6).alias("avg_outgoing_calls"))


def hotspots(g: Graph, path: str) -> DataFrame:
    m = g.method.where(contains("file", path)).select(F.col("fqn"), F.col("name").alias("method_name"))
    return top(g.calls.join(m, g.calls.dst == m.fqn).groupBy("method_name", "fqn").agg(F.count("src").alias("call_count")), 5, F.desc("call_count"), "fqn")


def change_history(spark: SparkSession, g: Graph, path: str) -> dict:
    """The last commits of a file, how complex it is, and its most called methods."""
    commits = [r.asDict() for r in history(spark, path).orderBy("nth").collect()]
    return {
        "file_path": path, "git_history": {"recent_commits": [f"{c['commit']} {c['message']}" for c in commits], "commit_count": len(commits)},
        "complexity_metrics": change_complexity(g, path).first().asDict(), "hotspot_methods": [r.asDict() for r in hotspots(g, path).collect()],
    }


def module_files(g: Graph, path: str) -> DataFrame:
    return top(g.file.where(contains("path", path)).select("path", "language"), 20, "path")


def module_interface(g: Graph, path: str) -> DataFrame:
    m = g.method.where(contains("file", path)).select("fqn", "name", "signature")
    c = g.calls.join(g.method.select(F.col("fqn").alias("src"), F.col("file").alias("caller_file")), "src").where(~contains("caller_file", path))
    return top(c.join(m, c.dst == m.fqn).groupBy("name", "fqn", "signature").agg(F.count("src").alias("external_callers")), 10, F.desc("external_callers"), "fqn")


def module_dependencies(g: Graph, path: str) -> DataFrame:
    return top(g.imports.where(contains("src", path)).select(F.col("dst_label").alias("dep_type"), F.col("dst").alias("dep_name")).distinct(), 20, "dep_type", "dep_name")


def diagram_edges(g: Graph, kind: str, scope: str = "") -> DataFrame:
    """Edges of a Mermaid diagram: (source, target) as identifiers."""
    if kind == "module":
        e = optional_prefix(g.imports.where("dst_label = 'File'"), "src", scope).select("src", "dst").distinct()
        return top(e, 30, "src", "dst").select(mermaid_id(F.col("src")).alias("source"), mermaid_id(F.col("dst")).alias("target"))
    if kind == "class":
        c = top(optional_prefix(g.class_, "file", scope).select("fqn", "name"), 20, "fqn")
        m = g.method.groupBy(F.col("class_fqn").alias("fqn")).agg(F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 5), ",").alias("methods"))
        return c.join(m, "fqn", "left").select(mermaid_id(F.col("name")).alias("source"), F.coalesce("methods", F.lit("")).alias("target"))
    if kind == "endpoint":
        e = top(optional_prefix(g.handled(), "path", scope).select("path", "http_method", "handler_fqn"), 30, "path", "http_method", "handler_fqn")
        return e.select(mermaid_id(F.col("handler_fqn")).alias("source"), F.concat_ws(" ", "http_method", "path").alias("target"))
    raise ValueError(f"unknown diagram type {kind!r}: module, class or endpoint")


def diagram_counts(g: Graph, kind: str, scope: str = "") -> DataFrame:
    """node_count and edge_count of a diagram: distinct ends of module edges; classes and the methods they show; two nodes an endpoint."""
    if kind == "module":
        e = top(optional_prefix(g.imports.where("dst_label = 'File'"), "src", scope).select("src", "dst").distinct(), 30, "src", "dst")
        ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("node_count"))
        return ends.crossJoin(e.agg(F.count("*").alias("edge_count")))
    rows = diagram_edges(g, kind, scope)
    if kind == "class":
        shown = F.when(F.col("target") == "", 0).otherwise(F.size(F.split("target", ",")))
        return rows.agg(F.count("*").alias("node_count"), F.coalesce(F.sum(shown), F.lit(0)).cast("long").alias("edge_count"))
    return rows.agg((2 * F.count("*")).alias("node_count"), F.count("*").alias("edge_count"))


def diagram(g: Graph, kind: str = "module", scope: str = "") -> str:
    """Mermaid text of at most 30 edges."""
    rows = diagram_edges(g, kind, scope).collect()
    if kind == "class":
        return "\n".join(["classDiagram", *(f"    class {r.source} {{\n" + "".join(f"        +{m}()\n" for m in r.target.split(",") if m) + "    }" for r in rows)])
    arrow = (lambda r: f"    {r.source} --> {r.target}") if kind == "module" else (lambda r: f'    {r.source}["{r.source}"] --> E{zlib.crc32(r.target.encode())}["{r.target}"]')
    return "\n".join(["graph TD" if kind == "module" else "graph LR", *map(arrow, rows)])


def scaffold_patterns(g: Graph, language: str) -> DataFrame:
    h = g.handled().where(F.col("language") == language)
    return top(h.select("path", "http_method", "handler_fqn"), 5, "path", "http_method", "handler_fqn")


def graph_status(g: Graph, repo_id: str = "sample") -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(g.file.where(F.col("repo_id") == repo_id), "files")
    for df, name in ((g.class_, "classes"), (g.method, "methods"), (g.endpoint, "endpoints"), (g.route_call, "route_calls"), (g.calls, "calls"), (g.imports, "imports"), (g.routes_to, "routes_to")):
        out = out.crossJoin(count(df, name))
    return out


def full_chain(g: Graph) -> DataFrame:
    """Frontend method, route call, endpoint, handler, what the handler calls."""
    h = g.handled().select(F.col("path").alias("endpoint_path"), "http_method", "handler_fqn")
    return g.routes_to.join(h, ["endpoint_path", "http_method"]).join(g.calls.select(F.col("src").alias("handler_fqn"), F.col("dst").alias("callee_fqn")), "handler_fqn").select("source_method_fqn", "rc_path", "http_method", "endpoint_path", "match_type", "handler_fqn", "callee_fqn")


