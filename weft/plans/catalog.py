"""Every query of the code-graph library, by name, with its SQL. Queries run on the graph derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import DB_MARKS, ENTRY_POINTS
from weft.operators import store
from weft.operators.resolve import resolve_calls
from weft.operators.stitch import stitch, tallies
from weft.plans import serve, source_queries
from weft.plans import tools as t
from weft.plans.sample_graph import sample_graph, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PKG = "Brand#1"


def _add(name: str, build, sql: str | None, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(sample_graph(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = with_views(sql, recursive=recursive)


def _hub(g, callers: bool = False) -> str:
    """The method with the most callees (callers), the smallest name among equals."""
    row = g.calls.groupBy(F.col("dst" if callers else "src").alias("m")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "m").first()
    return row.m if row else ""


HUB = "(SELECT src FROM calls GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
SINK = "(SELECT dst FROM calls GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _first(g, df: str, col: str) -> str:
    row = getattr(g, df).agg(F.min(col).alias("m")).first()
    return row.m or ""


# Q1 - Q5
_add("arch_languages", lambda g: t.architecture(g)[0], "SELECT coalesce(language, 'unknown') AS language, count(*) AS file_count FROM file GROUP BY language")
_add("arch_totals", lambda g: t.architecture(g)[1], "SELECT (SELECT count(*) FROM file) AS files, (SELECT count(*) FROM class_) AS classes, (SELECT count(*) FROM method) AS methods, (SELECT count(*) FROM endpoint) AS endpoints")
_add("arch_packages", lambda g: t.architecture(g)[2], "SELECT DISTINCT dst AS name FROM imports WHERE dst_label = 'Package' ORDER BY name LIMIT 20")
_add("fqn_lookup", lambda g: t.lookup(g, _hub(g)), f"SELECT 'Method' AS node_type, fqn, name, file, line, signature FROM method WHERE fqn = {HUB}")
_add("fqn_callers", lambda g: t.neighbours(g, _hub(g, True), True), f"SELECT m.fqn, m.name, m.file, m.line FROM calls c JOIN method m ON m.fqn = c.src WHERE c.dst = {SINK} ORDER BY m.fqn LIMIT 20")
_add("fqn_callees", lambda g: t.neighbours(g, _hub(g), False), f"SELECT m.fqn, m.name, m.file, m.line FROM calls c JOIN method m ON m.fqn = c.dst WHERE c.src = {HUB} ORDER BY m.fqn LIMIT 20")
_add(
    "ontology_search",
    lambda g: t.search(g, "an"),
    """SELECT * FROM (SELECT 'Class' AS node_type, fqn AS identifier, name, CAST(NULL AS VARCHAR) AS path, file, line FROM class_ UNION ALL SELECT 'Method', fqn, name, NULL, file, line FROM method
    UNION ALL SELECT 'File', path, NULL, path, path, NULL FROM file UNION ALL SELECT 'Endpoint', path, NULL, path, NULL, NULL FROM endpoint UNION ALL SELECT DISTINCT 'Package', dst, dst, NULL, NULL, NULL FROM imports WHERE dst_label = 'Package') x
    WHERE contains(identifier, 'an') OR contains(coalesce(name, ''), 'an') ORDER BY node_type, identifier, file NULLS LAST, line NULLS LAST LIMIT 50""",
)
_add("file_classes", lambda g: t.file_classes(g, _first(g, "file", "path")), "SELECT fqn, name, line FROM class_ WHERE contains(file, (SELECT min(path) FROM file))")
_add(
    "file_methods",
    lambda g: t.file_methods(g, _first(g, "file", "path")),
    "SELECT m.fqn, m.name, m.line, m.signature, count(c.dst) AS outgoing_calls FROM method m LEFT JOIN calls c ON c.src = m.fqn WHERE contains(m.file, (SELECT min(path) FROM file)) GROUP BY ALL",
)
_add("file_imports", lambda g: t.file_imports(g, _first(g, "file", "path")), "SELECT DISTINCT dst_label AS target_type, dst AS target_name FROM imports WHERE contains(src, (SELECT min(path) FROM file))")
HANDLED = "endpoint e JOIN method m ON m.fqn = e.handler_fqn"
_add("endpoint_search", lambda g: t.endpoints(g, "api"), f"SELECT e.path, e.http_method, e.handler_fqn, m.name AS handler_name, m.language, m.file, m.line FROM {HANDLED} WHERE contains(e.path, 'api') OR contains(m.name, 'api') OR contains(e.handler_fqn, 'api')")


# Q6 - Q9: trails
def _walk(root: str, depth: int, where: str = "true", reverse: bool = False) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    mark = "concat(e.src, chr(1), e.dst)"
    return f"""w(node, depth, conf, trail) AS (SELECT e.{b}, 1, e.confidence, [{mark}] FROM calls e WHERE e.{a} = {root} AND {where}
        UNION ALL SELECT e.{b}, w.depth + 1, w.conf * e.confidence, list_append(w.trail, {mark}) FROM w JOIN calls e ON e.{a} = w.node
        WHERE w.depth < {depth} AND {where} AND NOT list_contains(w.trail, {mark})) """


_add(
    "trace_flow",
    lambda g: t.execution_flow(g, _hub(g)),
    _walk(HUB, 5, "e.confidence >= 0.4") + "SELECT m.fqn, m.name, m.file, m.line, depth, round(conf, 3) AS path_confidence FROM w JOIN method m ON m.fqn = w.node ORDER BY depth, conf DESC, m.fqn, array_to_string(trail, '>') LIMIT 100",
    recursive=True,
)
_add(
    "blast_radius",
    lambda g: t.blast_radius(g, _hub(g, True), fan_out=3),
    _walk(SINK, 5, "e.confidence >= 0.4", reverse=True)
    + """SELECT m.fqn, m.name, m.file, m.line, m.language, depth, round(conf, 3) AS path_confidence FROM w JOIN method m ON m.fqn = w.node
    WHERE conf >= 0.4 AND (SELECT count(*) FROM calls c WHERE c.src = w.node) <= 3 ORDER BY conf DESC, depth, m.fqn, array_to_string(trail, '>') LIMIT 100""",
    recursive=True,
)
_add(
    "blast_frontend",
    lambda g: t.frontend_callers(g, _first(g, "endpoint", "handler_fqn")),
    "SELECT DISTINCT r.source_method_fqn AS source_fqn, r.endpoint_path AS api_path, r.http_method FROM routes_to r JOIN endpoint e ON e.path = r.endpoint_path AND e.http_method = r.http_method WHERE e.handler_fqn = (SELECT min(handler_fqn) FROM endpoint)",
)
_add(
    "data_lineage",
    lambda g: t.data_lineage(g, _hub(g)),
    _walk(HUB, 6)
    + f"""SELECT m.fqn, m.name, m.file, m.language, depth, round(conf, 3) AS path_confidence, {" OR ".join(f"contains(coalesce(m.source_code, ''), '{x}')" for x in DB_MARKS)} AS is_db_interaction
    FROM w JOIN method m ON m.fqn = w.node ORDER BY depth, conf DESC, m.fqn, array_to_string(trail, '>') LIMIT 50""",
    recursive=True,
)
_add(
    "network_boundary",
    lambda g: t.network_boundary(g, "api"),
    """rc AS (SELECT r.source_method_fqn, r.path AS rc_path, r.http_method FROM route_call r JOIN method m ON m.fqn = r.source_method_fqn WHERE contains(r.path, 'api') OR contains(r.source_method_fqn, 'api') OR contains(m.name, 'api')
        ORDER BY r.path, r.source_method_fqn, r.http_method LIMIT 10),
    hit AS (SELECT rc.*, x.endpoint_path, x.match_type, e.handler_fqn FROM rc JOIN (SELECT DISTINCT rc_path, http_method, endpoint_path, match_type FROM routes_to) x ON x.rc_path = rc.rc_path AND x.http_method = rc.http_method
        JOIN endpoint e ON e.path = x.endpoint_path AND e.http_method = x.http_method JOIN method m ON m.fqn = e.handler_fqn
        QUALIFY row_number() OVER (PARTITION BY rc.source_method_fqn, rc.rc_path, rc.http_method ORDER BY x.endpoint_path, e.handler_fqn) <= 5),
    w(root, node, depth, trail) AS (SELECT e.src, e.dst, 1, [concat(e.src, chr(1), e.dst)] FROM calls e WHERE e.src IN (SELECT handler_fqn FROM hit)
        UNION ALL SELECT w.root, e.dst, w.depth + 1, list_append(w.trail, concat(e.src, chr(1), e.dst)) FROM w JOIN calls e ON e.src = w.node WHERE w.depth < 3 AND NOT list_contains(w.trail, concat(e.src, chr(1), e.dst))),
    down AS (SELECT w.root AS handler_fqn, w.node AS down_fqn FROM w JOIN method m ON m.fqn = w.node QUALIFY row_number() OVER (PARTITION BY w.root ORDER BY w.node, array_to_string(trail, '>')) <= 20)
    SELECT hit.source_method_fqn, hit.rc_path, hit.http_method, hit.endpoint_path, hit.match_type, hit.handler_fqn, down.down_fqn FROM hit LEFT JOIN down ON down.handler_fqn = hit.handler_fqn""",
    recursive=True,
)

# Q10 - Q16
_add(
    "import_cycles",
    lambda g: t.import_cycles(g),
    """fe AS (SELECT src, dst FROM imports WHERE dst_label = 'File'),
    w(root, node, depth) AS (SELECT src, dst, 1 FROM fe UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN fe e ON e.src = w.node WHERE w.depth < 6),
    pl(root, node, depth) AS (SELECT src, dst, 1 FROM fe WHERE src <> dst UNION SELECT w.root, e.dst, w.depth + 1 FROM pl w JOIN fe e ON e.src = w.node AND e.src <> e.dst WHERE w.depth < 6)
    SELECT e.src AS file_a, e.dst AS file_b FROM fe e WHERE EXISTS (SELECT 1 FROM pl WHERE pl.root = e.src AND pl.node = e.src) AND EXISTS (SELECT 1 FROM w WHERE w.root = e.dst AND w.node = e.src AND w.depth <= 5) ORDER BY 1, 2 LIMIT 50""",
    recursive=True,
)
_add(
    "dead_code",
    lambda g: t.dead_code(g),
    f"""SELECT fqn, name, file, line, language FROM method m WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = m.fqn) AND name NOT IN ({", ".join(f"'{x}'" for x in ENTRY_POINTS)}) AND NOT starts_with(name, 'test_')
    AND NOT starts_with(name, 'handle') AND NOT starts_with(name, 'on_') AND NOT starts_with(fqn, 'unresolved.') ORDER BY file NULLS LAST, line NULLS LAST, fqn LIMIT 100""",
)
_add(
    "god_classes",
    lambda g: t.god_classes(g, threshold=6),
    """SELECT k.fqn, k.name, k.file, k.language, k.n AS method_count, count(DISTINCT d.fqn) AS external_deps, k.n + count(DISTINCT d.fqn) AS complexity_score FROM (SELECT c.fqn, c.name, c.file, c.language, count(*) AS n FROM class_ c JOIN method m ON m.class_fqn = c.fqn
    GROUP BY ALL HAVING count(*) >= 6) k JOIN method m ON m.class_fqn = k.fqn LEFT JOIN calls e ON e.src = m.fqn LEFT JOIN method d ON d.fqn = e.dst AND d.file <> k.file GROUP BY k.fqn, k.name, k.file, k.language, k.n ORDER BY complexity_score DESC, k.fqn LIMIT 20""",
)
_RULES = (("europe", "A", "E"), ("asia", "I", "N"), ("rest", "U", "R"))
_add(
    "arch_drift",
    lambda g: t.architecture_drift(g, _RULES),
    f"""SELECT rule, violating_file, imported_file FROM (SELECT r.rule, e.src AS violating_file, e.dst AS imported_file, row_number() OVER (PARTITION BY r.rule ORDER BY e.src, e.dst) AS nth
    FROM (VALUES {", ".join(str(r) for r in _RULES)}) r(rule, a, b) JOIN (SELECT DISTINCT src, dst FROM imports WHERE dst_label = 'File') e ON contains(e.src, r.a) AND contains(e.dst, r.b)) x WHERE nth <= 20""",
)
USERS = f"(SELECT DISTINCT src AS file FROM imports WHERE dst_label = 'Package' AND contains(dst, '{PKG}'))"
_add("third_party_methods", lambda g: t.third_party_methods(g, PKG), f"SELECT DISTINCT fqn, name, file, language, line FROM method WHERE file IN {USERS} ORDER BY file NULLS LAST, line NULLS LAST, fqn LIMIT 100")
_add("third_party_summary", lambda g: t.third_party_summary(g, PKG), f"SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) AS matched_packages, count(DISTINCT src) AS affected_files FROM imports WHERE dst_label = 'Package' AND contains(dst, '{PKG}')")
_add(
    "interface_violations",
    lambda g: t.interface_violations(g),
    """SELECT c.fqn AS interface_fqn, c.name AS interface_name, m.name AS unimplemented_method, m.signature AS required_signature, c.file AS interface_file FROM class_ c JOIN method m ON m.class_fqn = c.fqn WHERE c.is_interface
    AND NOT EXISTS (SELECT 1 FROM class_ k JOIN method x ON x.class_fqn = k.fqn WHERE NOT k.is_interface AND x.name = m.name) ORDER BY 1, 3, 4 LIMIT 50""",
)
_add(
    "migration_cost",
    lambda g: t.migration_cost(g, PKG),
    f"""SELECT *, CASE WHEN total_touch_points < 10 THEN 'LOW' WHEN total_touch_points < 50 THEN 'MEDIUM' WHEN total_touch_points < 200 THEN 'HIGH' ELSE 'VERY HIGH' END AS effort_estimate FROM (SELECT f AS affected_files, m AS affected_methods, c AS dependent_callers, f + m + c AS total_touch_points FROM (
    SELECT CASE WHEN (SELECT count(*) FROM method WHERE file IN {USERS}) > 0 THEN (SELECT count(*) FROM {USERS}) ELSE 0 END AS f, (SELECT count(DISTINCT fqn) FROM method WHERE file IN {USERS}) AS m,
    (SELECT count(DISTINCT src) FROM calls WHERE dst IN (SELECT fqn FROM method WHERE file IN {USERS})) AS c) x) y""",
)

# Q20 - Q24
_add("test_dependencies", lambda g: t.test_dependencies(g, _hub(g)), f"SELECT m.fqn, m.name FROM calls c JOIN method m ON m.fqn = c.dst WHERE c.src = {HUB} ORDER BY m.fqn LIMIT 20")
_add("scaffold_patterns", lambda g: t.scaffold_patterns(g, "python"), f"SELECT e.path, e.http_method, e.handler_fqn FROM {HANDLED} WHERE m.language = 'python' ORDER BY 1, 2, 3 LIMIT 5")
_add("change_complexity", lambda g: t.change_complexity(g, _first(g, "file", "path")), "SELECT count(*) AS method_count, round(coalesce(avg(n), 0.0), 6) AS avg_outgoing_calls FROM (SELECT m.fqn, count(c.dst) AS n FROM method m LEFT JOIN calls c ON c.src = m.fqn WHERE m.file = (SELECT min(path) FROM file) GROUP BY m.fqn) x")
_add("hotspots", lambda g: t.hotspots(g, "A"), "SELECT m.name AS method_name, m.fqn, count(*) AS call_count FROM calls c JOIN method m ON m.fqn = c.dst WHERE contains(m.file, 'A') GROUP BY ALL ORDER BY call_count DESC, m.fqn LIMIT 5")
_add("module_files", lambda g: t.module_files(g, "A"), "SELECT path, language FROM file WHERE contains(path, 'A') ORDER BY path LIMIT 20")
_add("module_interface", lambda g: t.module_interface(g, "NATION_1"), "SELECT m.name, m.fqn, m.signature, count(*) AS external_callers FROM calls c JOIN method m ON m.fqn = c.dst JOIN method s ON s.fqn = c.src WHERE contains(m.file, 'NATION_1') AND NOT contains(s.file, 'NATION_1') GROUP BY ALL ORDER BY external_callers DESC, m.fqn LIMIT 10")
_add("module_deps", lambda g: t.module_dependencies(g, "A"), "SELECT DISTINCT dst_label AS dep_type, dst AS dep_name FROM imports WHERE contains(src, 'A') ORDER BY 1, 2 LIMIT 20")
_ID = "CASE WHEN trim(regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g'), '_') = '' THEN 'node' ELSE trim(regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g'), '_') END"
_add("diagram_module_edges", lambda g: t.diagram_edges(g, "module"), f"SELECT {_ID.format('src')} AS source, {_ID.format('dst')} AS target FROM (SELECT DISTINCT src, dst FROM imports WHERE dst_label = 'File' ORDER BY src, dst LIMIT 30) x")
_add(
    "diagram_class_edges",
    lambda g: t.diagram_edges(g, "class"),
    f"SELECT {_ID.format('c.name')} AS source, coalesce((SELECT array_to_string(list_sort(list(m.name))[1:5], ',') FROM method m WHERE m.class_fqn = c.fqn), '') AS target FROM (SELECT fqn, name FROM class_ ORDER BY fqn LIMIT 20) c",
)
_add("diagram_endpoint_edges", lambda g: t.diagram_edges(g, "endpoint"), f"SELECT {_ID.format('handler_fqn')} AS source, concat(http_method, ' ', path) AS target FROM (SELECT e.path, e.http_method, e.handler_fqn FROM {HANDLED} ORDER BY 1, 2, 3 LIMIT 30) x")

# Resolution and stitching
_RAW = """SELECT m.file, c.src AS caller_fqn, c.line, CASE c.spk % 5 WHEN 0 THEN c.dst WHEN 1 THEN concat({seg2}, '.', {seg1}) WHEN 2 THEN concat('self.', {seg1}) WHEN 3 THEN concat('os.', {seg1}, 'x') ELSE concat('nothing', CAST(c.line AS VARCHAR(9))) END AS callee_name
    FROM calls c JOIN method m ON m.fqn = c.src"""
_SPARK_RAW = _RAW.format(seg1="substring_index(c.dst, '.', -1)", seg2="substring_index(substring_index(c.dst, '.', -2), '.', 1)")
_DUCK_RAW = _RAW.format(seg1="split_part(c.dst, '.', -1)", seg2="split_part(c.dst, '.', -2)")


def _resolved(g):
    spark = g.calls.sparkSession
    raw = spark.sql(with_views(_SPARK_RAW, "spark"))
    return resolve_calls(raw, g.method.select("fqn").unionByName(g.class_.select("fqn")), g.file.where("language <> 'go'").select(F.col("path").alias("file"), F.lit("os").alias("alias"), F.lit("os").alias("origin"))).drop("resolved")


_LADDER = f"""raw AS ({_DUCK_RAW}), known AS (SELECT fqn FROM method UNION SELECT fqn FROM class_),
    s AS (SELECT suffix, count(*) AS n, min(fqn) AS pick FROM (SELECT fqn, array_to_string(list_slice(string_split(fqn, '.'), i, len(string_split(fqn, '.'))), '.') AS suffix FROM (SELECT fqn, unnest(range(2, len(string_split(fqn, '.')) + 1)) AS i FROM known) x) y GROUP BY suffix),
    lad AS (SELECT raw.caller_fqn AS src, raw.callee_name, raw.line, k.fqn AS ex, s1.n, s1.pick AS p1, s2.pick AS p2, contains(raw.callee_name, '.') AND split_part(raw.callee_name, '.', 1) = 'os' AND f.language <> 'go' AS imp
        FROM raw JOIN file f ON f.path = raw.file LEFT JOIN known k ON k.fqn = raw.callee_name LEFT JOIN s s1 ON s1.suffix = raw.callee_name LEFT JOIN s s2 ON contains(raw.callee_name, '.') AND s2.suffix = substr(raw.callee_name, strpos(raw.callee_name, '.') + 1)),
    res AS (SELECT src, coalesce(ex, p1, p2, CASE WHEN imp THEN callee_name END, concat('unresolved.', callee_name)) AS dst, callee_name, line,
        CAST(CASE WHEN ex IS NOT NULL THEN 1.0 WHEN p1 IS NOT NULL THEN CASE WHEN n = 1 THEN 1.0 ELSE 0.7 END WHEN p2 IS NOT NULL THEN 0.9 WHEN imp THEN 0.7 ELSE 0.2 END AS DOUBLE) AS confidence FROM lad) """
_add("resolve_calls", _resolved, _LADDER + "SELECT * FROM res", recursive=True)
_add("resolve_summary", lambda g: _resolved(g).groupBy("confidence").agg(F.count("*").alias("calls")), _LADDER + "SELECT confidence, count(*) AS calls FROM res GROUP BY confidence", recursive=True)
_add("stitch_routes", lambda g: stitch(g.route_call, g.endpoint), "SELECT DISTINCT source_method_fqn, rc_path, http_method, endpoint_path, match_type, confidence FROM routes_to")
_add("stitch_summary", lambda g: stitch(g.route_call, g.endpoint).groupBy("match_type").agg(F.count("*").alias("edges")), "SELECT match_type, count(*) AS edges FROM (SELECT DISTINCT source_method_fqn, rc_path, http_method, endpoint_path, match_type FROM routes_to) x GROUP BY match_type")

# Store
_add("sync_diff", lambda g: store.sync_diff(g.method.where("line <= 30").select("fqn"), g.method.where("line >= 20").select("fqn")), "SELECT fqn, CASE WHEN line > 30 THEN 'added' WHEN line < 20 THEN 'removed' ELSE 'updated' END AS change FROM method")
_add("graph_status", t.graph_status, "SELECT " + ", ".join(f"(SELECT count(*) FROM {v}) AS {n}" for v, n in (("file", "files"), ("class_", "classes"), ("method", "methods"), ("endpoint", "endpoints"), ("route_call", "route_calls"), ("calls", "calls"), ("imports", "imports"), ("routes_to", "routes_to"))))
_add("full_chain", t.full_chain, f"SELECT r.source_method_fqn, r.rc_path, r.http_method, r.endpoint_path, r.match_type, e.handler_fqn, c.dst AS callee_fqn FROM routes_to r JOIN ({HANDLED}) ON e.path = r.endpoint_path AND e.http_method = r.http_method JOIN calls c ON c.src = e.handler_fqn")


def _upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", F.col("event_id").alias("ingest_seq"))
    return store.latest(rows, ("user_id", "event_type")).select("user_id", "event_type", "value")


QUERIES["upsert_latest"] = _upsert_latest
ORACLE_SQL["upsert_latest"] = "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"
QUERIES["file_checksums"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
ORACLE_SQL["file_checksums"] = "SELECT doc_id, sha256(text) AS checksum FROM documents"
QUERIES["html_titles"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<script"), F.lit(0))).cast("long").alias("scripts"))
ORACLE_SQL["html_titles"] = "SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts FROM pages"


def _nearest_handler(g):
    """Each route call of a file to the method of that file whose line is nearest, the first one on ties.

    One ordered pass over a file's methods and calls finds the last method before and the first one after each call; no pairs are made.
    """
    none = F.lit(None).cast("string")
    m = g.method.groupBy("file", "line").agg(F.min("fqn").alias("fqn")).select("file", "line", "fqn", none.alias("path"), none.alias("http_method"))
    calls = g.route_call.select(F.col("source_file").alias("file"), "line", none.alias("fqn"), "path", "http_method").distinct()
    here = F.when(F.col("fqn").isNotNull(), F.struct("line", "fqn"))
    order = Window.partitionBy("file").orderBy("line")
    before = F.last(here, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(here, ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    both = m.unionByName(calls).select("*", before.alias("b"), after.alias("a")).where("fqn is null and (a is not null or b is not null)")
    first = F.col("a").isNull() | (F.col("line") - F.col("b.line") <= F.col("a.line") - F.col("line"))
    return both.select("file", "path", "http_method", "line", F.when(first, F.col("b.fqn")).otherwise(F.col("a.fqn")).alias("handler_fqn"))


_add("nearest_handler", _nearest_handler, "SELECT r.source_file AS file, r.path, r.http_method, r.line, arg_min(m.fqn, (abs(m.line - r.line), m.line, m.fqn)) AS handler_fqn FROM (SELECT DISTINCT source_file, path, http_method, line FROM route_call) r JOIN method m ON m.file = r.source_file GROUP BY ALL")

# What the tools say beside their main rows
_add("file_metadata", lambda g: t.file_metadata(g, "A"), "SELECT path, language, module_name FROM file WHERE contains(path, 'A') ORDER BY path LIMIT 1")
_add("migration_files", lambda g: t.migration_files(g, PKG), f"SELECT file, count(DISTINCT fqn) AS methods FROM method WHERE file IN {USERS} GROUP BY file ORDER BY file LIMIT 20")
_add(
    "diagram_module_counts",
    lambda g: t.diagram_counts(g, "module"),
    "e AS (SELECT DISTINCT src, dst FROM imports WHERE dst_label = 'File' ORDER BY src, dst LIMIT 30) SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e) x) AS node_count, (SELECT count(*) FROM e) AS edge_count",
    recursive=True,
)
_add("diagram_class_counts", lambda g: t.diagram_counts(g, "class"), "SELECT count(*) AS node_count, CAST(sum(least(5, (SELECT count(*) FROM method m WHERE m.class_fqn = c.fqn))) AS BIGINT) AS edge_count FROM (SELECT fqn FROM class_ ORDER BY fqn LIMIT 20) c")
_add("diagram_endpoint_counts", lambda g: t.diagram_counts(g, "endpoint"), f"SELECT 2 * count(*) AS node_count, count(*) AS edge_count FROM (SELECT e.path FROM {HANDLED} ORDER BY e.path, e.http_method, e.handler_fqn LIMIT 30) x")
_add(
    "stitch_tallies",
    lambda g: tallies(g.route_call, stitch(g.route_call, g.endpoint)),
    """k AS (SELECT source_method_fqn, rc_path, http_method, max(CASE WHEN match_type = 'exact' THEN 1 ELSE 0 END) AS ex FROM routes_to GROUP BY ALL)
    SELECT count(*) FILTER (WHERE k.ex = 1) AS exact_matches, count(*) FILTER (WHERE k.ex = 0) AS param_matches, count(*) FILTER (WHERE k.ex IS NULL) AS unmatched_calls, (SELECT count(*) FROM (SELECT DISTINCT source_method_fqn, rc_path, http_method, endpoint_path FROM routes_to) x) AS total_edges_created
    FROM route_call r LEFT JOIN k ON k.source_method_fqn = r.source_method_fqn AND k.rc_path = r.path AND k.http_method = r.http_method""",
    recursive=True,
)
_add(
    "context_tokens",
    lambda g: serve.context_tokens(g),
    """t AS (SELECT (SELECT CAST(sum(length(source_code) // 4) AS BIGINT) FROM method) AS n, (SELECT CAST(sum(length(concat_ws(' ', fqn, signature)) // 4) AS BIGINT) FROM method) + (SELECT CAST(coalesce(sum(length(concat_ws(' ', src, dst)) // 4), 0) AS BIGINT) FROM calls) AS g)
    SELECT n AS naive_tokens, g AS graph_tokens, round(100 * (1 - g / n), 1) AS reduction_pct FROM t""",
    recursive=True,
)

QUERIES |= source_queries.QUERIES
ORACLE_SQL |= source_queries.ORACLE_SQL
