"""The tools by name over a stored graph: as functions, and as a small JSON server with a health check."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.graph import Graph
from weft.operators.store import Snapshots
from weft.plans import generate, guard
from weft.plans import tools as t

#: Columns that a tool may ask of a table that was never written.
EMPTY = {
    "file": "path string, relative string, repo_id string, language string, checksum string, module_name string, last_parsed string", "class_": "fqn string, repo_id string, name string, file string, language string, line int, is_interface boolean, is_abstract boolean",
    "method": "fqn string, repo_id string, name string, file string, signature string, source_code string, language string, line int, is_dynamic boolean, class_fqn string", "calls": "src string, dst string, repo_id string, line int, confidence double, resolved boolean",
    "imports": "src string, dst_label string, dst string, symbols array<string>, repo_id string", "endpoint": "path string, http_method string, repo_id string, handler_fqn string, language string, file string, line int",
    "route_call": "source_method_fqn string, path string, http_method string, repo_id string, confidence double, line int, source_file string",
    "routes_to": "source_method_fqn string, rc_path string, http_method string, endpoint_path string, match_type string, confidence double, repo_id string",
}


def stored_graph(store: Snapshots, repo_id: str | None = None) -> Graph:
    """The graph as it is stored now, of one repository if given; tables that were never written are empty."""
    tables = {name: df if (df := store.read(name)) is not None else store.spark.createDataFrame([], cols) for name, cols in EMPTY.items()}
    return Graph(**{n: df.where(F.col("repo_id") == repo_id) if repo_id else df for n, df in tables.items()})


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


#: Each takes the graph and the arguments of a request; every DataFrame here is bounded by its tool's limit.
TOOLS: dict[str, Callable[..., object]] = {
    "explore_architecture": lambda g, repo_root="": dict(zip(("languages", "totals", "top_packages"), map(_rows, t.architecture(g, repo_root)), strict=True)),
    "find_by_fqn": lambda g, fqn: {"match": _rows(t.lookup(g, fqn)), "callers": _rows(t.neighbours(g, fqn, True)), "callees": _rows(t.neighbours(g, fqn, False))},
    "search_ontology": lambda g, keyword="": _rows(t.search(g, keyword)),
    "get_file_context": lambda g, file_path: {"file": _rows(t.file_metadata(g, file_path)), "classes": _rows(t.file_classes(g, file_path)), "methods": _rows(t.file_methods(g, file_path)), "imports": _rows(t.file_imports(g, file_path))},
    "find_endpoints": lambda g, keyword="": _rows(t.endpoints(g, keyword)),
    "trace_execution_flow": lambda g, fqn, max_depth=5, min_confidence=0.4: _rows(t.execution_flow(g, fqn, max_depth, min_confidence)),
    "analyze_blast_radius": lambda g, fqn, max_depth=5, min_confidence=0.4, fan_out_threshold=20: {"affected_methods": _rows(t.blast_radius(g, fqn, max_depth, min_confidence, fan_out_threshold)), "frontend_callers": _rows(t.frontend_callers(g, fqn))},
    "trace_network_boundary": lambda g, path_or_method: _rows(t.network_boundary(g, path_or_method)),
    "find_data_lineage": lambda g, method_fqn, max_depth=6: _rows(t.data_lineage(g, method_fqn, max_depth)),
    "find_circular_dependencies": lambda g, scope="": _rows(t.import_cycles(g, scope)),
    "find_dead_code": lambda g, scope="": _rows(t.dead_code(g, scope)),
    "identify_god_classes": lambda g, scope="", threshold=10: _rows(t.god_classes(g, scope, threshold)),
    "check_architecture_drift": lambda g: _rows(t.architecture_drift(g)),
    "map_third_party_deps": lambda g, package_name: {"summary": _rows(t.third_party_summary(g, package_name)), "affected_methods": _rows(t.third_party_methods(g, package_name))},
    "find_interface_violations": lambda g, scope="": _rows(t.interface_violations(g, scope)),
    "estimate_migration_cost": lambda g, from_package, to_package="": t.migration(g, from_package, to_package),
    "query_graph_raw": lambda g, sql: _rows(guard.query(g.file.sparkSession, g, sql)),
    "scaffold_feature": lambda g, feature_name, stack="fastapi+react": generate.scaffold(g, feature_name, stack),
    "generate_test_suite": lambda g, method_fqn: generate.test_suite(g, method_fqn),
    "explain_change_history": lambda g, file_path: t.change_history(g.file.sparkSession, g, file_path),
    "generate_architecture_diagram": lambda g, scope="", diagram_type="module": {"mermaid": t.diagram(g, diagram_type, scope)} | t.diagram_counts(g, diagram_type, scope).first().asDict(),
    "summarize_module": lambda g, module_path: {"files": _rows(t.module_files(g, module_path)), "public_interface": _rows(t.module_interface(g, module_path)), "external_dependencies": _rows(t.module_dependencies(g, module_path))},
}
#: Tools that change files and the store.
WRITERS: dict[str, Callable[..., dict]] = {
    "safe_write_file": lambda store, file_path, content, **more: generate.safe_write(store.spark, store, file_path, content, **more),
    "auto_sync_graph": lambda store, file_path, **more: generate.sync_file(store.spark, store, file_path, **more),
}


def answer(store: Snapshots, tool: str, arguments: dict) -> dict:
    """What a tool says, or an error in words: unknown tools, wrong arguments, and whatever the tool raises for its input."""
    try:
        if tool in WRITERS:
            return {"result": WRITERS[tool](store, **arguments)}
        if tool not in TOOLS:
            return {"error": f"no such tool: {tool}"}
        return {"result": TOOLS[tool](stored_graph(store), **arguments)}
    except (TypeError, ValueError, OSError) as e:
        return {"error": str(e)}


def health(store: Snapshots) -> dict:
    """Whether the store can be read, and the batch and tables that count."""
    try:
        current = store.current()
    except Exception as e:  # noqa: BLE001 - whatever the file system raises is the answer
        return {"status": "error", "message": str(e)}
    return {"status": "ok", "tables": current}


def context_tokens(g: Graph) -> DataFrame:
    """How much smaller what tools say is than the sources: tokens as a quarter of the characters, rounded down a text.

    naive: the sources of all methods; graph: names and signatures of methods, and calls between them.
    """
    tokens = lambda *c: F.coalesce(F.sum(F.floor(F.length(F.concat_ws(" ", *c)) / 4)), F.lit(0)).cast("long")
    naive = g.method.agg(tokens("source_code").alias("naive_tokens"))
    shown = g.method.agg(tokens("fqn", "signature").alias("m")).crossJoin(g.calls.agg(tokens("src", "dst").alias("c")))
    out = naive.crossJoin(shown.select((F.col("m") + F.col("c")).alias("graph_tokens")))
    return out.withColumn("reduction_pct", F.when(F.col("naive_tokens") > 0, F.round(100 * (1 - F.col("graph_tokens") / F.col("naive_tokens")), 1)).otherwise(F.lit(0.0)))


def handler(store: Snapshots) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _say(self, code: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - the server's name for it
            if self.path == "/health":
                said = health(store)
                self._say(200 if said["status"] == "ok" else 503, said)
            elif self.path == "/tools":
                self._say(200, {"tools": sorted([*TOOLS, *WRITERS])})
            else:
                self._say(404, {"error": "GET /health or /tools, POST /tools/<name>"})

        def do_POST(self) -> None:  # noqa: N802
            try:
                arguments = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError as e:
                return self._say(400, {"error": str(e)})
            said = answer(store, self.path.removeprefix("/tools/"), arguments)
            self._say(400 if "error" in said else 200, said)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def run(spark: SparkSession, store: Snapshots, port: int) -> None:
    """Serves on this machine until interrupted."""
    with ThreadingHTTPServer(("127.0.0.1", port), handler(store)) as server:
        server.serve_forever()
