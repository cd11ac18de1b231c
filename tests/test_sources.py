"""Parsers, extractors, the repository source, ingestion and its stream on small files written here."""

import os

import pytest

from weft.operators.store import Snapshots
from weft.parse import routes, scan

SOURCES = {
    "python": ("a.py", "import os\nfrom lib.core import Thing as T, run\n\nclass Box:\n    def put(self, x: int) -> str:\n        self.run(x)\n        return os.path.basename(run(x))\n\n    async def take(self):\n        pass\n\ndef free():\n    Box().put(1)\n", ["Box"], ["put", "take", "free"], 2),
    "typescript": ("a.ts", "import { x } from 'y';\n// class No {}\ninterface Shape { area(): number; }\nclass Box extends Base {\n  private put(a: number): string {\n    if (a) { call.it(a); }\n    return 'class Not {';\n  }\n}\nfunction free(a) { return put(a); }\nconst arrow = async (b: number) => {\n  free(b);\n};\n", ["Shape", "Box"], ["put", "free", "arrow"], 1),
    "java": ("A.java", "package com.x;\nimport java.util.List;\npublic class A {\n  public A() { init(); }\n  @Override\n  private List<String> get(int a) throws E { return other(a); }\n}\nenum B { X }\n", ["A", "B"], ["A", "get"], 1),
    "go": ("a.go", 'package shop\nimport (\n  "fmt"\n)\ntype Box struct { n int }\ntype Putter interface { Put() }\nfunc (b *Box) Put(n int) error {\n  fmt.Println(n)\n  return nil\n}\nfunc Free() {}\n', ["Box", "Putter"], ["Put", "Free"], 2),
    "rust": ("a.rs", "use std::fmt;\nstruct Box<T> { n: T }\ntrait Put { fn put(&self); }\nimpl<T> Put for Box<T> {\n  fn put(&self) { helper::go('{'); }\n}\nfn free() -> i32 { 1 }\n", ["Box", "Put"], ["put", "put", "free"], 1),
    "ruby": ("a.rb", "require 'json'\nclass Box\n  def put(x)\n    if x\n      go(x)\n    end\n  end\n  def self.make\n  end\nend\n", ["Box"], ["put", "make"], 1),
    "php": ("a.php", "<?php\nuse A\\B;\nclass Box {\n  public function put($x) { go($x); }\n}\nfunction free() {}\n", ["Box"], ["put", "free"], 1),
    "swift": ("a.swift", "import Foundation\nclass Box {\n  init(x: Int) { go() }\n  func put() { }\n}\nprotocol P { }\n", ["Box", "P"], ["init", "put"], 1),
    "kotlin": ("a.kt", "import a.b\nclass Box(val n: Int) {\n  fun put(x: Int) { go(x) }\n}\nobject One { }\n", ["Box", "One"], ["Box", "put"], 1),
    "shell": ("a.sh", "source lib.sh\nfunction go {\n  echo 1\n}\nstop() {\n  go\n}\n", [], ["go", "stop"], 1),
    "sql": ("a.sql", "CREATE TABLE t (a int);\n-- CREATE TABLE no (a int);\nCREATE FUNCTION f() RETURNS int;\nSELECT * FROM t;\n", ["t"], ["__table__", "f"], 1),
    "html": ("a.html", "<title>Shop</title><link rel=stylesheet href='a.css'><script src='a.js'></script><script>go()</script>", ["Shop"], ["inline_script"] * 2, 2),
    "css": ("a.css", "@import 'b.css';\n.a { x: y }\n@media print {\n  .b, .c { x: y }\n}\n", [], [".a", ".b, .c"], 1),
    "c": ("a.c", "#include <stdio.h>\ntypedef struct { int a; } Box;\nstatic int put(Box *b) {\n  return go(b);\n}\n", ["Box"], ["put"], 1),
    "cpp": ("a.cpp", "#include <x>\nnamespace shop {\nclass Box {\n public:\n  int put(int a) { return go(a); }\n};\nint Box::take() { return 1; }\n}\n", ["Box"], ["put", "take"], 1),
}


@pytest.mark.parametrize("language", SOURCES)
def test_parts(language):
    path, text, types, methods, imports = SOURCES[language]
    got = scan.parse(path, text, language)
    assert got["error"] is None
    assert [c["name"] for c in got["classes"]] == types
    assert sorted(m["name"] for m in got["methods"]) == sorted(methods)
    assert len(got["imports"]) == imports
    assert scan.problems(text, language) == []


def test_python_details():
    got = scan.parse(*SOURCES["python"][:2], "python")
    put = got["methods"][0]
    assert (put["fqn"], put["signature"], put["line"]) == ("a.Box.put", "def put(self, x: int) -> str:", 5)
    assert {c["callee_name"] for c in put["calls"]} == {"self.run", "os.path.basename", "run"}
    assert scan.parse("a.py", "def (:", "python")["error"] and scan.problems("def (:", "python")


def test_awkward_texts():
    for language in SOURCES:
        for text in ("", "\n", "{", "}" * 50, "é 漢 🙂", "class", "a" * 20000, "(" * 3000, "const a = " * 500):
            scan.parse("x", text, language)
    assert scan.problems("f( {", "java") == ["line 1, column 2: ( is never closed", "line 1, column 4: { is never closed"]


def test_endpoints_and_calls():
    py = '@app.get("/a/{id}")\ndef one(id):\n    pass\n\n\n\n\n\n@app.route("/b", methods=["GET", "POST"])\ndef two():\n    pass\n'
    found = routes.endpoints(py, "python", scan.parse("m.py", py, "python"))
    assert [(e["http_method"], e["path"], e["handler_fqn"]) for e in found] == [("GET", "/a/{id}", "m.one"), ("GET", "/b", "m.two"), ("POST", "/b", "m.two")]
    java = '@RequestMapping("/api")\npublic class C {\n  @GetMapping("/users")\n  public String list() { return ""; }\n}\n'
    assert [(e["http_method"], e["path"], e["handler_fqn"]) for e in routes.endpoints(java, "java", scan.parse("C.java", java, "java"))] == [("GET", "/api/users", "C.C.list")]
    ts = "export async function load(id) {\n  await fetch(`/u/${id}`);\n  return axios.post('/u', {});\n}\nrouter.get('/z/:id', h);\n"
    parsed = scan.parse("m.ts", ts, "typescript")
    assert [(c["source_method_fqn"], c["http_method"], c["path"], c["confidence"]) for c in routes.route_calls(ts, "typescript", parsed)] == [
        ("m.load", "GET", "/u/${id}", 0.5), ("m.load", "POST", "/u", 1.0), ("m.module_level", "GET", "/u/${id}", 0.5), ("m.module_level", "POST", "/u", 1.0),
    ]
    assert [(e["path"], e["handler_fqn"]) for e in routes.endpoints(ts, "typescript", parsed)] == [("/z/:id", "m.load")]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    files = {
        "main.py": "from lib.util import helper\n\ndef start():\n    helper()\n    nowhere()\n", "lib/util.py": "def helper():\n    return 1\n", "node_modules/x.js": "function no() {}\n", "skip/y.py": "def no(): pass\n",
        "z.log": "x", ".gitignore": "skip/\n*.log\n# no\n", "api.py": '@app.get("/u/{id}")\ndef user(id):\n    return id\n', "web.ts": "function load(id) {\n  return fetch(`/u/${id}`);\n}\n",
    }
    for name, text in files.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_text(text)
    return root


def names(store, table, col):
    return sorted(r[0] for r in store.read(table).select(col).collect())


def test_ingest_is_incremental(spark, repo, tmp_path):
    from weft.__main__ import main
    from weft.sources.repo import source_files

    assert sorted(os.path.relpath(r.path, repo) for r in source_files(spark, str(repo)).collect()) == ["api.py", "lib/util.py", "main.py", "web.ts"]
    store, args = Snapshots(spark, str(tmp_path / "store")), ["--root", str(repo), "--store", str(tmp_path / "store")]
    assert main(["ingest", *args], spark)["tables"]
    assert main(["ingest", *args], spark)["tables"] == []
    rows = {r.dst.rsplit(".", 1)[-1]: r.confidence for r in store.read("calls").collect()}
    assert rows == {"helper": 1.0, "nowhere": 0.2, "fetch": 0.2}
    assert main(["stitch", *args], spark) == {"exact_matches": 0, "param_matches": 2, "unmatched_calls": 0, "total_edges_created": 2}
    assert main(["stitch", *args], spark)["total_edges_created"] == 0
    (repo / "main.py").write_text("from lib.util import helper\n\ndef begin():\n    helper()\n")
    main(["ingest", *args], spark)
    assert names(store, "method", "name") == ["begin", "helper", "load", "user"]
    assert sorted(r.dst.rsplit(".", 1)[-1] for r in store.read("calls").collect()) == ["fetch", "helper"]
    assert main(["status", *args], spark)["file"] == 4
    main(["reset", *args, "--yes"], spark)
    assert main(["status", *args], spark)["method"] == 0


def test_stream(spark, repo, tmp_path):
    from weft.streaming.watch import watch

    store = Snapshots(spark, str(tmp_path / "store"))
    watch(spark, str(repo), store, str(tmp_path / "cp"), once=True).awaitTermination()
    assert names(store, "method", "name") == ["helper", "load", "start", "user"]


def test_guard_and_texts(spark, tmp_path):
    from weft.plans import generate, guard
    from weft.plans.sample_graph import sample_graph

    g = sample_graph(spark, "/root/testdata/sf0.001")
    assert guard.query(spark, g, "select count(*) as created from method").first().created > 0
    assert guard.query(spark, g, "with m as (select upper(name) as n from method) select n, (select count(*) from calls) as c from m where n in (select upper(name) from method)").count() > 0
    for sql in (
        "drop view method", "insert into method values (1)", "create table t as select 1", "set x=1", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select * from parquet.`/etc/passwd`",
        "select * from other", "select name, (select java_method('java.lang.System', 'nanoTime')) from method", "with x as (select * from json.`/a`) select * from x", "select unknown_function(1)",
    ):
        with pytest.raises(guard.NotReadOnly):
            guard.query(spark, g, sql)
    assert [f["path"] for f in generate.scaffold(g, "order item")["files"]] == ["backend/order_item_api.py", "frontend/OrderItem.tsx"]
    fqn = g.method.where("name is not null").orderBy("fqn").first().fqn
    assert generate.test_suite(g, fqn)["content"] and "error" in generate.test_suite(g, "none")
    store, path = Snapshots(spark, str(tmp_path / "s")), tmp_path / "n.py"
    assert not generate.safe_write(spark, store, str(path), "def (")["success"] and not path.exists()
    assert generate.safe_write(spark, store, str(path), "def f(): pass\n")["success"] and names(store, "method", "name") == ["f"]


def test_java_annotations_belong_to_their_own_method():
    java = """package com.x;
@RestController
@RequestMapping("/api/users")
public class C {
  @GetMapping("/{id}")
  public User get(int id) { return svc.get(id); }
  @PostMapping("/")
  public User add(@RequestBody User u) { return svc.add(u); }
  @RequestMapping(value = "/{id}", method = RequestMethod.PUT)
  public User put(int id) { return null; }
  public void plain() { }
}
"""
    parsed = scan.parse("C.java", java, "java")
    assert [(e["http_method"], e["path"], e["handler_fqn"], e["line"]) for e in routes.endpoints(java, "java", parsed)] == [("GET", "/api/users/{id}", "com.x.C.get", 5), ("POST", "/api/users", "com.x.C.add", 7), ("PUT", "/api/users/{id}", "com.x.C.put", 9)]
    assert [m["signature"] for m in parsed["methods"]][1:] == ['@PostMapping("/") add(@RequestBody User u): User', '@RequestMapping(value = "/{id}", method = RequestMethod.PUT) put(int id): User', "plain(): void"]


def test_arguments_are_read_whole_and_open_calls_end():
    text = "fetch('/a,b', { x: [1, {y: ')'}], method: \"PUT\" }) + axios.get(`/t/${f('(', 1)}`); fetch('/open"
    parsed = scan.parse("m.js", text, "javascript")
    assert [(c["http_method"], c["path"], c["confidence"]) for c in routes.route_calls(text, "javascript", parsed)] == [("PUT", "/a,b", 1.0), ("GET", "/t/${f('(', 1)}", 0.5)]
    for t in ("fetch(", "fetch('", "axios({", "axios.get(`", "app.get(", "@Get(", "@app.route('/x', methods=["):
        for language in ("python", "java", "typescript"):
            p = scan.parse("m", t, language)
            routes.endpoints(t, language, p), routes.route_calls(t, language, p)


def test_a_python_text_keeps_what_its_bad_lines_leave():
    got = scan.parse("m.py", "import os\ndef a():\n    return 1\nx = = 2\nclass B:\n    def c(self):\n        d(\n", "python")
    assert got["error"] and [m["name"] for m in got["methods"]] == ["a", "c"] and got["imports"] == ["import os"]


def test_sync_tells_what_changed_and_leaves_no_edge_to_a_removed_name(spark, tmp_path):
    from weft.plans.serve import answer, health

    root, store = tmp_path / "repo", Snapshots(spark, str(tmp_path / "store"))
    os.makedirs(root / "lib")
    (root / "lib" / "a.py").write_text("def one():\n    two()\n\ndef two():\n    pass\n")
    (root / "use.py").write_text("import numpy\nfrom lib.a import one\n\ndef go():\n    one()\n    two()\n")
    from weft.operators.ingest import sync
    from weft.sources.repo import source_files, source_paths

    assert [os.path.relpath(r.path, root) for r in source_paths(spark, str(root)).collect()] == ["lib/a.py", "use.py"]
    first = sync(store, source_files(spark, str(root)))
    assert (first["nodes_added"], first["nodes_removed"], first["nodes_updated"]) == (3, 0, 0)
    assert sorted((r.dst_label, os.path.basename(r.dst)) for r in store.read("imports").collect()) == [("File", "a.py"), ("Package", "numpy")]
    assert {(r.src, r.dst) for r in store.read("calls").collect()} == {("lib.a.one", "lib.a.two"), ("use.go", "lib.a.one"), ("use.go", "lib.a.two")}
    done = answer(store, "safe_write_file", {"file_path": str(root / "lib" / "a.py"), "content": "def one():\n    three()\n\ndef three():\n    pass\n"})["result"]
    assert done["success"] and done["graph_updated"]
    assert {(r.src, r.dst) for r in store.read("calls").collect()} == {("lib.a.one", "lib.a.three"), ("use.go", "lib.a.one")}
    assert not answer(store, "safe_write_file", {"file_path": str(root / "lib" / "a.py"), "content": "def ("})["result"]["success"]
    again = answer(store, "auto_sync_graph", {"file_path": str(root / "use.py")})["result"]
    assert again["tables"] == [] and again["git_sha"]
    assert answer(store, "find_by_fqn", {"fqn": "lib.a.one"})["result"]["callers"] == [{"fqn": "use.go", "name": "go", "file": str(root / "use.py"), "line": 4}]
    assert answer(store, "get_file_context", {"file_path": "use.py"})["result"]["file"][0]["module_name"] == "use"
    assert "error" in answer(store, "no_tool", {}) and "error" in answer(store, "find_by_fqn", {"name": 1}) and health(store)["status"] == "ok"


def test_the_tool_server(spark, tmp_path):
    import json
    import threading
    import urllib.request
    from http.server import ThreadingHTTPServer

    from weft.plans.serve import handler

    with ThreadingHTTPServer(("127.0.0.1", 0), handler(Snapshots(spark, str(tmp_path / "none")))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}"
        ask = urllib.request.build_opener(urllib.request.ProxyHandler({})).open
        assert json.load(ask(f"{at}/health"))["status"] == "ok" and len(json.load(ask(f"{at}/tools"))["tools"]) == 24
        assert json.load(ask(urllib.request.Request(f"{at}/tools/search_ontology", b'{"keyword": "x"}')))["result"] == []
        server.shutdown()
