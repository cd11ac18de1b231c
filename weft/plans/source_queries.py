"""Queries that put source texts, made from the test tables, through the parsers, the extractors and the ingestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.ingest import graph_tables
from weft.parse.table import parse_files

#: A text of each language with its path; # stands for a nation's key.
TEXTS = {
    "python": ("py/n#.py", "import os\nfrom lib import a as b\nclass Box#(ABC):\n    def put(self, x: int) -> str:\n        return os.path.join(go#(x))\n"),
    "typescript": ("ts/n#.ts", "import { x } from 'y';\ninterface Shape# { area(): number; }\nabstract class Box# {\n  private put(a: number): string {\n    return call.it#(a);\n  }\n}\nconst arrow# = async (b: number) => {\n  free(b);\n};\n"),
    "javascript": ("js/n#.js", "class Box# {\n  put(a) { return go#(a); }\n}\nfunction free#(a, b) {\n  // no(a)\n  return put(a);\n}\n"),
    "java": ("java/N#.java", "package com.n#;\nimport java.util.List;\npublic interface Shape# {\n  double area(int x);\n}\nabstract class Box# {\n  @Override\n  public List<String> get(int a) throws E { return other#(a); }\n}\n"),
    "go": ("go/n#.go", 'package n#\nimport "fmt"\ntype Putter# interface { Put() }\ntype Box# struct { n int }\nfunc (b *Box#) Put(n int) (int, error) {\n  fmt.Println(n)\n}\n'),
    "rust": ("rs/n#.rs", "use std::fmt;\npub struct Box# { n: i32 }\ntrait Putter# {}\nimpl Putter# for Box# {\n  pub fn put(&self) -> i32 { helper::go#('{') }\n}\n"),
    "ruby": ("rb/n#.rb", "require 'json'\nclass Box#\n  def put(x)\n    go#(x)\n    log.info x\n  end\nend\n"),
    "php": ("php/n#.php", "<?php\nuse A\\B;\nif (x) require 'c.php';\ninterface Shape# { }\nclass Box# {\n  public function put($x) { $this->go#($x); }\n}\n"),
    "swift": ("swift/n#.swift", "import Foundation\nprotocol Shape# { }\nclass Box# {\n  func put(x: Int) { go#(x) }\n}\n"),
    "kotlin": ("kt/n#.kt", "import a.b\ninterface Shape# { }\nclass Box# {\n  fun put(x: Int) { go#(x) }\n}\n"),
    "shell": ("sh/n#.sh", "source lib.sh\nstop#() {\n  make all && echo done\n}\n"),
    "sql": ("sql/n#.sql", "CREATE TABLE t# (a int);\n-- CREATE TABLE no (a int);\nCREATE FUNCTION f#() RETURNS int;\nSELECT * FROM t#;\n"),
    "html": ("html/n#.html", "<title>Shop #</title>\n<link rel=stylesheet href='a.css'>\n<script src='a.js'></script>\n"),
    "css": ("css/n#.css", "@import 'b.css';\n.a# { x: y }\n@media print {\n  .b, .c { x: y }\n}\n"),
    "c": ("c/n#.c", "#include <stdio.h>\ntypedef struct { int a; } Box#;\nstatic int put#(Box *b) {\n  return go#(b);\n}\n".replace("#include", "\x00include")),
    "cpp": ("cpp/n#.cpp", "#include <x>\nnamespace shop {\nclass Box# {\n public:\n  int put(int a) { return go#(a); }\n};\n}\n".replace("#include", "\x00include")),
}
# What the texts hold, stated by hand: (language, name, line, interface, abstract) and (language, fqn, line, signature, callees, last first).
TYPES = [
    ("python", "Box#", 3, False, True), ("typescript", "Shape#", 2, True, False), ("typescript", "Box#", 3, False, True), ("javascript", "Box#", 1, False, False), ("java", "Shape#", 3, True, False), ("java", "Box#", 6, False, True),
    ("go", "Putter#", 3, True, False), ("go", "Box#", 4, False, False), ("rust", "Box#", 2, False, False), ("rust", "Putter#", 3, True, False), ("ruby", "Box#", 2, False, False), ("php", "Shape#", 4, True, False), ("php", "Box#", 5, False, False),
    ("swift", "Shape#", 2, True, False), ("swift", "Box#", 3, False, False), ("kotlin", "Shape#", 2, True, False), ("kotlin", "Box#", 3, False, False), ("sql", "t#", 1, False, False), ("html", "Shop #", 1, False, False),
    ("c", "Box#", 2, False, False), ("cpp", "Box#", 3, False, False),
]
METHODS = [
    ("python", "py.n#.Box#.put", 4, "def put(self, x: int) -> str:", "go#,os.path.join"), ("typescript", "ts.n#.Box#.put", 4, "put(a: number): string", "call.it#"), ("typescript", "ts.n#.arrow#", 8, "arrow#(b: number)", "free"),
    ("javascript", "js.n#.Box#.put", 2, "put(a)", "go#"), ("javascript", "js.n#.free#", 4, "free#(a, b)", "put"), ("java", "com.n#.Shape#.area", 4, "area(int x): double", ""), ("java", "com.n#.Box#.get", 7, "@Override get(int a): List<String>", "other#"),
    ("go", "n#.Box#.Put", 5, "func (b *Box#) Put(n int) (int, error)", "fmt.Println"), ("rust", "rs.n#.Box#.put", 5, "fn put(&self) i32", "helper::go#"), ("ruby", "rb.n#.Box#.put", 3, "def put(x)", "log.info,go#"),
    ("php", "php.n#.Box#.put", 6, "function put($x) { $this->go#($x); }", "go#"), ("swift", "swift.n#.Box#.put", 4, "func put(x: Int) { go#(x) }", "go#"), ("kotlin", "kt.n#.Box#.put", 4, "fun put(x: Int) { go#(x) }", "go#"),
    ("shell", "sh.n#.stop#", 2, "stop#() {", "echo,make"), ("sql", "sql.n#.t#.__table__", 1, "table t#", ""), ("sql", "sql.n#.f#", 3, "CREATE FUNCTION f#", ""), ("html", "html.n#.inline_script", 3, "<script src='a.js'></script>", ""),
    ("css", "css.n#..a#", 2, ".a#", ""), ("css", "css.n#..b, .c", 4, ".b, .c", ""), ("c", "c.n#.put#", 3, "int put#(Box *b)", "go#"), ("cpp", "cpp.n#.shop.Box#.put", 5, "int put(int a)", "go#"),
]
IMPORTS = [
    ("python", "import os"), ("python", "from lib import a as b"), ("typescript", "import { x } from 'y';"), ("java", "import java.util.List;"), ("go", 'import "fmt"'), ("go", '"fmt"'), ("rust", "use std::fmt;"), ("ruby", "require 'json'"),
    ("php", "use A\\B;"), ("php", "require 'c.php';"), ("swift", "import Foundation"), ("kotlin", "import a.b"), ("shell", "source lib.sh"), ("sql", "SELECT * FROM t#"), ("html", "a.css"), ("html", "a.js"), ("css", "@import 'b.css';"), ("c", "\x00include <stdio.h>"), ("cpp", "\x00include <x>"),
]


def _files(df: DataFrame, path: Column, language: str, text: Column) -> DataFrame:
    return df.select(path.alias("path"), F.lit(language).alias("language"), F.lit("sample").alias("repo_id"), F.lit(None).cast("string").alias("checksum"), F.encode(text, "utf-8").alias("content"))


def _keyed(text: str) -> Column:
    """A text with the column k in place of #; a zero byte stands for a # that stays."""
    return F.translate(F.replace(F.lit(text), F.lit("#"), F.col("k")), "\x00", "#")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    return parse_files(reduce(DataFrame.unionByName, (_files(n, _keyed(path), language, _keyed(text)) for language, (path, text) in TEXTS.items())))


def _values(rows: list[tuple], names: str) -> str:
    """The stated rows once a nation, for DuckDB."""
    show = lambda v: str(v) if not isinstance(v, str) else "translate(replace('{}', '#', CAST(n_nationkey AS VARCHAR)), chr(1), '#')".format(v.replace("'", "''").replace("\x00", "\x01"))
    return " UNION ALL ".join("SELECT " + ", ".join(f"{show(v)} AS {n}" for v, n in zip(r, names.split(", "), strict=True)) + " FROM nation" for r in rows)


def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, interfaces and the like of sixteen languages."""
    return _parsed(spark, sf_dir).select("language", F.explode("classes").alias("c")).select("language", "c.name", "c.line", "c.is_interface", "c.is_abstract")


def source_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of sixteen languages with their signatures and what they call."""
    m = _parsed(spark, sf_dir).select("language", F.explode("methods").alias("m"))
    return m.select("language", "m.fqn", "m.line", "m.signature", F.array_join("m.calls.callee_name", ",").alias("callees"))


def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("language", F.explode("imports").alias("text"))


def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client calls of one TypeScript file a part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"))
    text = F.concat(F.lit("// load\nfunction load"), "k", F.lit("() {\n  return axios.get('/part/"), "s", F.lit("');\n}\n"))
    parsed = parse_files(_files(part, F.concat(F.lit("web/p"), "k", F.lit(".ts")), "typescript", text))
    return parsed.select(F.explode("route_calls").alias("r")).select("r.source_method_fqn", "r.path", "r.http_method", "r.confidence", "r.line")


_CLIENT = (
    "fetch('/a#', { headers: { x: 1 }, method: 'post' });", "fetch(`/b#/${id}`);", "axios.put('c#', {});", "axios({ method: 'delete', url: '/d#' });", "axios.get(`/e#/${f(1)}`);", "this.http.patch('/f#');",
    "fetch('/g#', { method: 'OPTIONS' });", "other.get('/h#');", "axios.get('/b#/${id}');",
)
# (path, verb, confidence, line) by hand: a verb that doesn't count, a receiver that is no client; the template comes before axios.
_CLIENT_CALLS = [("/a#", "POST", 1.0, 2), ("/b#/${id}", "GET", 0.5, 3), ("/c#", "PUT", 1.0, 4), ("/d#", "DELETE", 1.0, 5), ("/e#/${f(1)}", "GET", 0.5, 6), ("/f#", "PATCH", 1.0, 7)]


def client_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to write a client call, in a method and at module level."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    text = "function load#() {\n" + "".join(f"  {x}\n" for x in _CLIENT) + "}\n"
    parsed = parse_files(_files(s, _keyed("web/s#.js"), "javascript", _keyed(text)))
    return parsed.select(F.explode("route_calls").alias("r")).select("r.source_method_fqn", "r.path", "r.http_method", "r.confidence", "r.line")


def declared_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints and methods of one Python file a supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    text = F.concat(F.lit('@app.get("/nation/'), "n", F.lit('/{id}")\ndef get_'), "k", F.lit("(id: int) -> str:\n    return find(id)\n"))
    parsed = parse_files(_files(s, F.concat(F.lit("api/s"), "k", F.lit(".py")), "python", text))
    e = parsed.select(F.explode(F.arrays_zip("endpoints", "methods")).alias("z"))
    return e.select("z.endpoints.path", "z.endpoints.http_method", "z.endpoints.handler_fqn", "z.endpoints.line", "z.methods.signature", F.element_at("z.methods.calls", 1)["callee_name"].alias("callee_name"))


_ROUTES = {
    "python": ("api/f#.py", '@bp.route("/flask#", methods=["GET", \'PUT\'])\n@bp.route("/none#")\ndef both#():\n    pass\n\n\n\n\n\n@router.delete("fast#/{id}")\nasync def gone#(id):\n    pass\n'),
    "java": ("api/C#.java", 'package com.c#;\n@RestController\n@RequestMapping("/spring#")\npublic class C# {\n  @GetMapping("/users")\n  public List<U> all() { return svc.all(); }\n  @PostMapping("users")\n  public U add(U u) { return svc.add(u); }\n'
             '  @RequestMapping(value = "/users/{id}", method = RequestMethod.DELETE)\n  public void gone(int id) { }\n  @RequestMapping(value = "/x", method = RequestMethod.HEAD)\n  public void head() { }\n  public void plain() { }\n}\n'),
    "typescript": ("api/n#.ts", "export class N# {\n  @Get('')\n  root() { return 1; }\n  @Put('nest#/:id')\n  put(id) { return 2; }\n}\nfunction near#() { }\nrouter.post(`/express#/:id`, h);\napp.get('/express#', h);\nother.get('/no#', h);\n"),
    "javascript": ("api/l#.js", "app.patch('/lone#', h);\n"),
}
_ROUTE_ROWS = [
    ("python", "/flask#", "GET", "api.f#.both#", 3), ("python", "/flask#", "PUT", "api.f#.both#", 3), ("python", "/fast#/{id}", "DELETE", "api.f#.gone#", 11),
    ("java", "/spring#/users", "GET", "com.c#.C#.all", 5), ("java", "/spring#/users", "POST", "com.c#.C#.add", 7), ("java", "/spring#/users/{id}", "DELETE", "com.c#.C#.gone", 9),
    ("typescript", "/", "GET", "api.n#.N#.root", 3), ("typescript", "/nest#/:id", "PUT", "api.n#.N#.put", 5), ("typescript", "/express#/:id", "POST", "api.n#.near#", 7), ("typescript", "/express#", "GET", "api.n#.near#", 7),
    ("javascript", "/lone#", "PATCH", "api.l#.handler_line_1", 1),
]


def framework_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of Flask, FastAPI, Spring, NestJS and Express files."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    parsed = parse_files(reduce(DataFrame.unionByName, (_files(n, _keyed(path), language, _keyed(text)) for language, (path, text) in _ROUTES.items())))
    return parsed.select("language", F.explode("endpoints").alias("e")).select("language", "e.path", "e.http_method", "e.handler_fqn", "e.line")


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, inline and linked scripts and style sheets of every web page, through the HTML parser."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    parsed = parse_files(_files(pages, F.col("page_id").cast("string"), "html", F.coalesce("html", F.lit(""))))
    return parsed.select(F.col("path").cast("long").alias("page_id"), F.get("classes", F.lit(0))["name"].alias("title"), F.size("methods").cast("long").alias("scripts"), F.size("imports").cast("long").alias("links"))


def ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph of a repository at /repo: a library file and an application file a supplier, one of them with an endpoint."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    lib = _files(s, _keyed("lib/s#.py"), "python", _keyed("class Store#:\n    def find(self, x):\n        return x\n\ndef help#(x):\n    return Store#().find(x)\n"))
    app = _files(s, _keyed("app/a#.py"), "python", _keyed('import numpy\nfrom lib.s# import help# as h, Store#\nimport os.path as p\n\n@app.get("/s#/{id}")\ndef main#(id):\n    help#(id)\n    p.join(id)\n    gone#(id)\n'))
    files = lib.unionByName(app).withColumn("relative", F.col("path")).withColumn("path", F.concat(F.lit("/repo/"), "path"))
    return graph_tables(parse_files(files))


_DST = "CAST(s_suppkey AS VARCHAR)"
QUERIES = {
    "source_types": source_types, "source_methods": source_methods, "source_imports": source_imports, "parse_client_calls": client_calls, "parse_client_styles": client_styles,
    "parse_endpoints": declared_endpoints, "parse_frameworks": framework_endpoints, "parse_pages": page_parts,
    "ingest_imports": lambda spark, sf_dir: ingested(spark, sf_dir)["imports"].select("src", "dst_label", "dst", F.array_join("symbols", ",").alias("symbols")),
    "ingest_calls": lambda spark, sf_dir: ingested(spark, sf_dir)["calls"].select("src", "dst", "line", "confidence", "resolved"),
    "ingest_contains": lambda spark, sf_dir: ingested(spark, sf_dir)["contains"].select("src_label", "src", "dst_label", "dst"),
    "ingest_handles": lambda spark, sf_dir: ingested(spark, sf_dir)["handles"].select("src", "path", "http_method"),
}
ORACLE_SQL = {
    "source_types": _values(TYPES, "language, name, line, is_interface, is_abstract"),
    "source_methods": _values(METHODS, "language, fqn, line, signature, callees"),
    "source_imports": _values(IMPORTS, "language, text"),
    "parse_client_calls": """SELECT concat('web.p', p_partkey, '.', f) AS source_method_fqn, concat('/part/', p_size) AS path, 'GET' AS http_method, 1.0::DOUBLE AS confidence, 3 AS line
        FROM (SELECT p_partkey, p_size, concat('load', p_partkey) AS f FROM part UNION ALL SELECT p_partkey, p_size, 'module_level' FROM part)""",
    "parse_client_styles": "SELECT concat('web.s', s_suppkey, '.', f) AS source_method_fqn, replace(path, '#', CAST(s_suppkey AS VARCHAR)) AS path, verb AS http_method, CAST(c AS DOUBLE) AS confidence, line FROM (SELECT s_suppkey, concat('load', s_suppkey) AS f FROM supplier UNION ALL SELECT s_suppkey, 'module_level' FROM supplier) s, (VALUES "
    + ", ".join(map(str, _CLIENT_CALLS)) + ") v(path, verb, c, line)",
    "parse_endpoints": """SELECT concat('/nation/', s_nationkey, '/{id}') AS path, 'GET' AS http_method, concat('api.s', s_suppkey, '.get_', s_suppkey) AS handler_fqn, 2 AS line,
        concat('def get_', s_suppkey, '(id: int) -> str:') AS signature, 'find' AS callee_name FROM supplier""",
    "parse_frameworks": _values(_ROUTE_ROWS, "language, path, http_method, handler_fqn, line"),
    "parse_pages": r"""SELECT page_id, nullif(trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title\s*>', 1)), '') AS title, CAST(len(regexp_extract_all(h, '(?is)<script\b[^>]*>.*?</script\s*>')) AS BIGINT) AS scripts,
        CAST(len(regexp_extract_all(h, '(?is)<script\b[^>]*\bsrc\s*=[^>]*>.*?</script\s*>')) + len(list_filter(regexp_extract_all(h, '(?i)<link\b[^>]*\bhref\s*=[^>]*>'), lambda x: regexp_matches(x, '(?i)\brel\s*=\s*["'']?stylesheet\b'))) AS BIGINT) AS links
        FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS h FROM pages) x""",
    "ingest_imports": f"""SELECT concat('/repo/app/a', k, '.py') AS src, label AS dst_label, replace(dst, '#', k) AS dst, replace(symbols, '#', k) AS symbols FROM (SELECT {_DST} AS k FROM supplier) s,
        (VALUES ('Package', 'numpy', ''), ('Package', 'os.path', ''), ('File', '/repo/lib/s#.py', 'help#,Store#')) v(label, dst, symbols)""",
    "ingest_calls": f"""SELECT replace(src, '#', k) AS src, coalesce(replace(dst, '#', k), (SELECT min(concat('lib.s', s_suppkey, '.Store', s_suppkey, '.find')) FROM supplier)) AS dst, line, CAST(c AS DOUBLE) AS confidence, c > 0.2 AS resolved FROM (SELECT {_DST} AS k FROM supplier) s,
        (VALUES ('lib.s#.help#', 'lib.s#.Store#', 6, 1.0), ('lib.s#.help#', NULL, 6, 0.9), ('app.a#.main#', 'lib.s#.help#', 7, 1.0), ('app.a#.main#', 'p.join', 8, 0.7), ('app.a#.main#', 'unresolved.gone#', 9, 0.2)) v(src, dst, line, c)""",
    "ingest_contains": f"""SELECT a AS src_label, replace(src, '#', k) AS src, b AS dst_label, replace(dst, '#', k) AS dst FROM (SELECT {_DST} AS k FROM supplier) s,
        (VALUES ('Folder', '/repo/lib', 'File', '/repo/lib/s#.py'), ('Folder', '/repo/app', 'File', '/repo/app/a#.py'), ('File', '/repo/lib/s#.py', 'Class', 'lib.s#.Store#'), ('Class', 'lib.s#.Store#', 'Method', 'lib.s#.Store#.find'),
        ('File', '/repo/lib/s#.py', 'Method', 'lib.s#.help#'), ('File', '/repo/app/a#.py', 'Method', 'app.a#.main#')) v(a, src, b, dst)""",
    "ingest_handles": f"SELECT concat('app.a', k, '.main', k) AS src, concat('/s', k, '/{{id}}') AS path, 'GET' AS http_method FROM (SELECT {_DST} AS k FROM supplier) s",
}
