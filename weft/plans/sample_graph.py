"""A property graph derived from the relational test tables, by SQL that means the same to Spark and to DuckDB."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import SparkSession

from weft.operators.graph import Graph
from weft.session import shared_root

# View bodies, each of which may use the ones before it; {name} is a stored table.
VIEWS: dict[str, str] = {
    "home": "SELECT l_partkey AS pk, CAST(sum(l_suppkey) % (SELECT count(*) FROM {supplier}) AS BIGINT) + (SELECT min(s_suppkey) FROM {supplier}) AS fid FROM {lineitem} GROUP BY l_partkey",
    "file": """SELECT s_suppkey AS fid, concat(n_name, '/', s_name, '.py') AS path, 'sample' AS repo_id, CASE s_suppkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'java' ELSE 'go' END AS language,
        concat(n_name, '.', s_name) AS module_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "method": """SELECT concat(f.module_name, '.', replace(p.p_type, ' ', '_'), '.m', CAST(p.p_partkey AS VARCHAR(20))) AS fqn, CASE WHEN p.p_partkey % 5 = 0 AND p.p_type = (SELECT min(p_type) FROM {part}) THEN concat(p.p_name, ' only') ELSE p.p_name END AS name, f.path AS file, p.p_size AS line, f.language AS language,
        concat('def ', p.p_name, '()') AS signature, CASE WHEN p.p_partkey % 7 = 0 THEN 'rows = SELECT 1' WHEN p.p_partkey % 11 = 0 THEN 'db.query(x)' ELSE 'return 1' END AS source_code,
        concat(f.module_name, '.', replace(p.p_type, ' ', '_')) AS class_fqn, p.p_partkey AS pk, p.p_type AS ptype
        FROM {part} p JOIN home h ON h.pk = p.p_partkey JOIN file f ON f.fid = h.fid""",
    "class_": "SELECT class_fqn AS fqn, replace(ptype, ' ', '_') AS name, file, min(line) AS line, language, ptype = (SELECT min(p_type) FROM {part}) AS is_interface FROM method GROUP BY class_fqn, ptype, file, language",
    "line_": """SELECT l_partkey AS a, l_suppkey AS fa, l_quantity AS qa, l_discount AS da, l_linenumber AS line,
        lead(l_partkey) OVER w AS b, lead(l_suppkey) OVER w AS fb, lead(l_quantity) OVER w AS qb FROM {lineitem}
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)""",
    "calls": """SELECT s.fqn AS src, d.fqn AS dst, min(x.line) AS line, CAST(max(CASE WHEN x.da <= 0.02 THEN 1.0 WHEN x.da <= 0.05 THEN 0.9 WHEN x.da <= 0.08 THEN 0.7 ELSE 0.2 END) AS DOUBLE) AS confidence, s.pk AS spk
        FROM line_ x JOIN method s ON s.pk = x.a JOIN method d ON d.pk = x.b WHERE x.qa <= 3 GROUP BY s.fqn, d.fqn, s.pk""",
    "imports": """SELECT a.path AS src, 'File' AS dst_label, b.path AS dst, '*' AS symbols FROM (SELECT DISTINCT fa, fb FROM line_ WHERE qa <= 2 AND qb <= 25 AND da <= 0.03 AND b IS NOT NULL) x
        JOIN file a ON a.fid = x.fa JOIN file b ON b.fid = x.fb
        UNION ALL SELECT a.path, 'Package', x.p_brand, '*' FROM (SELECT DISTINCT l_suppkey, p_brand FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_quantity = 1) x JOIN file a ON a.fid = x.l_suppkey""",
    "ev": """SELECT event_id AS id, event_type AS et, CASE event_id % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE 'PATCH' END AS verb,
        (SELECT min(p_partkey) FROM {part}) + event_id % (SELECT count(*) FROM {part}) AS pk FROM {events}""",
    "endpoint": """SELECT path, http_method, min(handler_fqn) AS handler_fqn FROM (
        SELECT concat('/api/', et, CASE WHEN id % 2 = 0 THEN '/{{id}}' ELSE '' END) AS path, verb AS http_method, m.fqn AS handler_fqn FROM ev JOIN method m ON m.pk = ev.pk) x GROUP BY path, http_method""",
    # Of four events one calls with a template, one with a colon, one without a parameter, and one a path that nobody serves.
    "route_call": """SELECT m.fqn AS source_method_fqn, path, http_method, min(m.file) AS source_file, min(m.line) AS line, CAST(min(conf) AS DOUBLE) AS confidence FROM (
        SELECT pk, concat('/api/', et, CASE id % 4 WHEN 0 THEN concat('/$', '{{userId}}') WHEN 1 THEN '' WHEN 2 THEN '/:userId' ELSE '/nowhere' END) AS path, verb AS http_method, CASE WHEN id % 4 = 0 THEN 0.5 ELSE 1.0 END AS conf FROM ev) x
        JOIN method m ON m.pk = x.pk GROUP BY m.fqn, path, http_method""",
    "norm_call": "SELECT r.*, regexp_replace(regexp_replace(path, '[$]?[{{][^}}]+[}}]', '{{param}}'{g}), ':[A-Za-z_][A-Za-z0-9_]*', '{{param}}'{g}) AS norm FROM route_call r",
    "norm_end": "SELECT e.*, regexp_replace(path, '[{{][^}}]+[}}]', '{{param}}'{g}) AS norm FROM endpoint e",
    "routes_to": """SELECT c.source_method_fqn, c.path AS rc_path, c.http_method, e.path AS endpoint_path, 'exact' AS match_type, CAST(1.0 AS DOUBLE) AS confidence FROM norm_call c JOIN norm_end e ON e.path = c.path AND e.http_method = c.http_method
        UNION ALL SELECT c.source_method_fqn, c.path, c.http_method, e.path, 'parameterized', CAST(0.7 AS DOUBLE) FROM norm_call c JOIN norm_end e ON e.norm = c.norm AND e.http_method = c.http_method
        WHERE NOT EXISTS (SELECT 1 FROM endpoint x WHERE x.path = c.path AND x.http_method = c.http_method)""",
}
TABLES = ("supplier", "nation", "lineitem", "part", "events")


def _needed(text: str, known: list[str]) -> list[str]:
    """Views that a text uses, directly or not, in order."""
    found, todo = set(), [text]
    while todo:
        t = todo.pop()
        for v in known:
            if v not in found and re.search(rf"\b{v}\b", t):
                found.add(v)
                todo.append(VIEWS[v])
    return [v for v in known if v in found]


def _text(body: str, dialect: str) -> str:
    body = body.replace("{g}", ", 'g'" if dialect == "duckdb" else "")
    for t in TABLES:
        body = body.replace("{" + t + "}", t if dialect == "duckdb" else "weft_" + t)
    return body.replace("{{", "{").replace("}}", "}")


def with_views(select: str, dialect: str = "duckdb", recursive: bool = False) -> str:
    """A statement that puts the views it uses before a SELECT."""
    ctes = ", ".join(f"{v} AS ({_text(VIEWS[v], dialect)})" for v in _needed(select, list(VIEWS)))
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' if recursive else ' '}{select}"


COLUMNS = {
    "file": "path, repo_id, language, module_name", "class_": "*", "method": "fqn, name, file, line, language, signature, source_code, class_fqn",
    "calls": "src, dst, line, confidence", "imports": "*", "endpoint": "*", "route_call": "*", "routes_to": "*",
}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files that the graph is derived from."""
    found = []
    for t in TABLES:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(t, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)])]
    return repr(sorted(found))


def sample_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph derived from the test tables. As a graph is stored before it is asked, a session derives it once a state of the
    folder's files, into the shared folder; queries then scan those tables with pruned columns and pushed filters instead of
    deriving again in every branch."""
    key = hashlib.sha256(f"{sf_dir} {_state(spark, sf_dir)} {VIEWS}".encode()).hexdigest()[:16]
    root = f"{shared_root(spark)}/weft-graph-{spark.sparkContext.applicationId}-{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{[*COLUMNS][-1]}/_SUCCESS")):
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"weft_{t}")
        for name, cols in COLUMNS.items():
            spark.sql(with_views(f"SELECT {cols} FROM {name}", "spark")).write.mode("overwrite").parquet(f"{root}/{name}")
    return Graph(**{name: spark.read.parquet(f"{root}/{name}") for name in COLUMNS})
