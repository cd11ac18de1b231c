"""Trails, resolution, stitching and the store on hand-built graphs; registered queries against DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weft.operators import store
from weft.operators.paths import leading_back, on_cycle, reachable, safe_depth, shallowest, trails
from weft.operators.resolve import resolve_calls
from weft.operators.stitch import new_edges, stitch
from weft.plans.catalog import ORACLE_SQL
from weft.session import Scratch

SF = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, c) for a, b, c in pairs], "src string, dst string, confidence double")


def test_a_diamond_has_two_trails_and_a_cycle_comes_back_to_its_root(spark):
    d = trails(edges(spark, [("a", "b", 1.0), ("a", "c", 0.9), ("b", "d", 0.7), ("c", "d", 1.0)]), F.col("from_") == "a", 5)
    assert sorted((r.node, r.depth, round(r.conf, 6)) for r in d.collect()) == [("b", 1, 1.0), ("c", 1, 0.9), ("d", 2, 0.7), ("d", 2, 0.9)]
    c = trails(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)]), F.col("from_") == "a", 10)
    assert [(r.node, r.depth) for r in c.orderBy("depth").collect()] == [("b", 1), ("c", 2), ("a", 3)]


def test_ways_back_are_found_up_to_their_length(spark):
    ring = lambda n: [(f"r{n}_{i}", f"r{n}_{(i + 1) % n}", 1.0) for i in range(n)]
    e = edges(spark, [*ring(2), *ring(3), *ring(6), *ring(7), ("x", "r2_0", 1.0), ("r3_0", "y", 1.0), ("z", "z", 1.0)])
    got = {(r.src, r.dst) for r in leading_back(e, 5).collect()}
    assert got == {(a, b) for n in (2, 3, 6) for a, b, _ in ring(n)}


def test_the_shallowest_trails_stop_at_their_number(spark):
    e = edges(spark, [("a", f"b{i}", 1.0) for i in range(5)] + [(f"b{i}", f"c{j}", 1.0) for i in range(5) for j in range(5)] + [("c0", "d", 1.0), ("d", "e", 1.0)])
    names = spark.createDataFrame([(x,) for x in ["a", *(f"b{i}" for i in range(5)), *(f"c{i}" for i in range(5)), "d", "e"]], "node string")
    counts = lambda most: dict(shallowest(Scratch(spark, "test"), e, names, F.col("from_") == "a", 5, most).groupBy("depth").count().collect())
    assert counts(10) == {1: 5, 2: 25} and counts(1000) == {1: 5, 2: 25, 3: 5, 4: 5}


def test_a_batch_shows_all_its_tables_at_once_or_none(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/graph")
    rows = spark.createDataFrame([("a", "r"), ("b", "r"), ("b", "r")], "fqn string, repo_id string")
    with s.batch():
        s.write("method", rows.limit(2))
        s.write("class_", rows.limit(1))
        assert store.Snapshots(spark, s.root).read("method") is None
    assert (s.read("method").count(), s.read("class_").count()) == (2, 1)
    with pytest.raises(RuntimeError), s.batch():
        s.write("method", rows.limit(1))
        raise RuntimeError
    assert s.read("method").count() == 2
    for _ in range(3):
        s.write("method", rows)
    assert s.retain(1) == 4 and s.read("method").count() == 3 and s.read("class_").count() == 1
    assert [(r.fqn, r.rows) for r in store.repeated_keys(s.read("method"), "method").collect()] == [("b", 2)]


def test_a_loop_is_used_once_and_is_no_cycle_by_itself(spark):
    e = edges(spark, [("a", "a", 1.0), ("a", "b", 1.0)])
    assert sorted((r.node, r.depth) for r in trails(e, F.col("from_") == "a", 5).collect()) == [("a", 1), ("b", 1), ("b", 2)]
    assert on_cycle(e, 6).count() == 0
    assert reachable(e, 3).count() == 2


def test_depth_is_clamped():
    assert [safe_depth(d, 5) for d in (0, 1, 10, 11)] == [5, 1, 10, 10]


def test_resolution_ladder(spark):
    known = spark.createDataFrame([("m.A.one",), ("m.B.two",), ("n.B.two",), ("m.solo",)], "fqn string")
    imports = spark.createDataFrame([("f", "os", "os")], "file string, alias string, origin string")
    names = ["m.A.one", "solo", "two", "self.one", "os.path.basename", "Path", "self.one().x"]
    raw = spark.createDataFrame([("f", "m.caller", n, i) for i, n in enumerate(names)], "file string, caller_fqn string, callee_name string, line int")
    got = {r.callee_name: (r.dst, r.confidence) for r in resolve_calls(raw, known, imports).collect()}
    assert got == {
        "m.A.one": ("m.A.one", 1.0), "solo": ("m.solo", 1.0), "two": ("m.B.two", 0.7), "self.one": ("m.A.one", 0.9),
        "os.path.basename": ("os.path.basename", 0.7), "Path": ("unresolved.Path", 0.2), "self.one().x": ("unresolved.self.one().x", 0.2),
    }


def test_exact_routes_come_first_and_verbs_do_not_cross(spark):
    calls = spark.createDataFrame([("s", "/u", "GET"), ("s", "/u/${id}", "GET"), ("s", "/u", "DELETE")], "source_method_fqn string, path string, http_method string")
    ends = spark.createDataFrame([("/u", "GET"), ("/u/{id}", "GET"), ("/u/:id", "POST")], "path string, http_method string")
    found = stitch(calls, ends)
    assert sorted((r.rc_path, r.endpoint_path, r.match_type, r.confidence) for r in found.collect()) == [("/u", "/u", "exact", 1.0), ("/u/${id}", "/u/{id}", "parameterized", 0.7)]
    assert new_edges(found, found).count() == 0


def test_snapshots_merge_and_are_idempotent(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/graph")
    rows = spark.createDataFrame([("a", "r", 1, 1), ("a", "r", 2, 2), ("b", "r", 1, 1)], "fqn string, repo_id string, line int, ingest_seq int")
    s.merge("method", rows, "ingest_seq")
    s.merge("method", rows, "ingest_seq")
    assert sorted((r.fqn, r.line) for r in s.read("method").collect()) == [("a", 2), ("b", 1)]
    s.reset("r")
    assert s.read("method").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    show = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(([show(r[i]) for i in at] for r in rel.fetchall()), key=str)
    assert sorted(([show(r[c]) for c in cols] for r in df.collect()), key=str) == want
