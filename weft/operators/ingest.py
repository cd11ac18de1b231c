"""From parsed files to graph tables, and into the snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.resolve import resolve_calls
from weft.operators.stitch import stitch
from weft.operators.store import KEYS, Snapshots, detach, sync_diff
from weft.parse.table import parse_files
from weft.sources.repo import changed_files


def import_rows(parsed: DataFrame) -> DataFrame:
    """file, module_name, language, module, symbols, alias, origin, repo_id: one row a name that an import brings in."""
    t = F.trim("text")
    python_from = t.rlike(r"^from\s+\S+\s+import\b")
    names = F.when(python_from, F.regexp_replace(F.regexp_extract(t, r"(?s)\bimport\s+(.*)$", 1), r"[()\s]+", " ")).otherwise(F.regexp_replace(t, r"^import\s+", ""))
    i = parsed.select("path", "module_name", "language", "repo_id", F.explode("imports").alias("text"))
    i = i.withColumn("py", F.col("language") == "python")
    i = i.withColumn("items", F.when(F.col("py"), F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(t)))
    i = i.withColumn("symbols", F.when(F.col("py") & python_from, F.transform("items", lambda x: F.regexp_extract(x, r"^(\S+)", 1))).otherwise(F.array().cast("array<string>")))
    i = i.withColumn("base", F.when(python_from, F.regexp_extract(t, r"^from\s+(\S+)", 1))).withColumn("item", F.explode("items"))
    plain = F.regexp_extract("item", r"^(\S+)", 1)
    module = F.when(F.col("base").isNotNull(), F.col("base")).when(F.col("py"), plain).otherwise(F.col("item"))
    short = F.when(F.col("item").rlike(r"\sas\s"), F.regexp_extract("item", r"\sas\s+(\S+)", 1)).otherwise(plain)
    origin = F.when(F.col("base").isNotNull(), F.concat_ws(".", "base", plain)).otherwise(plain)
    return i.select(F.col("path").alias("file"), "module_name", "language", module.alias("module"), "symbols", F.when(F.col("py"), short).alias("alias"), F.when(F.col("py"), origin).alias("origin"), "repo_id")


def graph_tables(parsed: DataFrame, known: DataFrame | None = None, prefix: str | None = None, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """All node and edge tables of parsed files. known: names stored before, so that calls into unchanged files resolve; files:
    (path, repo_id) stored before, so that imports of unchanged files do.

    An import is internal if its module is a file of the repository, or is the prefix or below it; without a prefix that is the first
    part of the importing module's name. Its target is then a file below the repository's root, else a package.
    """
    file = parsed.select("path", "relative", "repo_id", "language", "checksum", "module_name", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_parsed"))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    folder = file.select(parent.alias("path"), F.substring_index(parent, "/", -1).alias("name"), "repo_id").distinct()
    of = ["path", "language", "repo_id"]
    c = parsed.select(*of, F.explode("classes").alias("c")).select(F.col("c.fqn").alias("fqn"), "repo_id", F.col("c.name").alias("name"), F.col("path").alias("file"), "language", F.col("c.line").alias("line"), F.col("c.is_interface").alias("is_interface"), F.col("c.is_abstract").alias("is_abstract"))
    m = parsed.select(*of, "classes", F.explode("methods").alias("m"))
    own = F.element_at(F.filter("classes", lambda x: x["name"] == F.col("m.class_name")), -1)["fqn"]
    own = F.when(F.exists("classes", lambda x: x["name"] == F.col("m.class_name")), own)
    m = m.select(F.col("m.fqn").alias("fqn"), "repo_id", F.col("m.name").alias("name"), F.col("path").alias("file"), F.col("m.signature").alias("signature"), F.col("m.source_code").alias("source_code"), "language", F.col("m.line").alias("line"), F.lit(False).alias("is_dynamic"), own.alias("class_fqn"), F.col("m.calls").alias("calls"))
    imported = import_rows(parsed)
    # The root as it stands before a file's relative path; modules are files below it.
    roots = parsed.select(F.col("path").alias("file"), "repo_id", F.expr("left(path, length(path) - length(relative))").alias("root"))
    there = parsed.select("path", "repo_id")
    there = (there.unionByName(files.select("path", "repo_id")) if files is not None else there).distinct()
    first = F.lit(prefix) if prefix is not None else F.substring_index("module_name", ".", 1)
    below = (F.length(first) > 0) & ((F.col("module") == first) | F.startswith("module", F.concat(first, F.lit("."))))
    target = F.concat("root", F.regexp_replace("module", r"\.", "/"), F.lit(".py"))
    i = imported.join(roots, ["file", "repo_id"]).withColumn("target", target)
    i = i.join(there.select(F.col("path").alias("target"), "repo_id", F.lit(True).alias("is_file")), ["target", "repo_id"], "left")
    inside = F.coalesce("is_file", F.lit(False)) | below
    imports = i.select(F.col("file").alias("src"), F.when(inside, "File").otherwise("Package").alias("dst_label"), F.when(inside, F.col("target")).otherwise(F.col("module")).alias("dst"), "symbols", "repo_id").distinct()
    names = c.select("fqn").unionByName(m.select("fqn"))
    names = names.unionByName(known.select("fqn")) if known is not None else names
    raw = m.select("file", F.col("fqn").alias("caller_fqn"), "repo_id", F.explode("calls").alias("c")).select("file", "caller_fqn", "repo_id", "c.callee_name", "c.line")
    repos = raw.select(F.col("caller_fqn").alias("src"), "repo_id").distinct()
    calls = resolve_calls(raw.drop("repo_id"), names, imported.where("alias is not null")).join(repos, "src")
    # Of repeated calls the earliest line stays.
    calls = calls.groupBy("src", "dst", "repo_id").agg(F.min_by(F.struct("line", "confidence", "resolved"), "line").alias("v")).select("src", "dst", "repo_id", "v.line", "v.confidence", "v.resolved")
    e = parsed.select(*of, F.explode("endpoints").alias("e")).select("e.path", "e.http_method", "repo_id", "e.handler_fqn", "language", F.col("path").alias("file"), "e.line")
    r = parsed.select(*of, F.explode("route_calls").alias("r")).select("r.source_method_fqn", "r.path", "r.http_method", "repo_id", "r.confidence", "r.line", F.col("path").alias("source_file"))
    package = imports.where("dst_label = 'Package'").select(F.col("dst").alias("name"), "repo_id").distinct()
    # Edges that are there only if the method is.
    method = m.select(F.col("fqn").alias("src"), "repo_id").distinct()
    handles = e.select(F.col("handler_fqn").alias("src"), "path", "http_method", "repo_id").distinct().join(method, ["src", "repo_id"], "left_semi")
    makes = r.select(F.col("source_method_fqn").alias("src"), "path", "http_method", "repo_id").distinct().join(method, ["src", "repo_id"], "left_semi")
    edge = lambda df, a, src, b, dst: df.select(F.lit(a).alias("src_label"), src.alias("src"), F.lit(b).alias("dst_label"), dst.alias("dst"), "repo_id")
    contains = edge(file, "Folder", parent, "File", F.col("path")).unionByName(edge(c, "File", F.col("file"), "Class", F.col("fqn")))
    contains = contains.unionByName(edge(m.where("class_fqn is not null"), "Class", F.col("class_fqn"), "Method", F.col("fqn"))).unionByName(edge(m.where("class_fqn is null"), "File", F.col("file"), "Method", F.col("fqn"))).distinct()
    return {"file": file, "folder": folder, "class_": c, "method": m.drop("calls"), "package": package, "imports": imports, "calls": calls, "endpoint": e, "route_call": r, "contains": contains, "handles": handles, "makes_call": makes}


def sync(store: Snapshots, files: DataFrame, prefix: str | None = None) -> dict:
    """Parses files whose checksum changed and merges their tables, in one batch. Reruns change nothing.

    What the changed files held before goes first: their rows, the calls that start there, and every edge that touches a name
    which is gone. Returns the tables written and how many names were added, removed and updated, and how many edges are new.
    """
    nothing = {"tables": [], "nodes_added": 0, "nodes_removed": 0, "nodes_updated": 0, "edges_added": 0}
    with store.batch():
        fresh = changed_files(files, store.read("file"))
        store.write("parsed", parse_files(fresh))
        parsed = store.read("parsed")
        if parsed.isEmpty():
            return nothing
        old = {name: store.read(name) for name in KEYS}
        stored, types = old["method"], old["class_"]
        known = stored.select("fqn").unionByName(types.select("fqn")) if stored is not None and types is not None else None
        tables = graph_tables(parsed, known, prefix, old["file"])
        gone = parsed.select(F.col("path").alias("file"), "repo_id").distinct()
        names = lambda c, m: c.select("fqn", "repo_id", "file").unionByName(m.select("fqn", "repo_id", "file"))
        now = names(tables["class_"], tables["method"])
        before = names(types, stored).join(gone, ["file", "repo_id"], "left_semi") if known is not None else now.limit(0)
        change = sync_diff(before, now)
        tally = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
        places = {"class_": "file", "method": "file", "imports": "src", "endpoint": "file", "route_call": "source_file"}
        for name, at in places.items():
            if old[name] is not None:
                store.write(name, old[name].join(gone.withColumnRenamed("file", at), [at, "repo_id"], "left_anti"))
        if stored is not None:
            # Edges that start at the changed files' methods come again; those that touch a removed name don't.
            dead = before.select(F.col("fqn").alias("src"), "repo_id").distinct()
            removed = change.where("change = 'removed'").select("fqn")
            for name in ("calls", "handles", "makes_call", "contains"):
                if old[name] is not None:
                    left = old[name].join(dead, ["src", "repo_id"], "left_anti")
                    store.write(name, detach(stored, [left], removed)[1][0] if "dst" in left.columns else left)
        edges = [(name, KEYS[name]) for name in ("calls", "imports", "handles", "makes_call", "contains")]
        new_edges = sum(tables[n].join(old[n], list(k), "left_anti").count() if old[n] is not None else tables[n].count() for n, k in edges)
        for name in tables:
            store.merge(name, tables[name])
    return nothing | {"tables": list(tables), "edges_added": new_edges} | {f"nodes_{k}": tally.get(k, 0) for k in ("added", "removed", "updated")}


__all__ = ["graph_tables", "import_rows", "stitch", "sync"]
