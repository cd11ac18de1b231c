"""Scalar functions of the graph library, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of entry points and prefixes that are never dead, and marks of database access.
ENTRY_POINTS = ("main", "__init__", "__new__", "__str__", "__repr__", "setUp", "tearDown", "setUpClass", "tearDownClass")
LIVE_PREFIXES = ("test_", "handle", "on_")
DB_MARKS = ("SELECT", "INSERT", "UPDATE", "DELETE", "query(", "execute(")


def fqn(*parts: Column) -> Column:
    """Non-empty parts joined by dots."""
    return F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))


def contains(c: Column | str, text: str) -> Column:
    return F.contains(F.col(c) if isinstance(c, str) else c, F.lit(text))


def optional_prefix(df, column: str, prefix: str):
    return df.where(F.col(column).startswith(prefix)) if prefix else df


def is_db_interaction(source: Column) -> Column:
    s = F.coalesce(source, F.lit(""))
    out = F.lit(False)
    for mark in DB_MARKS:
        out = out | F.contains(s, F.lit(mark))
    return out


#: How frameworks and clients write a path parameter. Braces come first: they may hold any of the others.
PARAM_STYLES = {"braces, with a dollar sign in templates": r"\$?\{[^}]+\}", "square brackets": r"\[[^\]]+\]", "a colon and a name": r":[A-Za-z_]\w*"}


def normal_params(path: Column) -> Column:
    """Every way to write a path parameter becomes {param}, one style after the other."""
    for style in PARAM_STYLES.values():
        path = F.regexp_replace(path, style, "{param}")
    return path


def route_path(path: Column) -> Column:
    p = F.trim(path)
    return F.when(p == "", F.lit("/")).when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def join_paths(prefix: Column, path: Column) -> Column:
    a, b = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", ""), F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", "")
    return route_path(F.when(b == "", a).otherwise(F.concat(a, F.lit("/"), b)))


def effort(points: Column) -> Column:
    return F.when(points < 10, "LOW").when(points < 50, "MEDIUM").when(points < 200, "HIGH").otherwise("VERY HIGH")


def mermaid_id(c: Column) -> Column:
    """Letters, digits and underscores; whatever else a name holds becomes one underscore a character, none at its ends."""
    out = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.when(out == "", F.lit("node")).otherwise(out)


def pascal_case(c: Column) -> Column:
    """Upper first letters, the rest as it is; Feature where nothing is left."""
    words = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.when(out == "", F.lit("Feature")).otherwise(out)


def class_of_fqn(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(F.lit("Subject"))
