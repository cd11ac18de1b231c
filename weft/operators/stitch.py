"""Route stitching: outgoing calls to endpoints, exact paths first, then paths with their parameters made alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import normal_params


def stitch(route_calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """source_method_fqn, rc_path, http_method, endpoint_path, match_type, confidence; two hash joins."""
    c = route_calls.select("source_method_fqn", F.col("path").alias("rc_path"), F.upper("http_method").alias("http_method"))
    e = endpoints.select(F.col("path").alias("endpoint_path"), F.upper("http_method").alias("http_method")).distinct()
    exact = c.join(e, (c.rc_path == e.endpoint_path) & (c.http_method == e.http_method)).drop(e.http_method).select("source_method_fqn", "rc_path", "http_method", "endpoint_path", F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence"))
    rest = c.join(e.select(F.col("endpoint_path").alias("rc_path"), "http_method"), ["rc_path", "http_method"], "left_anti").withColumn("norm", normal_params(F.col("rc_path")))
    near = rest.join(e.withColumn("norm", normal_params(F.col("endpoint_path"))), ["norm", "http_method"])
    near = near.select("source_method_fqn", "rc_path", "http_method", "endpoint_path", F.lit("parameterized").alias("match_type"), F.lit(0.7).alias("confidence"))
    return exact.unionByName(near).distinct()


def tallies(route_calls: DataFrame, found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row: calls with exact and with parameterised matches, calls without any, and edges that are new."""
    key = ["source_method_fqn", "rc_path", "http_method"]
    calls = route_calls.select("source_method_fqn", F.col("path").alias("rc_path"), F.upper("http_method").alias("http_method")).distinct()
    kinds = found.groupBy(*key).agg(F.max(F.col("match_type") == "exact").alias("exact"))
    out = calls.join(kinds, key, "left").agg(
        F.count_if(F.col("exact")).alias("exact_matches"), F.count_if(~F.col("exact")).alias("param_matches"), F.count_if(F.col("exact").isNull()).alias("unmatched_calls"),
    )
    fresh = new_edges(found, existing) if existing is not None else found
    return out.crossJoin(fresh.agg(F.count("*").alias("total_edges_created")))


def new_edges(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges that a second run would not create again."""
    return found.join(existing, ["source_method_fqn", "rc_path", "http_method", "endpoint_path"], "left_anti")
