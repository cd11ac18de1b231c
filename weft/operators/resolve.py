"""Call resolution: callee texts to fully-qualified names, as equi-joins against exploded suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suffix_index(known: DataFrame) -> DataFrame:
    """(suffix, candidates, pick) for every dotted proper suffix of every known name; pick is the smallest name."""
    parts = F.split("fqn", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    d = known.select("fqn").distinct()
    return d.where(F.contains("fqn", F.lit("."))).select("fqn", F.explode(tails).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("candidates"), F.min("fqn").alias("pick"))


def resolve_calls(raw: DataFrame, known: DataFrame, imports: DataFrame) -> DataFrame:
    """raw: file, caller_fqn, callee_name, line. known: fqn. imports: file, alias, origin.

    The first rung that holds: the exact name 1.0; a suffix 1.0 if unique, else 0.7; the suffix without the first
    receiver 0.9; a receiver that is imported 0.7, the text as it is; else unresolved.<text> 0.2.
    """
    names = known.select(F.col("fqn").alias("exact")).distinct()
    ix = suffix_index(known)
    one = ix.select(F.col("suffix").alias("callee_name"), F.col("candidates").alias("n1"), F.col("pick").alias("p1"))
    two = ix.select(F.col("suffix").alias("bare"), F.col("pick").alias("p2"))
    im = imports.select("file", F.col("alias").alias("receiver")).distinct().withColumn("imported", F.lit(True))
    dotted = F.contains("callee_name", F.lit("."))
    c = raw.withColumn("bare", F.when(dotted, F.regexp_replace("callee_name", r"^[^.]*\.", ""))).withColumn("receiver", F.when(dotted, F.substring_index("callee_name", ".", 1)))
    c = c.join(names, F.col("callee_name") == F.col("exact"), "left").join(one, "callee_name", "left").join(two, "bare", "left").join(im, ["file", "receiver"], "left")
    rung = (
        F.when(F.col("exact").isNotNull(), F.struct(F.col("exact").alias("dst"), F.lit(1.0).alias("confidence")))
        .when(F.col("p1").isNotNull(), F.struct(F.col("p1").alias("dst"), F.when(F.col("n1") == 1, 1.0).otherwise(0.7).alias("confidence")))
        .when(F.col("p2").isNotNull(), F.struct(F.col("p2").alias("dst"), F.lit(0.9).alias("confidence")))
        .when(F.col("imported"), F.struct(F.col("callee_name").alias("dst"), F.lit(0.7).alias("confidence")))
        .otherwise(F.struct(F.concat(F.lit("unresolved."), F.col("callee_name")).alias("dst"), F.lit(0.2).alias("confidence")))
    )
    return c.withColumn("r", rung).select(F.col("caller_fqn").alias("src"), "r.dst", "callee_name", "line", "r.confidence", (F.col("r.confidence") > 0.2).alias("resolved"))
