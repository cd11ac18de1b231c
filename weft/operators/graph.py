"""The property graph as tables: one DataFrame per node label and edge type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """Containment is stored in the children: a method's class (or null) and file, a class's file."""

    file: DataFrame
    class_: DataFrame
    method: DataFrame
    calls: DataFrame
    imports: DataFrame
    endpoint: DataFrame
    route_call: DataFrame
    routes_to: DataFrame

    def nodes(self) -> DataFrame:
        """All labelled nodes with their label-specific columns, null where a label lacks one."""
        pick = lambda df, label, **cols: df.select(F.lit(label).alias("node_type"), *(F.expr(v).alias(k) for k, v in cols.items()))
        parts = [
            pick(self.class_, "Class", identifier="fqn", name="name", path="cast(null as string)", file="file", line="line"),
            pick(self.method, "Method", identifier="coalesce(fqn, name)", name="name", path="cast(null as string)", file="file", line="line"),
            pick(self.file, "File", identifier="path", name="cast(null as string)", path="path", file="path", line="cast(null as int)"),
            pick(self.endpoint, "Endpoint", identifier="path", name="cast(null as string)", path="path", file="cast(null as string)", line="cast(null as int)"),
            pick(self.imports.where("dst_label = 'Package'").select("dst").distinct(), "Package", identifier="dst", name="dst", path="cast(null as string)", file="cast(null as string)", line="cast(null as int)"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def handled(self) -> DataFrame:
        """Endpoints with the method that handles them; endpoints without a stored method don't appear."""
        m = self.method.select(F.col("fqn").alias("handler_fqn"), F.col("name").alias("handler_name"), "language", "file", "line")
        return self.endpoint.join(m, "handler_fqn")
