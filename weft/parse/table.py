"""Parsing as a table function: one row a source file with its parts as nested arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weft.parse import routes, scan

PARTS = (
    "path string, relative string, language string, repo_id string, checksum string, module_name string, error string, "
    "classes array<struct<name:string,line:int,fqn:string,methods:array<string>,is_interface:boolean,is_abstract:boolean>>, "
    "methods array<struct<name:string,line:int,class_name:string,fqn:string,signature:string,source_code:string,calls:array<struct<callee_name:string,line:int>>>>, "
    "imports array<string>, endpoints array<struct<path:string,http_method:string,handler_fqn:string,line:int>>, "
    "route_calls array<struct<source_method_fqn:string,path:string,http_method:string,confidence:double,line:int>>"
)


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, language, repo_id, checksum, content (binary), and relative, the path from the repository's root, which names
    the module (the path itself where it is missing). Rows without a language or content have no parts.

    No shuffle; a task holds one Arrow batch of files. Bytes that aren't UTF-8 are replaced.
    """
    if "relative" not in files.columns:
        files = files.withColumn("relative", F.col("path"))
    schema = to_arrow_schema(_parse_datatype_string(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, language = (r["content"] or b"").decode("utf-8", "replace").replace("\x00", " "), r["language"]
                parts = scan.parse(r["relative"] or r["path"] or "", text, language) if language else {"module_name": None, "classes": [], "methods": [], "imports": [], "error": None}
                found = {"endpoints": routes.endpoints(text, language, parts), "route_calls": routes.route_calls(text, language, parts)}
                out.append({k: r[k] for k in ("path", "relative", "language", "repo_id", "checksum")} | parts | found)
            yield from pa.Table.from_pylist(out, schema=schema).combine_chunks().to_batches()

    return files.select("path", "relative", "language", "repo_id", "checksum", "content").mapInArrow(run, PARTS)
