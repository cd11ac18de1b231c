"""Texts made from the graph: feature skeletons, test skeletons, and files written only if their syntax holds."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.functions.text import class_of_fqn, pascal_case
from weft.operators.graph import Graph
from weft.operators.ingest import sync
from weft.operators.store import Snapshots
from weft.parse.languages import language_of
from weft.parse.scan import problems
from weft.plans import tools
from weft.sources.git import head
from weft.sources.repo import language

#: Backend and frontend of each stack: language, file and text; NAME, Name and name stand for the feature.
STACKS = {
    "fastapi+react": (
        ("python", "backend/name_api.py", 'from fastapi import APIRouter\n\nrouter = APIRouter()\n\n\n@router.get("/name")\ndef list_name() -> list[dict]:\n    return []\n\n\n@router.post("/name")\ndef create_name(body: dict) -> dict:\n    return body\n'),
        ("typescript", "frontend/Name.tsx", 'export async function loadName() {\n  const answer = await fetch("/name");\n  return answer.json();\n}\n'),
    ),
    "spring+react": (
        ("java", "backend/NameController.java", '@RestController\n@RequestMapping("/name")\npublic class NameController {\n    @GetMapping("/")\n    public List<Object> list() {\n        return List.of();\n    }\n}\n'),
        ("typescript", "frontend/Name.tsx", 'export async function loadName() {\n  const answer = await fetch("/name");\n  return answer.json();\n}\n'),
    ),
    "express+react": (
        ("typescript", "backend/nameRoutes.ts", 'import { Router } from "express";\n\nexport const router = Router();\n\nrouter.get("/name", (request, response) => {\n  response.json([]);\n});\n'),
        ("typescript", "frontend/Name.tsx", 'export async function loadName() {\n  const answer = await fetch("/name");\n  return answer.json();\n}\n'),
    ),
}


def scaffold(g: Graph, feature: str, stack: str = "fastapi+react") -> dict:
    """Files of a new feature, with how many endpoints of the backend's language the graph already holds (five at most)."""
    if stack not in STACKS:
        return {"error": f"no such stack: {stack}; there are {', '.join(sorted(STACKS))}"}
    names = g.file.sparkSession.range(1).select(pascal_case(F.lit(feature)).alias("pascal"))
    words = [w for w in "".join(c if c.isalnum() else " " for c in feature).split()] or ["feature"]
    pascal, snake = names.first().pascal, "_".join(w.lower() for w in words)
    fill = lambda s: s.replace("Name", pascal).replace("name", snake)
    known = tools.scaffold_patterns(g, STACKS[stack][0][0]).limit(5).count()
    return {"feature": pascal, "stack": stack, "patterns_found": known, "files": [{"language": lang, "path": fill(path), "content": fill(text)} for lang, path, text in STACKS[stack]]}


def test_suite(g: Graph, fqn: str) -> dict:
    """A test skeleton for a method with its callees (20 at most) mocked: pytest, or jest for TypeScript and JavaScript."""
    row = g.method.where(F.col("fqn") == fqn).orderBy("file", "line").first()
    if row is None:
        return {"error": f"no such method: {fqn}"}
    owner = g.method.sparkSession.range(1).select(class_of_fqn(F.lit(fqn)).alias("owner")).first().owner
    callees = [r.dst for r in g.calls.where(F.col("src") == fqn).select("dst").distinct().orderBy("dst").limit(20).collect()]
    if row.language in ("typescript", "javascript"):
        mocks = "".join(f'  // mock: {c}\n' for c in callees)
        text = f'describe("{owner}.{row.name}", () => {{\n{mocks}  it("works", () => {{\n    expect(true).toBe(true);\n  }});\n}});\n'
        return {"framework": "jest", "dependencies": callees, "content": text}
    mocks = "".join(f'    # mock: {c}\n' for c in callees)
    text = f"import pytest\n\n\ndef test_{row.name}_works():\n{mocks}    pytest.skip(\"arrange, act and assert on {fqn}\")\n"
    return {"framework": "pytest", "dependencies": callees, "content": text}


def safe_write(spark: SparkSession, store: Snapshots, path: str, content: str, repo_id: str = "default", root: str | None = None) -> dict:
    """Checks the syntax, writes the file on the driver and syncs the graph; a text with problems is not written."""
    found = problems(content, language_of(path))
    if found:
        return {"success": False, "file_path": path, "message": "not written: the syntax check failed", "syntax_errors": found, "graph_updated": False}
    Path(path).write_text(content, encoding="utf-8")
    done = sync_file(spark, store, path, repo_id, root)
    return {"success": True, "file_path": path, "message": "written", "syntax_errors": [], "graph_updated": bool(done["tables"])}


def sync_file(spark: SparkSession, store: Snapshots, path: str, repo_id: str = "default", root: str | None = None) -> dict:
    """Syncs one file. root: the repository's, which names its module; without one that of the stored files of the repository."""
    one = spark.read.format("binaryFile").load(path).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    if root is None and (known := store.read("file")) is not None:
        root = known.where(F.col("repo_id") == repo_id).agg(F.max(F.expr("left(path, length(path) - length(relative))"))).first()[0]
    below = F.lit(root.rstrip("/") + "/") if root else F.lit("/")
    relative = F.when(F.startswith("path", below), F.expr(f"substring(path, {len(root.rstrip('/')) + 2 if root else 2})")).otherwise(F.col("path"))
    one = one.select("path", relative.alias("relative"), language(F.col("path")).alias("language"), F.lit(repo_id).alias("repo_id"), F.sha2("content", 256).alias("checksum"), "content")
    done = sync(store, one.where("language is not null"))
    return {"file_path": path} | done | {"git_sha": head(str(Path(path).parent))}
