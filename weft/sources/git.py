"""History of one file and the current commit, asked of git on the driver: a handful of rows, not distributed."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _git(folder: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def history(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """nth, commit, message of the last commits of a file; no rows outside a repository."""
    out = _git(str(Path(path).parent), "log", "--oneline", f"-{most}", "--", Path(path).name) or ""
    rows = [(i, *(line.split(" ", 1) + [""])[:2]) for i, line in enumerate(out.splitlines(), 1)]
    return spark.createDataFrame(rows, "nth int, commit string, message string")


def head(folder: str) -> str:
    """The first eight characters of the current commit, or unknown."""
    return (_git(folder, "rev-parse", "HEAD") or "unknown").strip()[:8]
