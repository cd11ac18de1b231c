"""Bounded path patterns: trails (an edge occurs once in a path) and reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import Scratch

MAX_DEPTH = 10


def safe_depth(depth: int, default: int) -> int:
    return default if depth < 1 else min(depth, MAX_DEPTH)


def trails(edges: DataFrame, roots: Column | None, depth: int, *, reverse: bool = False, min_product: float | None = None) -> DataFrame:
    """One row a trail of 1..depth edges: root, node, depth, conf (the product), trail (its edges in text form).

    edges: src, dst, confidence, one row an edge (a multigraph needs an ``edge`` column that tells parallel edges apart).
    Unrolled joins instead of recursion: no limit on rows, and each step is planned on its own size. A product bound
    prunes inside the loop, since no factor is above one.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    mark = F.col("edge") if "edge" in edges.columns else F.concat_ws("\x01", "src", "dst")
    e = edges.select(F.col(a).alias("from_"), F.col(b).alias("to_"), F.col("confidence").alias("c_"), mark.alias("edge_"))
    start = e.where(roots) if roots is not None else e
    front = start.select(F.col("from_").alias("root"), F.col("to_").alias("node"), F.lit(1).alias("depth"), F.col("c_").alias("conf"), F.array("edge_").alias("trail"))
    bound = (lambda d: d) if min_product is None else (lambda d: d.where(F.col("conf") >= min_product))
    out = [front := bound(front)]
    for k in range(2, depth + 1):
        step = front.join(e, F.col("node") == F.col("from_")).where(~F.array_contains("trail", F.col("edge_")))
        front = bound(step.select("root", F.col("to_").alias("node"), F.lit(k).alias("depth"), (F.col("conf") * F.col("c_")).alias("conf"), F.array_append("trail", F.col("edge_")).alias("trail")))
        out.append(front)
    return reduce(DataFrame.unionByName, out)


def shallowest(scratch: Scratch, edges: DataFrame, names: DataFrame, roots: Column, depth: int, most: int) -> DataFrame:
    """trails() joined with names (node, ...), two levels at a time until ``most`` rows are found: for tools that show the shallowest ones.

    Levels are stored in the shared folder, so the next ones start from their rows instead of planning all joins before them again,
    and the trails of levels that nobody would see are never built.
    """
    found, shown, k = [], 0, 0
    while k < depth:
        if k:
            last = found[-1].where(F.col("depth") == k)
            more = _step(last, edges, k + 1)
            levels = more.unionByName(_step(more, edges, k + 2)) if k + 2 <= depth else more
        else:
            levels = trails(edges, roots, min(2, depth))
        k = min(k + 2, depth)
        found.append(scratch.keep(levels, f"levels-{k}"))
        if k < depth:
            shown += found[-1].join(names, "node", "left_semi").limit(most).count()
            if shown >= most:
                break
    return reduce(DataFrame.unionByName, found).join(names, "node")


def _step(front: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Trails one edge longer than those of front."""
    e = edges.select(F.col("src").alias("from_"), F.col("dst").alias("to_"), F.col("confidence").alias("c_"), F.concat_ws("\x01", "src", "dst").alias("edge_"))
    step = front.join(e, F.col("node") == F.col("from_")).where(~F.array_contains("trail", F.col("edge_")))
    return step.select("root", F.col("to_").alias("node"), F.lit(k).alias("depth"), (F.col("conf") * F.col("c_")).alias("conf"), F.array_append("trail", F.col("edge_")).alias("trail"))


def _steps(edges: DataFrame, depth: int) -> DataFrame:
    """(root, node) within 1..depth distinct edges, repeats among levels left in: each level is distinct."""
    e = edges.select(F.col("src").alias("from_"), F.col("dst").alias("to_"))
    front = e.select(F.col("from_").alias("root"), F.col("to_").alias("node"))
    found = [front]
    for _ in range(depth - 1):
        front = front.join(e, F.col("node") == F.col("from_")).select("root", F.col("to_").alias("node")).distinct()
        found.append(front)
    return reduce(DataFrame.unionByName, found)


def reachable(edges: DataFrame, depth: int) -> DataFrame:
    """Distinct (root, node) within 1..depth edges: the frontier is made distinct at every step, so it can't blow up."""
    return _steps(edges.select("src", "dst").distinct(), depth).distinct()


def on_cycle(edges: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """Nodes on a closed walk of 2..depth edges without repeating an edge: (node).

    A shortest closed walk through a node repeats no edge; a loop on the node itself is not one, but two
    passages through parallel loops would need two edges, so loops are left out and counted by their number.
    """
    loops = edges.where("src = dst").groupBy(F.col("src").alias("node")).count().where("count > 1").select("node")
    return leading_back(edges, depth - 1, scratch).select(F.col("src").alias("node")).unionByName(loops).distinct()


def trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Distinct edges without loops, less those that no cycle can hold: from nodes nothing leads to, or into nodes that lead nowhere."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    for _ in range(rounds):
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return e


def leading_back(edges: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """Edges (src, dst), src <> dst, whose dst leads back to src within depth edges.

    The way back is cut in the middle: forward steps from dst and backward steps from src meet, and only for pairs that are edges, so
    no step goes from every root to its full reach. With a scratch folder the trimmed edges are stored: every step reads them.
    """
    e = trimmed(edges, 2)
    e = scratch.keep(e, "trimmed") if scratch else e
    ahead, behind = depth - depth // 2, depth // 2
    here = e.select(F.col("dst").alias("root"), F.col("dst").alias("node"))
    forward = (here.unionByName(_steps(e, ahead)) if ahead else here).distinct().withColumnRenamed("node", "meet")
    back = e.select(F.col("src").alias("root"), F.col("src").alias("node"))
    back = (back.unionByName(_steps(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), behind)) if behind else back).distinct().withColumnRenamed("root", "end")
    ways = e.join(forward, F.col("dst") == F.col("root")).join(back, (F.col("src") == F.col("end")) & (F.col("meet") == F.col("node")), "left_semi")
    return ways.select("src", "dst").distinct()
