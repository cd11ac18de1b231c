"""python -m weft ingest|stitch|status|reset|watch|health|serve|tokens: the store from the command line."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from weft.operators.ingest import stitch, sync
from weft.operators.stitch import tallies
from weft.operators.store import KEYS, Snapshots
from weft.plans import serve
from weft.session import local_session
from weft.sources.repo import source_files
from weft.streaming.watch import watch


def main(argv: list[str] | None = None, spark=None) -> dict:
    p = argparse.ArgumentParser(prog="weft", description=__doc__)
    p.add_argument("command", choices=["ingest", "stitch", "status", "reset", "watch", "health", "serve", "tokens"])
    p.add_argument("--root", default=os.environ.get("WEFT_ROOT"), help="folder of sources (or WEFT_ROOT)")
    p.add_argument("--store", default=os.environ.get("WEFT_STORE"), help="folder of the stored graph (or WEFT_STORE)")
    p.add_argument("--repo-id", default=os.environ.get("WEFT_REPO_ID", "default"))
    p.add_argument("--prefix", default=os.environ.get("WEFT_PREFIX"), help="dotted root of internal modules (or WEFT_PREFIX)")
    p.add_argument("--checkpoint")
    p.add_argument("--port", type=int, default=8700)
    p.add_argument("--yes", action="store_true", help="confirms a reset")
    a = p.parse_args(argv)
    if not a.store:
        p.error("--store or WEFT_STORE is needed")
    spark = spark or local_session(8, "weft")
    store, out = Snapshots(spark, a.store), {}
    if a.command in ("ingest", "watch") and not a.root or a.command == "watch" and not a.checkpoint:
        p.error("ingest and watch need --root, watch needs --checkpoint")
    if a.command == "ingest":
        out = sync(store, source_files(spark, a.root, a.repo_id), a.prefix)
    elif a.command == "watch":
        watch(spark, a.root, store, a.checkpoint, a.repo_id).awaitTermination()
    elif a.command == "stitch":
        calls, ends = store.read("route_call"), store.read("endpoint")
        if calls is not None and ends is not None:
            found = stitch(calls.where(calls.repo_id == a.repo_id), ends.where(ends.repo_id == a.repo_id))
            before = store.read("routes_to")
            out = tallies(calls.where(calls.repo_id == a.repo_id), found, before).first().asDict()
            store.merge("routes_to", found.withColumn("repo_id", F.lit(a.repo_id)))
    elif a.command == "status":
        out = {t: df.where(df.repo_id == a.repo_id).count() for t in KEYS if (df := store.read(t)) is not None and "repo_id" in df.columns}
    elif a.command == "health":
        out = serve.health(store)
    elif a.command == "serve":
        serve.run(spark, store, a.port)
    elif a.command == "tokens":
        out = serve.context_tokens(serve.stored_graph(store)).first().asDict()
    elif a.yes:
        store.reset(a.repo_id)
        out = {"reset": a.repo_id}
    else:
        p.error("reset needs --yes")
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
