"""Command line: ``python -m emberleaf FOLDER VERB ...``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from emberleaf.plans.config import Config
from emberleaf.plans.engine import MemoryEngine


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="emberleaf")
    p.add_argument("root", help="the engine's folder")
    p.add_argument("--source", action="append", default=[], metavar="LABEL=FOLDER")
    p.add_argument("--pattern", default="*.md")
    p.add_argument("--now", type=float, default=None, help="seconds since the epoch")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("scan")
    sub.add_parser("run").add_argument("--dry-run", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--after")
    s.add_argument("--before")
    for verb in ("recall", "pin", "remove"):
        sub.add_parser(verb).add_argument("artifact_id")
    c = sub.add_parser("context")
    c.add_argument("query")
    c.add_argument("--budget", type=int, default=128_000)
    i = sub.add_parser("ingest")
    i.add_argument("content")
    i.add_argument("--label", default="note")
    sub.add_parser("status")
    for verb in ("verify", "index-stats", "store-stats", "init", "reindex"):
        sub.add_parser(verb)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("emberleaf").getOrCreate()
    now = time.time() if a.now is None else a.now
    engine = MemoryEngine(spark, a.root, Config(sources=dict(x.split("=", 1) for x in a.source), pattern=a.pattern))
    if a.verb == "init":
        engine.save_config()
        return
    if not a.source and (kept := engine.saved_config()):
        engine.config = kept
    if a.verb == "scan":
        from emberleaf.sources import files

        for label, path in engine.config.sources.items():
            r = files.count(files.scan(spark, path, engine.config.pattern)).first()
            print(f"{label}: {r['n']} files, {r['bytes']} bytes")
    elif a.verb == "run":
        print(engine.run(now, a.dry_run))
    elif a.verb == "search":
        engine.search(a.query, a.limit, a.after, a.before).show(a.limit, truncate=100)
    elif a.verb == "recall":
        for r in engine.recall(a.artifact_id, now).collect():
            print(r["content"] if r["status"] == "ok" else r["status"])
    elif a.verb == "context":
        print(engine.context(a.query, now, a.budget).first()["context"])
    elif a.verb == "ingest":
        print(engine.ingest(a.content, a.label, now))
    elif a.verb == "reindex":
        print(engine.reindex())
    elif a.verb in ("pin", "remove"):
        getattr(engine, a.verb)(a.artifact_id)
    else:
        getattr(engine, a.verb.replace("-", "_"))().show(truncate=False)


if __name__ == "__main__":
    main()
