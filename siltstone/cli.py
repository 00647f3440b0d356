"""Command line: ``python -m siltstone.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

from siltstone.functions import embedding
from siltstone.functions.filters import LANGUAGES, Filter
from siltstone.service import Service
from siltstone.sources.fleet import Fleet, store_dirs
from siltstone.sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("-s", "--store", action="append", default=[], help="store directory; repeat to read several")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index", help="bring a store up to date")
    c.add_argument("paths", nargs="*", default=["."])
    c.add_argument("-m", "--model")
    c.add_argument("-q", "--quiet", action="store_true")
    c = sub.add_parser("watch", help="keep a store up to date")
    c.add_argument("paths", nargs="*", default=["."])
    c.add_argument("-q", "--quiet", action="store_true")
    c.add_argument("--debounce", type=int, default=500, help="milliseconds without a change that close a batch")
    c = sub.add_parser("search", help="search stores")
    c.add_argument("query")
    c.add_argument("-k", type=int, default=8)
    for short, name in (("-p", "--path"), ("-e", "--ext"), ("-l", "--lang")):
        c.add_argument(short, name, action="append", default=[])
    c.add_argument("--json", action="store_true")
    sub.add_parser("stats", help="what stores hold")
    sub.add_parser("files", help="indexed files")
    c = sub.add_parser("forget", help="drop a file from a store")
    c.add_argument("path")
    sub.add_parser("mcp", help="serve the stores as tools on standard input and output")
    sub.add_parser("models", help="embedding models")
    sub.add_parser("languages", help="language names and their extensions")
    return p


def shown(path: str) -> str:
    """A path below the working directory without it, any other as it is."""
    here = os.path.relpath(path)
    return path if here.startswith("..") else here


def listing(hits, labels) -> str:
    """Ranked places with scores, each with its excerpt, and where there are several stores how many each has given."""
    parts = []
    for rank, h in enumerate(hits, 1):
        at = f"{shown(h['path'])}, lines {h['start_line']} to {h['end_line']}" + (f" in {h['store']}" if h["store"] else "")
        parts.append(f"{rank:>3}  {h['score']:.4f}  {at}\n" + "".join(f"     {line}\n" for line in h["text"].split("\n")))
    if len(labels) > 1:
        count = {n: sum(h["store"] == n for h in hits) for n in labels}
        parts.append("by store: " + ", ".join(f"{n} {c}" for n, c in count.items()) + "\n")
    return "\n".join(parts)


@contextmanager
def stopped_by_signals():
    """An event that an interrupt or a request to end sets, instead of ending the program."""
    asked = threading.Event()
    before = {}
    if threading.current_thread() is threading.main_thread():
        before = {s: signal.signal(s, lambda *_: asked.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield asked
    finally:
        for s, old in before.items():
            signal.signal(s, old)


def as_json(hits) -> str:
    rows = [{k: v for k, v in h.asDict().items() if k != "similarity" and not (k == "store" and v is None)} for h in hits]
    return json.dumps(rows, indent=2, ensure_ascii=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "models":
        print("\n".join(f"{m}{' (default)' if m == embedding.DEFAULT else ''}" for m in embedding.models()))
        return 0
    if a.command == "languages":
        print("\n".join(f"{k}: {', '.join(v)}" for k, v in LANGUAGES.items()))
        return 0
    narrowed = Filter.of(a.path, a.ext, a.lang) if a.command == "search" else Filter()
    dirs = store_dirs(a.store)
    writes = a.command in ("index", "watch", "forget")
    if writes and len(dirs) > 1:
        print("a store has one writer: name one --store", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("siltstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "index":
            say = None if a.quiet else (lambda text: print(text, file=sys.stderr))
            with stopped_by_signals() as asked:
                r = Store(spark, dirs[0], a.model).index(a.paths, progress=say, stop=asked.is_set)
            if not a.quiet:
                print(f"{r.indexed} indexed, {r.unchanged} unchanged, {r.skipped} skipped, {r.removed} removed ({r.chunks} chunks)" + (f", {r.remaining} left" if r.remaining else ""), file=sys.stderr)
        elif a.command == "watch":
            from siltstone.streaming.watch import Event, watch

            def tell(e: Event) -> None:
                if e.kind == "error" or not a.quiet:
                    print(f"{e.kind}: {e.report.indexed} indexed, {e.report.removed} removed" if e.report else f"{e.kind} {e.message}".strip(), file=sys.stderr)

            with stopped_by_signals() as asked:
                w = watch(Store(spark, dirs[0]), a.paths, os.path.join(os.path.realpath(dirs[0]), "watch"), tell, a.debounce / 1000)
                while not asked.wait(1.0):
                    if w.query.exception() is not None:
                        tell(Event("error", message=str(w.query.exception())[:500]))
                        break
                w.stop()
        elif a.command == "forget":
            print(f"{Store.open_existing(spark, dirs[0]).forget(a.path)} chunks removed")
        else:
            fleet = Fleet(spark, dirs)
            if a.command == "search":
                hits = [] if narrowed and not fleet.matching_files(narrowed) else fleet.search(a.query, a.k, narrowed).collect()  # k rows
                print(as_json(hits) if a.json else listing(hits, fleet.labels), end="\n" if a.json else "")
            elif a.command == "stats":
                for label, s in fleet.stats():
                    print(f"{label}: {s['files']} files, {s['chunks']} chunks, {s['bytes']} bytes, model {s['model']} ({s['dim']} dim)")
            elif a.command == "files":
                for s in fleet.stores:
                    for row in s.matching_paths(Filter()).toLocalIterator():
                        print(row["path"])
            elif a.command == "mcp":
                Service(fleet).serve()
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(f"siltstone: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
