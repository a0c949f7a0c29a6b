"""python -m quillspark {index,ingest,query,files,open,stats,self-check,watch} --repo DIR ..."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("quillspark")
    p.add_argument("command", choices=("index", "ingest", "query", "files", "open", "stats", "self-check", "watch"))
    p.add_argument("words", nargs="*")
    p.add_argument("--repo", default=".")
    p.add_argument("--limit", type=int)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--exclude-dir", action="append", default=[])
    p.add_argument("--exclude-prefix", action="append", default=[])
    p.add_argument("--state-dir", default=".quillspark")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from quillspark.api import Engine

    e = Engine(SparkSession.builder.getOrCreate(), a.repo, a.exclude_dir, a.exclude_prefix, a.state_dir)
    run = {"index": e.index, "ingest": lambda: e.ingest(a.words), "query": lambda: e.respond(" ".join(a.words), a.limit, surface="cli"), "files": lambda: e.files(a.limit or 200, a.offset), "open": lambda: e.open(a.words[0], *map(int, a.words[1:3])), "stats": e.stats, "self-check": lambda: e.self_check(a.words), "watch": lambda: e.watch(a.words[0] if a.words else str(e.state / "watch")).awaitTermination()}
    try:
        out = run[a.command]()
    finally:
        e.store.release()
    print(json.dumps(out, indent=2, default=str))
    return int(a.command == "self-check" and bool(out))


if __name__ == "__main__":
    sys.exit(main())
