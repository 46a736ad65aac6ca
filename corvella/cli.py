"""corvella ingest -p PATH -n NAME [--no-gitignore] [-r] | search QUERY | list | stats NAME | files NAME."""

from __future__ import annotations

import argparse
import json

from corvella.config import load
from corvella.plans.engine import Engine
from corvella.session import get_spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvella", description=__doc__)
    p.add_argument("-c", "--config")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("-p", "--path", required=True)
    a.add_argument("-n", "--name", required=True)
    a.add_argument("--no-gitignore", action="store_true")
    a.add_argument("-r", "--rescan", action="store_true")
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("-n", "--name")
    a.add_argument("-l", "--language")
    a.add_argument("-k", type=int, default=0)
    a.add_argument("--no-tests", action="store_true")
    a.add_argument("--no-libraries", action="store_true")
    sub.add_parser("list")
    for command in ("stats", "files", "drop"):
        sub.add_parser(command).add_argument("name")
    a = sub.add_parser("rename")
    a.add_argument("old")
    a.add_argument("new")
    a = sub.add_parser("delete-file")
    a.add_argument("name")
    a.add_argument("path")
    a = sub.add_parser("delete-chunk-set")
    a.add_argument("name")
    a.add_argument("timestamp")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = load(a.config)
    engine = Engine(get_spark(a.master), config["lancedb"]["persistPath"], config)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    out = {
        "ingest": lambda: engine.rescan(a.name, a.path) if a.rescan else engine.ingest(a.path, a.name, not a.no_gitignore),
        "search": lambda: engine.search(a.query, a.name, a.language, a.k, a.no_tests, a.no_libraries),
        "list": lambda: rows(engine.list_codebases()),
        "stats": lambda: rows(engine.stats(a.name)),
        "files": lambda: rows(engine.list_files(a.name)),
        "drop": lambda: engine.drop(a.name),
        "rename": lambda: engine.rename(a.old, a.new),
        "delete-file": lambda: engine.delete_file(a.name, a.path),
        "delete-chunk-set": lambda: engine.delete_chunk_set(a.name, a.timestamp),
    }[a.command]()
    print(json.dumps(out, indent=1, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
