"""python -m loomgraph index ROOT --store FOLDER [--full] [--no-embed] [--config FILE] | embed REPO | search TEXT | evaluate ORACLE.json, each with --store FOLDER"""

from __future__ import annotations

import argparse
import json

from .engine import CodeGraph
from .session import session
from .sources.files import repo_configs, repo_from_args


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("command", choices=["index", "embed", "search", "evaluate"])
    parser.add_argument("what")
    parser.add_argument("--store", required=True)
    parser.add_argument("--full", action="store_true")
    parser.add_argument("--no-embed", action="store_true")
    parser.add_argument("--config")
    parser.add_argument("--limit", type=int, default=10)
    args = parser.parse_args(argv)
    graph = CodeGraph(session(), args.store)
    if args.command == "index":
        for repo in repo_configs(args.config) if args.config else [repo_from_args(args.what)]:
            print(graph.index(repo["path"], repo["name"], repo.get("languages"), repo.get("exclude"), args.full, not args.no_embed))
    elif args.command == "embed":
        print(graph.embed(None if args.what == "all" else args.what))
    elif args.command == "search":
        for row in graph.search([args.what], args.limit).orderBy("place").collect():
            print(row["place"], row["qualified_name"], row["kind"], row["score"])
    else:
        with open(args.what, encoding="utf-8") as f:
            report, notes = graph.caller_report(json.load(f))
        for row in report.orderBy("entry", "tests").collect():
            print(*row)
        print("\n".join(notes))


if __name__ == "__main__":
    main()
