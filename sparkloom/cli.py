"""Command line: index, search, analyze, status, check-rules, references, call-graph, serve (JSON lines on standard input)."""

from __future__ import annotations

import argparse
import inspect
import json
import os
import sys

from sparkloom.api import Envelope, Tools, Warehouse
from sparkloom.config import load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("-p", "--project", default=".", help="root of the source tree")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index", help="index the project, by default only what has changed")
    x.add_argument("-f", "--full", action="store_true")
    x = sub.add_parser("search")
    x.add_argument("query")
    x.add_argument("--limit", type=int, default=10)
    x.add_argument("--language")
    x.add_argument("--kind")
    x = sub.add_parser("analyze")
    x.add_argument("what", nargs="?", choices=["metrics", "deadcode", "complexity", "all"], default="all")
    x = sub.add_parser("status")
    x.add_argument("-v", "--verbose", action="store_true")
    x = sub.add_parser("check-rules")
    x.add_argument("names", nargs="*")
    x = sub.add_parser("references")
    x.add_argument("symbol")
    x.add_argument("--include-declaration", action="store_true")
    x = sub.add_parser("call-graph")
    x.add_argument("symbol")
    x.add_argument("--direction", choices=["callers", "callees", "both"], default="both")
    x.add_argument("--depth", type=int, default=2)
    sub.add_parser("serve", help="answer {\"tool\": name, ...parameters} lines until the input ends")
    return p


def answers(a: argparse.Namespace, tools: Tools) -> list[Envelope]:
    """The envelopes of one command."""
    if a.command == "index":
        return [tools.reindex(a.project, full=a.full)]
    if missing := tools.w.missing():
        return [Envelope("", "Error", None, [f"the index lacks {', '.join(missing)}: run `index` first"])]
    if a.command == "search":
        return [tools.search_symbol(a.query, a.kind, a.language, a.limit)]
    if a.command == "analyze":
        out = [tools.get_metrics()] if a.what in ("metrics", "complexity", "all") else []
        return out + ([tools.detect_dead_code()] if a.what in ("deadcode", "all") else [])
    if a.command == "status":
        return [tools.get_index_status(a.verbose)]
    if a.command == "check-rules":
        return [tools.check_arch_rules(rule_names=a.names or None)]
    target = tools.resolve(a.symbol)
    if a.command == "references":
        return ([tools.get_symbol(target)] if a.include_declaration else []) + [tools.find_references(target)]
    if a.direction == "both":
        return [tools.get_call_graph(target, a.depth, a.depth)]
    return [(tools.trace_callers if a.direction == "callers" else tools.trace_callees)(target, a.depth)]


def served(tools: Tools, line: str) -> Envelope:
    """The answer to one request line."""
    try:
        request = json.loads(line)
        name = request.pop("tool")
        tool = getattr(tools, name) if name[:1] != "_" and name != "resolve" else None
        inspect.signature(tool).bind(**request)
    except (ValueError, AttributeError, TypeError, KeyError) as x:
        return Envelope("", "Error", None, [f"bad request: {x}"])
    return tool(**request)


def main(args: list[str] | None = None, spark=None, out=None) -> int:
    """0 when all went well; 1 after an error or a broken rule."""
    a, out = parser().parse_args(args), out or sys.stdout
    config = load(a.project)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    tools = Tools(Warehouse(spark, os.path.join(os.path.abspath(a.project), config.index.path)), config)
    if a.command == "serve":
        for line in sys.stdin:
            if line.strip():
                print(served(tools, line).to_json(), file=out, flush=True)
        return 0
    found = answers(a, tools)
    for e in found:
        print(e.to_json(), file=out)
    broken = any(isinstance(e.data, dict) and e.data.get("status") == "failed" for e in found)
    return int(broken or any(e.status == "Error" for e in found))


if __name__ == "__main__":
    sys.exit(main())
