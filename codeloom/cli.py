"""The command line: summaries, the graph as JSON, cycles, findings, and the HTTP server."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__
from .config import configure_logging
from .errors import EngineError
from .service import Analysis, AnalysisService


def graph_text(result: Analysis) -> Iterator[str]:
    """The graph as one JSON document, keys in order, piece by piece: a partition's rows at most are on the driver."""
    nodes, edges = result.graph.dump()
    yield '{\n  "graph": {\n'
    for n, (name, rows) in enumerate((("edges", edges), ("nodes", nodes))):
        yield f'    "{name}": ['
        for k, row in enumerate(rows.toLocalIterator()):
            yield (",\n      " if k else "\n      ") + json.dumps(json.loads(row.value), sort_keys=True)
        yield "\n    ]" + ("\n" if n else ",\n")
    yield '  },\n  "stats": ' + json.dumps(result.stats(), sort_keys=True) + "\n}\n"


def graph_dict(result: Analysis) -> dict:
    """The whole graph for an answer over HTTP; `graph_text` and `KnowledgeGraph.dump` don't gather it."""
    nodes, edges = result.graph.dump()
    parse = lambda rows: [json.loads(r.value) for r in rows.toLocalIterator()]
    return {"stats": result.stats(), "graph": {"nodes": parse(nodes), "edges": parse(edges)}}


def _ingest(service: AnalysisService, args: argparse.Namespace) -> None:
    result = service.analyze(args.path, args.branch)
    about, stats = result.repository.as_dict(), result.stats()
    listed = {k.replace("_", " "): ", ".join(about["ecosystem"][k]) or "-" for k in ("languages", "build_systems", "frameworks", "test_frameworks")}
    rows = {"root": about["root"], "commit": about["commit"] or "-"} | listed | {"file count": about["file_count"], "graph nodes": stats["nodes"], "graph edges": stats["edges"]}
    print(f"Ingested {about['name']}")
    for field, value in rows.items():
        print(f"  {field:16} {value}")


def _build(service: AnalysisService, args: argparse.Namespace) -> None:
    result = service.analyze(args.path)
    if args.out is None:
        sys.stdout.writelines(graph_text(result))
        return
    with Path(args.out).open("w", encoding="utf-8") as f:
        f.writelines(graph_text(result))
    stats = result.stats()
    print(f"wrote {args.out} ({stats['nodes']} nodes, {stats['edges']} edges)")


def _cycles(service: AnalysisService, args: argparse.Namespace) -> None:
    found = service.analyze(args.path).graph.find_cycles(args.kind).orderBy("scc").collect()
    if not found:
        print(f"no {args.kind} cycles")
    for i, row in enumerate(found, 1):
        print(f"cycle {i} ({len(row.members)} nodes):")
        for node in row.members:
            print(f"  - {node}")


def _scan(service: AnalysisService, args: argparse.Namespace) -> None:
    found = service.analyze(args.path, rule_ids=args.rule).finding_dicts()
    if not found:
        print("no findings")
    for f in found:
        print(f"{f['rule_id']} [{f['severity']}] {f['title']}\n{f['description']}")
        if f["metadata"]:
            print(f"  metadata: {f['metadata']}")
        print()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("codeloom", description="Analyses of source-code repositories on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")

    def command(group, name: str, run, help: str) -> argparse.ArgumentParser:  # noqa: ANN001, A002
        p = group.add_parser(name, help=help)
        p.add_argument("--path", "-p", required=True)
        p.set_defaults(run=run)
        return p

    command(commands, "ingest", _ingest, "print a summary").add_argument("--branch")
    command(commands, "scan", _scan, "print findings").add_argument("--rule", action="append", help="a rule id; may be given again")
    graph = commands.add_parser("graph", help="the graph").add_subparsers(dest="graph_command", required=True)
    command(graph, "build", _build, "the graph as JSON").add_argument("--out", "-o")
    command(graph, "cycles", _cycles, "print cycles").add_argument("--kind", default="imports")
    serve = commands.add_parser("serve", help="answer HTTP requests")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    return top


def main(argv: Sequence[str] | None = None, service: AnalysisService | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    configure_logging()
    if getattr(args, "path", None) is not None and not Path(args.path).is_dir():
        print(f"error: no such directory: {args.path}", file=sys.stderr)
        return 2
    service = service or AnalysisService(SparkSession.builder.appName("codeloom").getOrCreate())
    if args.command == "serve":
        from .http import server

        server(service, args.host, args.port).serve_forever()
        return 0
    try:
        args.run(service, args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
