"""HTTP: POST /repositories/ingest; GET /graph/build, /graph/cycles, /graph/impact, /health and /ready."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from . import __version__
from .cli import graph_dict
from .errors import IngestionError
from .service import Analysis, AnalysisService

DEEPEST = 20


class Refused(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


def _asked(query: dict, name: str, default=None, allowed=None):  # noqa: ANN001, ANN202
    value = query.get(name, default)
    if value is None or (allowed and value not in allowed):
        raise Refused(422, f"{name} is required" if value is None else f"{name} must be one of {', '.join(allowed)}")
    return value


class Routes:
    """Requests as calls, (status, body) each; the server only carries them."""

    def __init__(self, service: AnalysisService) -> None:
        self.service = service

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
        url = urlsplit(target)
        routes = {("GET", "/health"): self.health, ("GET", "/ready"): self.ready, ("GET", "/graph/build"): self.build, ("GET", "/graph/cycles"): self.cycles, ("GET", "/graph/impact"): self.impact, ("POST", "/repositories/ingest"): self.ingest}
        if (method, url.path) not in routes:
            known = any(path == url.path for _, path in routes)
            return (405, {"detail": "Method Not Allowed"}) if known else (404, {"detail": "Not Found"})
        try:
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()} if method == "GET" else self._json(body)
            return 200, routes[method, url.path](asked)
        except Refused as e:
            return e.status, {"detail": str(e)}
        except IngestionError as e:
            return 400, {"detail": str(e)}
        except Exception as e:  # noqa: BLE001
            return 500, {"detail": f"{type(e).__name__}: {e}"}

    @staticmethod
    def _json(body: bytes) -> dict:
        try:
            found = json.loads(body or b"null")
        except ValueError as e:
            raise Refused(422, f"the body is no JSON: {e}") from e
        if not isinstance(found, dict):
            raise Refused(422, "the body must be an object")
        return found

    def _with(self, source: str, then, **options):  # noqa: ANN001, ANN003, ANN202
        result = self.service.analyze(source, **options)
        try:
            return then(result)
        finally:
            self.service.close(result)

    def health(self, asked: dict) -> dict:
        return {"status": "ok", "version": __version__}

    def ready(self, asked: dict) -> dict:
        return {"status": "ok"}

    def ingest(self, asked: dict) -> dict:
        """A path goes before a url."""
        source, rules = asked.get("path") or asked.get("url"), asked.get("rule_ids")
        if not source:
            raise Refused(422, "path or url is required")
        if not isinstance(source, str) or not (rules is None or isinstance(rules, list) and all(isinstance(r, str) for r in rules)):
            raise Refused(422, "path and url are strings, rule_ids a list of strings")

        def report(r: Analysis) -> dict:
            return {"repository": r.repository.as_dict(), "parsed_file_count": r.parsed.count(), "graph": r.stats(), "findings": r.finding_dicts()}

        return self._with(source, report, branch=asked.get("branch"), rule_ids=rules)

    def build(self, asked: dict) -> dict:
        return self._with(_asked(asked, "path"), graph_dict, branch=asked.get("branch"))

    def cycles(self, asked: dict) -> dict:
        path, kind = _asked(asked, "path"), _asked(asked, "kind", "imports")
        found = self._with(path, lambda r: [x.members for x in r.graph.find_cycles(kind).orderBy("scc").collect()])
        return {"kind": kind, "cycles": found, "count": len(found)}

    def impact(self, asked: dict) -> dict:
        path, node, direction = _asked(asked, "path"), _asked(asked, "node"), _asked(asked, "direction", "downstream", ("downstream", "upstream"))
        depth = str(asked.get("max_depth", 5))
        if not depth.isdecimal() or not 1 <= int(depth) <= DEEPEST:
            raise Refused(422, f"max_depth must be from 1 to {DEEPEST}")

        def search(r: Analysis) -> list[str]:
            if not r.graph.has_node(node):
                raise Refused(404, f"node not found: {node}")
            return sorted(x.id for x in getattr(r.graph, direction)(node, max_depth=int(depth)).collect())

        found = self._with(path, search)
        return {"start": node, "direction": direction, "max_depth": int(depth), "nodes": found, "count": len(found)}


def server(service: AnalysisService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    routes = Routes(service)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, body = routes.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *args) -> None:  # noqa: ANN002
            pass

    return ThreadingHTTPServer((host, port), Handler)
