"""The memory over HTTP, as tools for agents, and from the command line: thin shells over ``Memory``."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from mnemora.memory import Memory, MemoryError_
from mnemora.schema import REPRESENTATIONS
from mnemora.streaming.replication import JournalSource, apply_events, pull_loop


def _plain(value):
    """Rows and DataFrames as what JSON can hold."""
    if isinstance(value, DataFrame):
        return [json.loads(r) for r in value.toJSON().collect()]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _snake(body: dict) -> dict:
    return {re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m.group(1).lower(), k): v for k, v in body.items()}


def _member(m: Memory, b: dict, context_id: str) -> str:
    return m.add_membership(context_id, **b)


def _replicated(m: Memory, b: dict) -> dict:
    events = b.get("events", [b])
    rows = m.spark.createDataFrame([(e.get("sequence"), e.get("id"), e.get("timestamp", e.get("logged_at")), e.get("entityType", e.get("entity_type")), e.get("entityId", e.get("entity_id")), e.get("operation"), e.get("payloadHash", e.get("payload_hash")), e.get("actor")) for e in events], JournalSource({}).schema())
    return {"applied": apply_events(m.store, rows)}


def _events(m: Memory, q: dict) -> dict:
    return {"events": m.journal(int(q.get("since", 0))), "lastSequence": m.store.last_sequence()}


def _of(body: dict, *names: str):
    """The first of these fields that a body has; one of them must be there."""
    for n in names:
        if body.get(n) is not None:
            return body[n]
    raise ValueError(f"{names[0]} is missing")


def _context(m: Memory, b: dict) -> dict:
    return m.context_of(_of(b, "start_object_id", "start"), int(b.get("max_depth", b.get("depth", 3))), b.get("tenant_id", "default"))


def _extract(m: Memory, b: dict) -> dict:
    """With ``async`` the model that the server was given for it; it is an error to have none."""
    model = None
    if b.get("async"):
        model = m.slow_model
        if model is None:
            raise ValueError("no model for async extraction")
    got = m.extract(_of(b, "evidence_id"), _of(b, "content"), b.get("actor", "http"), b.get("tenant_id", "default"), model)
    return {"candidatesCreated": got["candidates"], **got}


def _exported(m: Memory, b: dict) -> dict:
    return m.get("segments", m.export_segment(_of(b, "root_context", "context_id"), b.get("purpose") or "", b.get("expires_in_days"), b.get("actor", "http"), b.get("sensitivity")))


def _imported(m: Memory, b: dict) -> dict:
    segment = _of(b, "segment")
    return m.import_segment(_snake(segment) if isinstance(segment, dict) else segment, bool(b.get("auto_apply", b.get("apply", False))), b.get("actor", "http"))


def _agent(m: Memory, i: str, q: dict):
    return m.agent_context(i, q.get("max_sensitivity"), q.get("tenant_id", "default"), q.get("agent_id"), q.get("purpose"))


#: (method, path pattern, handler of memory, body or query, and what the path holds).
ROUTES: list[tuple[str, str, Callable]] = [
    ("GET", "/health", lambda m, q: {"status": "ok", "version": m.store.version()}),
    ("GET", "/objects/([^/]+)", lambda m, q, i: m.get("objects", i)),
    ("GET", "/objects/([^/]+)/provenance", lambda m, q, i: m.provenance_of(i)),
    ("GET", "/objects/([^/]+)/relationships", lambda m, q, i: m.relationships_of(i)),
    ("GET", "/claims/([^/]+)", lambda m, q, i: m.get("claims", i)),
    ("GET", "/contexts/([^/]+)", lambda m, q, i: m.get("contexts", i)),
    ("GET", "/contexts/([^/]+)/agent-context", lambda m, q, i: _agent(m, i, q)),
    ("POST", "/objects", lambda m, b: {"id": m.create_object(**b)}),
    ("POST", "/claims", lambda m, b: {"id": m.create_claim(**b)}),
    ("POST", "/relationships", lambda m, b: {"id": m.create_relationship(**b)}),
    ("POST", "/contexts", lambda m, b: {"id": m.create_context(**b)}),
    ("POST", "/contexts/([^/]+)/memberships", lambda m, b, i: {"id": _member(m, b, i)}),
    ("POST", "/candidates", lambda m, b: {"id": m.propose(**{**b, "payload": b.get("payload") or {}})}),
    ("POST", "/candidates/([^/]+)/decide", lambda m, b, i: m.decide(i, **b)),
    ("POST", "/decisions/([^/]+)/apply-policy", lambda m, b, i: m.apply_policy(i, **b)),
    ("POST", "/extract", lambda m, b: _extract(m, b)),
    ("POST", "/segments/export", lambda m, b: _exported(m, b)),
    ("POST", "/segments/import", lambda m, b: _imported(m, b)),
    ("GET", "/segments/([^/]+)", lambda m, q, i: m.get("segments", i)),
    ("POST", "/query/entry-points", lambda m, b: m.entry_points(b["query"], b.get("type", "essence_nl"))),
    ("POST", "/query/knowledge", lambda m, b: m.knowledge(b["query"], b.get("tenant_id", "default"))),
    ("POST", "/query/context", lambda m, b: _context(m, b)),
    ("POST", "/query/multi-hop", lambda m, b: m.paths(_of(b, "start_object_id", "start"), _of(b, "end_object_id", "end"), int(b.get("max_depth", b.get("depth", 4))), b.get("tenant_id", "default"))),
    ("GET", "/journal", _events),
    ("GET", "/replication/events", _events),
    ("POST", "/replication/events", _replicated),
]
_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}
#: What agents can call: name -> (what it does, its arguments, those it must have, handler of memory and arguments).
TOOLS: dict[str, tuple[str, dict, tuple[str, ...], Callable]] = {
    "memory_get_object": ("One object, merges followed", {"id": _TEXT}, ("id",), lambda m, a: m.get("objects", a["id"])),
    "memory_get_claim": ("One claim", {"id": _TEXT}, ("id",), lambda m, a: m.get("claims", a["id"])),
    "memory_get_context": ("One context", {"id": _TEXT}, ("id",), lambda m, a: m.get("contexts", a["id"])),
    "memory_create_object": ("A new object", {"type": _TEXT, "name": _TEXT}, ("type", "name"), lambda m, a: {"id": m.create_object(a["type"], a["name"], actor="mcp")}),
    "memory_query_entry_points": ("Representations sharing words with a query, best first", {"query": _TEXT, "type": {**_TEXT, "enum": list(REPRESENTATIONS)}}, ("query",), lambda m, a: m.entry_points(a["query"], a.get("type", "essence_nl"))),
    "memory_query_knowledge": ("Claims and relationships by keyword", {"query": _TEXT}, ("query",), lambda m, a: m.knowledge(a["query"])),
    "memory_query_context": ("Paths, claims and gaps around an object", {"startObjectId": _TEXT, "maxDepth": _NUMBER}, ("startObjectId",), _context),
    "memory_get_journal": ("All changes in order", {}, (), lambda m, a: {"events": m.journal()}),
    "memory_get_segment": ("One exported segment", {"id": _TEXT}, ("id",), lambda m, a: m.get("segments", a["id"])),
}


def schemas() -> list[dict]:
    """The tools as ``tools/list`` gives them."""
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": list(r)}} for n, (d, p, r, _) in TOOLS.items()]


def answer(memory: Memory, method: str, url: str, body: dict | None = None, token: str | None = None, given: str | None = None) -> tuple[int, object]:
    """(status, content) of a request. ``token``: what replication asks for as bearer, nothing if not set."""
    parts = urlsplit(url)
    query = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    for verb, pattern, handle in ROUTES:
        found = re.fullmatch(pattern, parts.path)
        if verb == method and found:
            if token and parts.path == "/replication/events" and given != f"Bearer {token}":
                return 401, {"error": "unauthorized"}
            try:
                got = _plain(handle(memory, _snake(body or {}) if method == "POST" else _snake(query), *map(unquote, found.groups())))
            except KeyError as x:
                return 404, {"error": str(x)}
            except (MemoryError_, TypeError, ValueError) as x:
                return 400, {"error": str(x)}
            return (404, {"error": "not found"}) if got is None else (200, got)
    return 404, {"error": "no such route"}


def tool(memory: Memory, name: str, arguments: dict) -> object:
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    missing = [r for r in TOOLS[name][2] if arguments.get(r) is None]
    if missing:
        raise ValueError(f"{missing[0]} is missing")
    return _plain(TOOLS[name][3](memory, _snake(arguments)))


def serve(memory: Memory, port: int, token: str | None = None) -> ThreadingHTTPServer:
    """A server bound to ``port`` of this machine; ``serve_forever`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            n = int(self.headers.get("content-length") or 0)
            try:
                body = json.loads(self.rfile.read(n)) if n else {}
                status, content = answer(memory, self.command, self.path, body, token, self.headers.get("authorization"))
            except json.JSONDecodeError:
                status, content = 400, {"error": "invalid JSON"}
            data = json.dumps(content, default=str).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def tools_over_stdio(memory: Memory, lines=sys.stdin, out=sys.stdout) -> None:
    """One JSON request a line: ``tools/list``, or ``tools/call`` with a name and arguments."""
    for line in lines:
        if not line.strip():
            continue
        request = json.loads(line)
        try:
            if request.get("method") == "tools/list":
                result = {"tools": schemas()}
            else:
                p = request["params"]
                result = {"content": [{"type": "text", "text": json.dumps(tool(memory, p["name"], p.get("arguments", {})), default=str)}]}
            said = {"jsonrpc": "2.0", "id": request.get("id"), "result": result}
        except Exception as x:  # noqa: BLE001
            said = {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": -32000, "message": str(x)}}
        print(json.dumps(said, default=str), file=out, flush=True)


def main(argv: list[str] | None = None, memory: Memory | None = None) -> object:
    """``python -m mnemora.server --store FOLDER COMMAND …``"""
    p = argparse.ArgumentParser(prog="mnemora")
    p.add_argument("--store", required=memory is None, help="a folder that every executor can reach")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "serve": ["--port"], "mcp": [], "ingest": ["folder", "source"], "journal": ["--since"], "extract": ["evidence_id", "file"], "extract-async": ["evidence_id", "file"], "query": ["text"], "replicate-pull": ["url"],
    }.items():
        q = sub.add_parser(name)
        for a in arguments:
            q.add_argument(a)
    a = p.parse_args(argv)
    m = memory or Memory(SparkSession.builder.appName("mnemora").getOrCreate(), a.store)
    if a.command == "serve":
        return serve(m, int(a.port or 8080)).serve_forever()
    if a.command == "mcp":
        return tools_over_stdio(m)
    if a.command == "ingest":
        got = m.ingest(a.folder, a.source)
    elif a.command == "journal":
        got = m.journal(int(a.since or 0))
    elif a.command.startswith("extract"):
        with open(a.file, encoding="utf-8") as f:
            got = _extract(m, {"evidence_id": a.evidence_id, "content": f.read(), "actor": "cli", "async": a.command == "extract-async"})
    elif a.command == "query":
        got = _plain({"entry_points": m.entry_points(a.text), **m.knowledge(a.text)})
    else:
        m.spark.dataSource.register(JournalSource)
        got = pull_loop(m.store, lambda since: m.spark.read.format("journal").option("url", a.url).option("since", str(since)).load())
    print(json.dumps(got, default=str))
    return got


if __name__ == "__main__":
    main()


