"""A JSON-RPC server over one source tree, a line a message: questions go to a session that is brought up to
date first; a question is one object in, one object out."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable

from loomgraph import cli
from loomgraph.operators import answers, derive
from loomgraph.plans.session import Navigation, Session
from loomgraph.sinks import exports

# Protocol versions, the latest first, and error codes of JSON-RPC.
PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602
TOOLS = {
    "ask": {"question": "string", "anchors": "integer"},
    "impact": {"symbol": "string", "depth": "integer", "risk": "boolean"},
    "context": {"symbol": "string", "depth": "integer"},
    "navigate_start": {"question": "string"},
    "navigate_choose": {"descent": "string", "ids": "array"},
    "status": {},
}
REQUIRED = ("question", "symbol", "descent", "ids")
_KINDS = {"string": str, "integer": int, "boolean": bool, "array": list}


class Refused(ValueError):
    """Arguments that no tool can work with."""


class Server:
    def __init__(self, session: Session):
        self.session, self.started = session, 0

    def handle(self, line: str) -> str | None:
        """The answer to a message; nothing to a notification."""
        try:
            message = json.loads(line)
        except ValueError as e:
            return self.failure(None, PARSE, f"Parse error: {e}")
        if not isinstance(message, dict):
            return self.failure(None, REQUEST, "Invalid Request: one object is expected")
        own, silent = message.get("id"), "id" not in message
        method = message.get("method")
        if message.get("jsonrpc") != "2.0" or not isinstance(method, str):
            return None if silent else self.failure(own, REQUEST, "Invalid Request")
        if silent:
            return None
        params = message.get("params") if isinstance(message.get("params"), dict) else {}
        does: dict[str, Callable[[dict], dict]] = {"initialize": self.hello, "ping": lambda p: {}, "tools/list": self.tools, "tools/call": self.call}
        if method not in does:
            return self.failure(own, METHOD, f"Method not found: {method}")
        try:
            return json.dumps({"jsonrpc": "2.0", "id": own, "result": does[method](params)}, ensure_ascii=False)
        except Refused as e:
            return self.failure(own, PARAMS, f"Invalid params: {e}")

    @staticmethod
    def failure(own, code: int, text: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": own, "error": {"code": code, "message": text}})

    def hello(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "loomgraph", "version": "0.1"}}

    def tools(self, params: dict) -> dict:
        schema = lambda a: {"type": "object", "properties": {k: {"type": t} for k, t in a.items()}, "required": [k for k in a if k in REQUIRED]}
        return {"tools": [{"name": n, "inputSchema": schema(a)} for n, a in TOOLS.items()]}

    def call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            raise Refused(f"unknown tool: {name}")
        for key, kind in TOOLS[name].items():
            if key not in given and key in REQUIRED:
                raise Refused(f"`{key}` is required")
            if key in given and (not isinstance(given[key], _KINDS[kind]) or kind == "integer" and not 1 <= given[key] <= 10):
                raise Refused(f"`{key}` isn't a fitting {kind}")
        try:
            return self.said(getattr(self, name)(given))
        except (ValueError, RuntimeError) as e:
            return self.said(str(e), True)

    @staticmethod
    def said(text: str, failed: bool = False) -> dict:
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def current(self):
        self.session.refresh()
        return self.session.graph

    def command(self, *argv: str) -> str:
        out = io.StringIO()
        args = cli.parser().parse_args([argv[0], self.session.root, *argv[1:]])
        cli.run(self.session.spark, args, out, self.current())
        return out.getvalue()

    def ask(self, a: dict) -> str:
        return self.command("ask", a["question"], "--anchors", str(a.get("anchors", 1)))

    def impact(self, a: dict) -> str:
        return self.command("impact", a["symbol"], "--depth", str(a.get("depth", 4)), *["--risk"] * bool(a.get("risk")))

    def context(self, a: dict) -> str:
        return self.command("context", a["symbol"], "--depth", str(a.get("depth", 3)))

    def tree(self):
        self.current()
        return self.session.index("tree", derive.derive)

    def shown(self, key: str, nav: Navigation) -> str:
        nodes, links = self.tree()
        rows = nav.presented(links, nodes)
        lines = [f"descent: {key}", f"question: {nav.question}", *[f"  {r['id']}  {r['kind']}  {r['name']}" for r in rows]]
        return "\n".join(lines + ([f"anchors: {', '.join(nav.anchors)}"] if nav.complete else []))

    def navigate_start(self, a: dict) -> str:
        self.tree()
        key, nav = f"descent-{self.started}", Navigation(a["question"], self.session.fingerprint, [derive.ROOT])
        self.started += 1
        self.session.open(key, nav)
        return self.shown(key, nav)

    def navigate_choose(self, a: dict) -> str:
        nodes, links = self.tree()
        nav = self.session.descents.get(a["descent"])
        if nav is None:
            raise ValueError(f"no open descent {a['descent']}: it is over, too old, or of earlier sources")
        nav.choose(a["ids"], links, nodes)
        return self.shown(a["descent"], nav)

    def status(self, a: dict) -> str:
        g = self.session.graph
        if g is None:
            return "state: nothing is analyzed yet"
        return f"state: ready\nsources: {self.session.fingerprint}\ngraph: {answers.fingerprint(g.nodes, g.edges).first()[0]}\n" + exports.report("nodes by kind", g.nodes.groupBy("kind").count().orderBy("kind"))

    def serve(self, lines: Iterable[str], write: Callable[[str], None]) -> None:
        for line in lines:
            if line.strip() and (answer := self.handle(line)) is not None:
                write(answer + "\n")
