"""Tool functions over one long-lived session, and a server for them: each gives {"matches": [{"file", "line"}]}.

The server speaks JSON-RPC 2.0, one message a line, over a pair of streams: initialize, tools/list and
tools/call, each tool with the arguments name and directory.
"""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .plans.index import Graph, load_or_index


class ToolError(RuntimeError):
    """The engine failed."""


class Tools:
    def __init__(self, spark: SparkSession, root: str, index_path: str | None = None) -> None:
        self.spark, self.root, self.index_path = spark, root, index_path
        self._graph: Graph | None = None

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            try:
                self._graph = load_or_index(self.spark, self.root, self.index_path)
            except Exception as e:
                raise ToolError(str(e)) from e
        return self._graph

    @staticmethod
    def _matches(df: DataFrame) -> dict:
        return {"matches": [{"file": r["file"], "line": r["line"]} for r in df.select("file", "line").collect()]}

    def find_definition(self, name: str) -> dict:
        return self._matches(self.graph.find_definition(name))

    def who_calls(self, name: str) -> dict:
        return self._matches(self.graph.who_calls(name))

    def blast_radius(self, name: str) -> dict:
        return self._matches(self.graph.blast_radius(name))


NAMED = {
    "find_definition": "Where the function `name` is defined below `directory`.",
    "who_calls": "The functions below `directory` that call `name`.",
    "blast_radius": "All that directly or transitively call `name` below `directory`.",
}
PROTOCOL = "2024-11-05"
#: JSON-RPC's codes.
BAD_JSON, BAD_REQUEST, NO_METHOD, BAD_ARGUMENTS = -32700, -32600, -32601, -32602


class _Refused(Exception):
    def __init__(self, code: int, text: str) -> None:
        super().__init__(text)
        self.code = code


class Server:
    """Answers requests; the graph of a directory is loaded or made once and kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tools: dict[str, Tools] = {}

    def answer(self, request: dict) -> dict | None:
        """The response to one request, none to a notification."""
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return self._error(None, BAD_REQUEST, "not a request")
        try:
            result = self._result(request["method"], request.get("params") or {})
        except _Refused as e:
            return self._error(request.get("id"), e.code, str(e)) if "id" in request else None
        return {"jsonrpc": "2.0", "id": request["id"], "result": result} if "id" in request else None

    @staticmethod
    def _error(at, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": at, "error": {"code": code, "message": text}}

    def _result(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tracewright", "version": "1"}}
        if method.startswith("notifications/") or method == "ping":
            return {}
        if method == "tools/list":
            schema = {"type": "object", "properties": {"name": {"type": "string"}, "directory": {"type": "string"}}, "required": ["name", "directory"]}
            return {"tools": [{"name": n, "description": what, "inputSchema": schema} for n, what in NAMED.items()]}
        if method != "tools/call":
            raise _Refused(NO_METHOD, f"no method {method}")
        tool, given = params.get("name"), params.get("arguments") or {}
        if tool not in NAMED:
            raise _Refused(BAD_ARGUMENTS, f"no tool {tool}")
        if not all(isinstance(given.get(k), str) for k in ("name", "directory")):
            raise _Refused(BAD_ARGUMENTS, "name and directory are needed")
        try:
            one = self.tools.get(given["directory"]) or Tools(self.spark, given["directory"])
            found = getattr(one, tool)(given["name"])
            self.tools[given["directory"]] = one
        except Exception as e:  # a failure of the engine is the tool's answer
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(found)}], "structuredContent": found, "isError": False}


def serve(spark: SparkSession, source: TextIO, sink: TextIO) -> None:
    """Answer each line of source on sink until it ends."""
    server = Server(spark)
    for line in source:
        if not line.strip():
            continue
        try:
            told = server.answer(json.loads(line))
        except ValueError:
            told = Server._error(None, BAD_JSON, "not JSON")
        if told is not None:
            sink.write(json.dumps(told) + "\n")
            sink.flush()
