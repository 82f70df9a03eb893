"""Schemas of facts, of the graph and of its side tables."""

from __future__ import annotations

FUNCTION, DECLARATION, FILE = "Function", "FunctionDecl", "File"
TYPE_KINDS = ("Struct", "Union", "Enum", "Typedef")
EXTERNAL, INTERNAL = "External", "Internal"
OK, UNREADABLE, SYNTAX_ERROR = "ok", "unreadable", "syntax error"

#: One row per file: its facts in source order, all by name, none by node. A file of very many calls, includes or type uses
#: has further rows with the rest of those alone, whose bytes and lines are null.
ARTIFACTS = """
path string, rel string, status string, hash bigint, bytes bigint, lines bigint,
definitions array<struct<name:string,line:int,is_static:boolean>>,
declarations array<struct<name:string,line:int>>,
calls array<struct<caller:string,callee:string,line:int>>,
includes array<struct<target:string,is_system:boolean,line:int,resolved:string>>,
types array<struct<name:string,line:int,category:string>>,
type_uses array<struct<function:string,type:string,line:int>>
"""
NODES = "node_id bigint, kind string, name string, file string, line int, linkage string, hash bigint"
CALLS = "src bigint, dst bigint, call_line int"
INCLUDES = "src bigint, dst bigint, line int"
USES_TYPE = "src bigint, dst bigint, line int"
DECLARES = "decl bigint, def bigint"
UNRESOLVED = "includer bigint, target string, is_system boolean, line int"
DIAGNOSTICS = "callee string, caller_file string, caller_line int, candidates array<bigint>"
SKIPPED = "path string, reason string"
RELATIONS = {
    "nodes": NODES,
    "calls": CALLS,
    "includes": INCLUDES,
    "uses_type": USES_TYPE,
    "declares": DECLARES,
    "unresolved_includes": UNRESOLVED,
    "diagnostics": DIAGNOSTICS,
    "skipped_files": SKIPPED,
}
