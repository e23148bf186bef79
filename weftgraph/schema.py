"""Schemas of the graph's tables and the domains of their labels."""

from __future__ import annotations

PROJECTS = "name string, root string, node_count long, edge_count long, created_at long, updated_at long"
NODES = "id long, project string, file string, start_line int, start_col int, end_line int, end_col int, label string, name string, qualified string, signature string, doc string"
EDGES = "id long, project string, src long, dst long, type string, confidence string, site_line int, trace_hits long"
FILES = "project string, path string, lang string, hash string, mtime long, indexed_at long"
EMBEDDINGS = "node_id long, project string, vec array<tinyint>"
TRACES = "id long, project string, name string, root string, calls array<string>, created_at long"
ADR = "project string, id string, title string, content string, created_at long, updated_at long"
EMITS = (
    "project string, path string, lang string, module_spec string, ord int, kind string, name string, label string, target_name string, source string, base string, "
    "method string, path_route string, handler string, signature string, doc string, sl int, sc int, el int, ec int"
)

TABLES = {"projects": PROJECTS, "nodes": NODES, "edges": EDGES, "files": FILES, "embeddings": EMBEDDINGS, "traces": TRACES, "adr": ADR}
#: What tells rows of a table apart.
KEYS = {"projects": ["name"], "nodes": ["id"], "edges": ["id"], "files": ["project", "path"], "embeddings": ["node_id"], "traces": ["id"], "adr": ["project", "id"]}

CODE_LABELS = ("Function", "Method", "Class", "Interface", "Enum", "Type")
CALL_TYPES = ("CALLS", "CALL_REFERENCE")
TRACE_TYPES = ("CALLS", "CALL_REFERENCE", "USAGE")
