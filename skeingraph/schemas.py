"""Schemas of the canonical relations, as DDL: files, symbols, edges, semantic documents, query log."""

from __future__ import annotations

#: Symbol kinds in lookup order, edge kinds.
SYMBOL_KINDS = ("function", "method", "class", "interface", "type", "variable")
EDGE_KINDS = ("calls", "imports", "extends", "implements", "type_refs")

SPAN = "file STRING, start_line INT, start_col INT, end_line INT, end_col INT"
FILES = "path STRING, language STRING, file_hash STRING, last_indexed TIMESTAMP, symbol_count INT, edge_count INT, error_count INT"
SYMBOLS = "id BIGINT, file_path STRING, name STRING, qualified_name STRING, kind STRING, parent_symbol STRING, signature STRING, start_line INT, start_col INT, end_line INT, end_col INT, is_partial BOOLEAN"
EDGES = "source STRING, target STRING, kind STRING, source_file STRING, source_start_line INT, source_start_col INT, source_end_line INT, source_end_col INT, target_file STRING, target_start_line INT, target_start_col INT, target_end_line INT, target_end_col INT"
DOCUMENTS = (
    "file STRING, file_hash STRING, ingested_at STRING, source STRING, module_summary STRING, "
    "annotations ARRAY<STRUCT<symbol: STRING, kind: STRING, summary: STRING, design_intent: STRING, pitfalls: STRING>>, "
    "unknowns ARRAY<STRUCT<symbol: STRING, question: STRING, context: STRING>>, "
    "insights ARRAY<STRUCT<insight: STRING, related_symbols: ARRAY<STRING>>>, "
    "metrics STRUCT<complexity: ARRAY<STRUCT<name: STRING, lineno: INT, complexity: INT, rank: STRING>>, raw: STRUCT<loc: INT, lloc: INT, sloc: INT, comments: INT, multi: INT, blank: INT>>, "
    "odors ARRAY<STRUCT<rule: STRING, symbol: STRING, severity: STRING, count: INT, lines: INT, depth: INT, caller_count: INT, external: INT, internal: INT>>, "
    "module_roles MAP<STRING, STRING>"
)
QUERY_LOG = "ts DOUBLE, tool STRING, query STRING, symbols ARRAY<STRING>"
EMBEDDINGS = "qualified_name STRING, file_path STRING, embedding ARRAY<FLOAT>, model_version STRING"


def columns(flat: str) -> dict[str, str]:
    """Name to type of a schema without nested types."""
    return dict(c.split() for c in flat.split(", "))
