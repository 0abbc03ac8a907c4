"""Extraction and diffs as SQL table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .languages import Registry, builtin


def register(spark: SparkSession, registry: Registry | None = None) -> None:
    """source_symbols(path, content) and source_edges(path, content) for SQL; a file that cannot be read gives no rows."""
    languages = registry or builtin()

    def found(path: str, content: bytes, what: str) -> list[dict]:
        try:
            return languages.extractors[languages.detect(path)].extract(path, bytes(content))[what]
        except (ValueError, KeyError, TypeError):
            return []

    @udtf(returnType="name string, kind string, parent_symbol string, signature string, start_line int, end_line int, is_partial boolean")
    class Symbols:
        def eval(self, path: str, content: bytes):
            for s in found(path, content, "symbols"):
                yield s["name"], s["kind"], s["parent_symbol"], s["signature"], s["start_line"], s["end_line"], s["is_partial"]

    @udtf(returnType="source string, target string, kind string, start_line int")
    class Edges:
        def eval(self, path: str, content: bytes):
            for e in found(path, content, "edges"):
                yield e["source"], e["target"], e["kind"], e["start_line"]

    spark.udtf.register("source_symbols", Symbols)
    spark.udtf.register("source_edges", Edges)
