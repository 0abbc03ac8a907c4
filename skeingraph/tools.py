"""An engine's operations by name, with checked arguments and plain results: what a shell (a server, an editor) calls.

Results are reports of bounded size: rows come as dictionaries, at most LIMIT of them.
"""

from __future__ import annotations

import json
import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .repository import Versions

LIMIT, LONGEST_BODY = 1000, 1 << 20


class JsonLines(logging.Formatter):
    """One JSON object a line."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


def logger(name: str = "skeingraph", level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
    log.setLevel(level)
    return log


class Refused(Exception):
    def __init__(self, status: int, said: str):
        super().__init__(said)
        self.status = status


def body(raw: bytes) -> dict:
    """A request's JSON object; empty, too long or other bodies are refused."""
    if len(raw) > LONGEST_BODY:
        raise Refused(413, f"longer than {LONGEST_BODY} bytes")
    try:
        found = json.loads(raw) if raw.strip() else None
    except ValueError as e:
        raise Refused(400, f"no JSON: {e}") from e
    if not isinstance(found, dict):
        raise Refused(400, "a JSON object is asked for")
    return found


def file_tree(paths: list[str], part: str = "") -> dict:
    """Nested folders of the paths that hold a text, files as None."""
    root: dict = {}
    for path in sorted(p for p in paths if part.lower() in p.lower()):
        here = root
        *folders, name = path.split("/")
        for f in folders:
            here = here.setdefault(f, {})
        here[name] = None
    return root


def rows(found: DataFrame) -> dict:
    """The first LIMIT rows, and whether there are more."""
    first = [r.asDict(recursive=True) for r in found.limit(LIMIT + 1).collect()]
    return {"rows": first[:LIMIT], "truncated": True} if len(first) > LIMIT else {"rows": first}


class Tools:
    #: Name: method, arguments that must be there, arguments that may be.
    NAMES = {
        "search": (("query",), ("limit", "file_path")), "semantic_search": (("query",), ("limit",)), "search_task": (("task",), ("limit", "file_path")),
        "callers": (("name",), ("depth", "file_path")), "callees": (("name",), ("depth", "file_path")), "impact": (("name",), ("max_depth",)), "node": (("name",), ("file_path",)),
        "context": (("task",), ("limit",)), "diff": (("text",), ("depth",)), "affected": (("paths",), ("depth", "root")), "semantic_context": (("file",), ()), "shortest_path": (("source", "target"), ()),
        "annotations": ((), ("file", "symbol")), "unknowns": ((), ("limit",)), "insights": ((), ("limit",)), "annotate": (("file", "symbol", "summary"), ("kind", "design_intent", "pitfalls")),
        "add_insight": (("file", "insight"), ("related",)), "add_unknown": (("file", "symbol", "question"), ("context",)), "check_freshness": (("root",), ()), "sync": (("root",), ("analyze",)),
        "ingest_conversation": (("text", "file"), ()), "save_conversation": (("text", "to"), ()), "hot_symbols": ((), ("limit",)), "files": ((), ()), "file_tree": ((), ("part",)), "layers": ((), ()), "status": ((), ()), "health": ((), ()),
        "patterns": ((), ()), "smells": ((), ("file", "severity")), "metrics": ((), ("file",)), "coverage": ((), ()),
        "graph": (("root",), ("depth", "cap")), "search_plain": (("query",), ("limit", "file_path")),
    }

    def __init__(self, engine: Engine):
        self.engine, self.began = engine, time.time()
        self.calls: dict[str, int] = {}
        self.errors: dict[str, int] = {}
        self.seconds: list[float] = []

    def call(self, name: str, arguments: dict) -> dict:
        """{rows: [...]} or a document of the operation; {error: ...} for unknown names and missing or unknown arguments."""
        if name not in self.NAMES:
            return {"error": f"no such operation: {name}"}
        must, may = self.NAMES[name]
        missing = [k for k in must if arguments.get(k) is None]  # an empty text is an argument
        unknown = sorted(set(arguments) - set(must) - set(may))
        if missing or unknown:
            self.errors[name] = self.errors.get(name, 0) + 1
            return {"error": "; ".join([f"missing: {k}" for k in missing] + [f"unknown: {k}" for k in unknown])}
        self.calls[name] = self.calls.get(name, 0) + 1
        began = time.perf_counter()
        try:
            found = getattr(self, f"_{name}", None) or getattr(self.engine, name)
            out = found(**arguments)
        except ValueError as e:  # what was asked for is not understood
            self.errors[name] = self.errors.get(name, 0) + 1
            return {"error": str(e)}
        finally:
            self.seconds = [*self.seconds[-9999:], time.perf_counter() - began]
        return rows(out) if isinstance(out, DataFrame) else out or {"done": True}

    def _search(self, **a) -> DataFrame:
        return self.engine.search(**a, log=True)

    def _semantic_search(self, **a) -> DataFrame:
        return self.engine.search_semantic(**a)

    def _node(self, **a) -> dict:
        row = self.engine.node(**a).first()
        return {"found": row is not None, "node": None if row is None else row.asDict()}

    def _semantic_context(self, file: str) -> dict:
        """What is known of a file: summary, annotations, unknowns, insights, roles."""
        kept = Versions(self.engine)
        module = kept.module(file).first()
        lists = {n: [r.asDict(recursive=True) for r in kept.relation(n, file).limit(LIMIT).collect()] for n in ("annotations", "unknowns", "insights")}
        return {"file": file, "module_summary": module.module_summary if module else "", "module_roles": dict(module.module_roles) if module else {}, **lists}

    def _graph(self, **a) -> dict:
        """A symbol's surroundings in the order in which they are met, and what was left waiting at the cap."""
        found = self.engine.discovery(**a)
        edges, totals = rows(found["edges"]), found["totals"].first()
        return {"nodes": rows(found["nodes"].orderBy("place"))["rows"], "edges": edges["rows"], "edges_truncated": "truncated" in edges, "truncated": totals.truncated, "total_available": totals.total_available, "truncated_branches": rows(found["branches"].orderBy("position"))["rows"]}

    def _check_freshness(self, root: str) -> DataFrame:
        return self.engine.freshness(root)

    def _save_conversation(self, text: str, to: str) -> dict:
        return {"path": self.engine.save_conversation(text, to)}

    def _file_tree(self, part: str = "") -> dict:
        """Of the files whose path holds a text, the first 100 LIMIT in the alphabet; a name that no file can have says if there are more."""
        found = self.engine.files().where(F.contains(F.lower("path"), F.lit(part.lower()))).select("path").orderBy("path").limit(100 * LIMIT + 1).collect()
        tree = file_tree([r.path for r in found[: 100 * LIMIT]], part)
        return tree | {"/truncated": True} if len(found) > 100 * LIMIT else tree

    def _health(self) -> dict:
        return self.engine.health().first().asDict()

    def counters(self) -> dict:
        """Requests and errors by operation, requests a minute since the start, and the newest latencies' number."""
        minutes = max((time.time() - self.began) / 60, 1 / 60)
        return {"requests": dict(self.calls), "errors": dict(self.errors), "per_minute": round(sum(self.calls.values()) / minutes, 2), "samples": len(self.seconds)}

    def metrics(self) -> list[str]:
        """Lines of the text exposition format."""
        from .operators import usage

        samples = self.engine.spark.createDataFrame([(s,) for s in self.seconds], "seconds double")
        status = self.engine.status().first()
        gauges = {"graph_files": status.files, "graph_symbols": status.symbols, "graph_edges": status.edges, "uptime_seconds": round(time.time() - self.began)}
        lines = usage.prometheus({"requests_total": sum(self.calls.values()), "errors_total": sum(self.errors.values())}, samples, gauges=gauges)
        return [r.line for r in lines.collect()]
