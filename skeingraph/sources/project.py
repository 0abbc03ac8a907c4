"""Source trees as relations: scanning, hashing, parsing on the executors, and resolving references by a join."""

from __future__ import annotations

import ast
import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import complexity_rank, glob_regex, qualified_name
from ..operators.graph import resolve_references
from ..schemas import EDGES, SYMBOLS, columns
from .extract import raw_metrics, syntax
from .languages import Registry, builtin

#: Folders that are never scanned.
EXCLUDED = ("node_modules", "vendor", "dist", "build", "target", ".venv", ".next", "__pycache__", ".git", ".idea", ".vscode")

PARSED = (
    "path STRING, language STRING, content_hash STRING, fatal_error STRING, errors ARRAY<STRING>, summary STRING, "
    "symbols ARRAY<STRUCT<name: STRING, kind: STRING, parent_symbol: STRING, signature: STRING, start_line: INT, start_col: INT, end_line: INT, end_col: INT, is_partial: BOOLEAN>>, "
    "edges ARRAY<STRUCT<source: STRING, target: STRING, kind: STRING, start_line: INT, start_col: INT, end_line: INT, end_col: INT>>, "
    "shapes ARRAY<STRUCT<symbol: STRING, node: STRING, methods: INT, lines: INT, parameters: INT, nesting: INT, complexity: INT, line: INT>>, "
    "raw STRUCT<loc: INT, lloc: INT, sloc: INT, comments: INT, multi: INT, blank: INT>"
)
_TEXTS, _NUMBERS = (lambda names, t=t: [(n, t) for n in names.split()] for t in (pa.string(), pa.int32()))
_PLACE = _NUMBERS("start_line start_col end_line end_col")
_LISTS = {
    "symbols": _TEXTS("name kind parent_symbol signature") + _PLACE + [("is_partial", pa.bool_())], "edges": _TEXTS("source target kind") + _PLACE,
    "shapes": _TEXTS("symbol node") + _NUMBERS("methods lines parameters nesting complexity line"),
}
#: PARSED for Arrow.
_PARSED = pa.schema([
    *_TEXTS("path language content_hash fatal_error"), ("errors", pa.list_(pa.string())), ("summary", pa.string()),
    *[(n, pa.list_(pa.struct(fields))) for n, fields in _LISTS.items()], ("raw", pa.struct(_NUMBERS("loc lloc sloc comments multi blank"))),
])


def ignore_patterns(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def excluded(path: Column, patterns: list[str] = ()) -> Column:
    """Paths relative to the root with an excluded part, or that an ignore pattern (or what lies under it) matches."""
    out = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))
    for p in patterns:
        out = out | path.rlike(glob_regex(p)) | path.rlike(glob_regex(p + "/*"))
    return out


def scan(spark: SparkSession, root: str, registry: Registry | None = None) -> DataFrame:
    """path (relative), mtime: source files under a root on the driver's machine, sorted; links and unreadable folders are skipped.

    The driver lists names (file sources would leave out those that begin with _ or .); executors read them.
    """
    registry = registry or builtin()
    found: list[tuple[str, float]] = []
    patterns = []
    if os.path.isfile(f"{root}/.gitignore"):
        with open(f"{root}/.gitignore", errors="replace") as f:
            patterns = ignore_patterns(f.read())
    todo = [""]
    while todo:
        here = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, here)))
        except OSError:
            continue
        for e in entries:
            rel = f"{here}/{e.name}" if here else e.name
            if e.is_dir(follow_symlinks=False):
                if not e.name.startswith(".") and e.name not in EXCLUDED:
                    todo.append(rel)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1].lower() in registry.by_extension:
                found.append((rel, e.stat().st_mtime))
    df = spark.createDataFrame(sorted(found), "path string, mtime double")
    return df.where(~excluded(F.col("path"), patterns)) if found else df


def stored(spark: SparkSession, root: str, registry: Registry | None = None) -> DataFrame:
    """path (relative), mtime, content of source files under a root in any store that Spark reads, listed and read by the executors.

    Names that begin with _ or . are left out, as file sources do; ignore patterns come from the root's own .gitignore on a local root only.
    """
    registry = registry or builtin()
    ends = ",".join(sorted(e.removeprefix(".") for e in registry.by_extension))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{ends}}}").load(root)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    rows = found.select(F.substring(F.col("path"), F.instr("path", base) + len(base), F.lit(1 << 30)).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")
    return rows.where(~excluded(F.col("path")))


def contents(files: DataFrame, root: str) -> DataFrame:
    """path, content of files (path) under a root that every executor can read; content is null where it can't."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = []
            for p in f["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as h:
                        data.append(h.read())
                except OSError:
                    data.append(None)
            yield pd.DataFrame({"path": f["path"], "content": data})

    return files.select("path").mapInPandas(run, "path string, content binary")


#: How lines begin that only name other modules, and how long a line comment must be to say something.
IMPORTS, LEAST_COMMENT, LONGEST_SUMMARY = ("import ", "from ", "package ", "using ", "#include", "module "), 6, 200
_STARS = re.compile(r"^[ \t]*\*?[ \t]*|[ \t\r]+$", re.MULTILINE)


def _said(text: str) -> Iterator[tuple[int, str]]:
    """(rank, text) of what each part says: the first block comment 0, line comments 1, other lines 2."""
    if block := re.search(r"/\*(.*?)\*/", text, re.DOTALL):
        yield 0, " ".join(filter(None, _STARS.sub("", block[1]).split("\n")))
    for line in map(str.strip, text.split("\n")):
        if line.startswith(("//", "#")):
            comment = line.lstrip("/# \t")
            if len(comment) >= LEAST_COMMENT:
                yield 1, comment
        if line and not line.startswith(IMPORTS):
            yield 2, line


def summary(text: str, language: str, name: str) -> str:
    """A module's first words: docstring, block comment, line comment, first line that imports nothing; 200 characters."""
    found: dict[int, str] = {}
    if language == "python":
        tree, _ = syntax(text)
        found[-1] = ast.get_docstring(tree) or "" if tree else ""
    for rank, said in _said(text):
        if said:
            found.setdefault(rank, said)
    best = min((rank for rank, said in found.items() if said), default=None)
    return f"{language} source file: {name}" if best is None else found[best][:LONGEST_SUMMARY]


#: So many files are parsed by one task.
PER_TASK = 5_000


def dealt(files: DataFrame, *keys: str) -> DataFrame:
    """Rows of a file each, dealt over tasks by their number: parsing takes long for few bytes, and splits go by bytes."""
    return files.repartition(max(1, -(-files.count() // PER_TASK)), *keys)


def parse(sources: DataFrame, registry: Registry | None = None) -> DataFrame:
    """PARSED rows of sources (path, content): one per file, whatever happens to it; errors are data."""
    registry = registry or builtin()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = dict.fromkeys(("loc", "lloc", "sloc", "comments", "multi", "blank"), 0)
        for b in batches:
            rows = []
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                row = {"path": path, "language": None, "content_hash": None, "fatal_error": None, "errors": [], "summary": None, "symbols": [], "edges": [], "shapes": [], "raw": zero}
                try:
                    row["language"] = registry.detect(path)
                    if content is None:
                        raise OSError("unreadable")
                    content = bytes(content)
                    row["content_hash"] = hashlib.sha256(content).hexdigest()
                    text = content.decode("utf-8", "replace")
                    row["summary"] = summary(text, row["language"], os.path.basename(path))
                    got = registry.extractors[row["language"]].extract(path, content)
                    row |= {k: got[k] for k in ("symbols", "edges", "shapes", "errors")} | {"fatal_error": got["fatal"]}
                    if row["language"] == "python":
                        row["raw"] = raw_metrics(text)
                except Exception as e:  # a plug-in may fail in any way; the file's row says so
                    row["fatal_error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)  # by way of pandas, nested columns take as long as parsing

    return sources.select("path", "content").mapInArrow(run, PARSED)


def relations(parsed: DataFrame, resolve: bool = True) -> dict[str, DataFrame]:
    """files, symbols, edges, shapes out of parsed rows; references resolve over all files at once."""
    fine = parsed.where("fatal_error IS NULL")
    s = fine.select(F.col("path").alias("file_path"), F.posexplode("symbols").alias("_n", "s")).select("file_path", "_n", "s.*")
    symbols = s.withColumn("qualified_name", qualified_name(F.col("parent_symbol"), F.col("name"))).withColumn("id", F.xxhash64("file_path", "_n")).select(*columns(SYMBOLS))
    e = fine.select(F.col("path").alias("source_file"), F.explode("edges").alias("e"))
    target = {c: F.lit(None).cast(t).alias(c) for c, t in columns(EDGES).items() if c.startswith("target_")}
    edges = e.select("e.source", "e.target", "e.kind", "source_file", *[F.col(f"e.{c}").alias(f"source_{c}") for c in ("start_line", "start_col", "end_line", "end_col")], *target.values()).select(*columns(EDGES))
    files = parsed.select("path", "language", F.col("content_hash").alias("file_hash"), F.current_timestamp().alias("last_indexed"), F.size("symbols").alias("symbol_count"), F.size("edges").alias("edge_count"), F.size("errors").alias("error_count"), "fatal_error")
    shapes = fine.select("path", F.explode("shapes").alias("x")).select(F.col("path").alias("file"), "x.*")
    return {"files": files, "symbols": symbols, "edges": resolve_references(edges, symbols) if resolve else edges, "shapes": shapes}


def complexity(shapes: DataFrame) -> DataFrame:
    """file, name, lineno, complexity, rank of every function."""
    rows = shapes.where("node = 'function'")
    return rows.select("file", F.col("symbol").alias("name"), F.col("line").alias("lineno"), "complexity", complexity_rank(F.col("complexity")).alias("rank"))


def analysis_documents(rel: dict[str, DataFrame], parsed: DataFrame) -> DataFrame:
    """A semantic document for each file, of what the source alone tells: summary, metrics, smells and roles."""
    from ..operators.analytics import roles, smells

    c = complexity(rel["shapes"]).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("name", "lineno", "complexity", "rank"))).alias("complexity"))
    where = rel["symbols"].select(F.col("qualified_name").alias("symbol"), F.col("file_path").alias("file")).distinct()
    odors = smells(rel["shapes"].select("symbol", "node", "methods", "lines", "parameters", "nesting").distinct(), rel["edges"]).join(where, "symbol")
    odors = odors.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("rule", "symbol", "severity", "count", "lines", "depth", "caller_count", "external", "internal"))).alias("odors"))
    r = rel["symbols"].select("qualified_name", F.col("file_path").alias("file")).join(roles(rel["symbols"], rel["edges"]), "qualified_name").distinct()
    r = r.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("qualified_name", "role")))).alias("module_roles"))
    base = parsed.where("fatal_error IS NULL").select(F.col("path").alias("file"), F.col("content_hash").alias("file_hash"), F.lit("auto-analysis").alias("source"), F.col("summary").alias("module_summary"), "raw")
    out = base.join(c, "file", "left").join(odors, "file", "left").join(r, "file", "left")
    return out.withColumn("metrics", F.struct("complexity", "raw")).drop("complexity", "raw")


def analyze_with(rel: dict[str, DataFrame], registry: Registry, sources: DataFrame | None = None) -> DataFrame:
    """file, analyzer, result (JSON) of every registered analyzer over each file's symbols with their callers and callees, and its text.

    sources: path, content; without them the text is empty.

    A file's symbols are one group, as large as the file; an analyzer that fails leaves its error as the result.
    """
    import json

    from ..operators.lookup import caller_callee_lists

    lists = caller_callee_lists(rel["edges"])
    rows = rel["symbols"].select("file_path", "qualified_name", "name", "kind", "signature")
    rows = rows.join(lists.withColumnRenamed("name", "_n"), F.col("name") == F.col("_n"), "left").drop("_n")
    texts = rows.select(F.concat("file_path", F.lit("")).alias("file_path")).distinct().withColumn("_text", F.lit("")) if sources is None else sources.select(F.col("path").alias("file_path"), F.decode("content", "utf-8").alias("_text"))
    analyzers = registry.analyzers

    def run(group: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame([], columns=["file", "analyzer", "result"])
        said = text["_text"].iloc[0] if len(text) else ""
        symbols = group[["qualified_name", "name", "kind", "signature"]].to_dict("records")
        callers, callees = ({s: list(x) if x is not None else [] for s, x in zip(group["qualified_name"], group[c], strict=True)} for c in ("callers", "callees"))
        out = []
        for name, a in sorted(analyzers.items()):
            try:
                result = json.dumps(a.analyze(symbols, callers, callees, said), default=str)
            except Exception as e:  # a plug-in may fail in any way
                result = json.dumps({"error": f"{type(e).__name__}: {e}"})
            out.append((group["file_path"].iloc[0], name, result))
        return pd.DataFrame(out, columns=["file", "analyzer", "result"])

    return rows.groupBy("file_path").cogroup(texts.groupBy("file_path")).applyInPandas(run, "file string, analyzer string, result string")


def history(root: str, name: str, path: str, limit: int = 5, seconds: int = 10) -> list[str]:
    """Lines of the version history of a function in a file, without diff headers; empty where there is none or git fails."""
    import subprocess

    try:
        said = subprocess.run(["git", "-C", root, "log", f"-L:{name}:{path}", f"-n{limit}"], capture_output=True, text=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return [] if said.returncode else [x for x in said.stdout.splitlines() if not x.startswith(("diff --git", "@@"))]
