"""Exports of the graph: JSON, DOT and LSIF, as tables of lines for a text sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import numbered
from .tables import few, materialized

#: DOT attributes by kind.
NODE_STYLE = {
    "function": 'shape=box style=filled fillcolor="#cfe2ff"',
    "method": 'shape=box style=filled fillcolor="#d1e7dd"',
    "class": 'shape=hexagon style=filled fillcolor="#fff3cd"',
    "interface": 'shape=hexagon style="filled,dashed" fillcolor="#fff3cd"',
    "type": 'shape=ellipse style=filled fillcolor="#e2e3e5"',
    "variable": 'shape=ellipse style="filled,dashed" fillcolor="#f8d7da"',
}
EDGE_STYLE = {
    "calls": '[color="#0d6efd" label="calls"]',
    "imports": '[color="#6c757d" style=dashed label="imports"]',
    "extends": '[color="#198754" style=bold label="extends"]',
    "implements": '[color="#198754" style="bold,dashed" label="implements"]',
    "type_refs": '[color="#6c757d" style=dotted label="type"]',
}
DOT_HEAD = ("rankdir=LR;", "splines=polyline;", "nodesep=0.5;", "ranksep=1.0;", "bgcolor=transparent;", "pad=0.2;", 'fontname="Helvetica";', "fontsize=12;", 'node [shape=box fontname="Helvetica" fontsize=10];', 'edge [fontname="Helvetica" fontsize=8];')
#: LSIF range tags and the schema's version.
RANGE_TAG = {"function": "de", "method": "de", "class": "c", "interface": "struct", "type": "type", "variable": "variable"}
LSIF_VERSION = "0.6.0"


def _style(kind: Column, styles: dict[str, str]) -> Column:
    found = F.lit("")
    for k, v in styles.items():
        found = F.when(kind == k, v).otherwise(found)
    return found


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node and edge: {"node": {...}} or {"edge": {...}}."""
    n = nodes.select(F.to_json(F.struct(F.struct(F.col("qualified_name").alias("id"), F.col("name").alias("label"), "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line")).alias("node"))).alias("line"))
    e = edges.select(F.to_json(F.struct(F.struct("source", "target", "kind").alias("edge"))).alias("line"))
    return n.unionAll(e)


def _first_files(nodes: DataFrame, edges: DataFrame, max_files: int | None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the first max_files files (None: of all), and the calls of them."""
    n = nodes
    if max_files is not None:
        few = nodes.select("file_path").distinct().orderBy("file_path").limit(max_files)
        n = nodes.join(F.broadcast(few), "file_path", "left_semi")
    names = n.select("qualified_name").distinct()
    return n, edges.where("kind = 'calls'").join(names, edges["target"] == names["qualified_name"], "left_semi").select("source", "target", "kind")


def document_lines(nodes: DataFrame, edges: DataFrame, max_files: int | None = None) -> DataFrame:
    """What json_document holds, of all files where max_files does not say how many, as a JSON text for each node and edge: for files of any size."""
    return json_lines(*_first_files(nodes, edges, max_files))


def json_document(nodes: DataFrame, edges: DataFrame, max_files: int = 50) -> DataFrame:
    """One JSON text {nodes, edges} of the first max_files files: a report that must fit a row; document_lines has no such bound."""
    n, e = _first_files(nodes, edges, max_files)
    a = n.agg(F.sort_array(F.collect_list(F.struct(F.col("qualified_name").alias("id"), F.col("name").alias("label"), "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line")))).alias("nodes"))
    b = e.agg(F.sort_array(F.collect_list(F.struct("source", "target", "kind"))).alias("edges"))
    return a.crossJoin(b).select(F.to_json(F.struct("nodes", "edges")).alias("json"))  # one row each


def dot(nodes: DataFrame, edges: DataFrame, name: str = "code") -> DataFrame:
    """part, line: a DOT graph; nodes once by qualified name, edges once by source, target and kind."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, i, x) for i, x in enumerate((f"digraph {name} {{", *(f"  {h}" for h in DOT_HEAD), ""))] + [(3, 0, "}")], "part int, i int, line string")
    n = nodes.where("coalesce(qualified_name, '') <> ''").groupBy("qualified_name").agg(F.min_by(F.struct("kind", "name"), "id").alias("r"))
    label = F.coalesce("r.name", "qualified_name")
    n = n.select(F.lit(1).alias("part"), F.lit(0).alias("i"), F.concat(F.lit('  "'), _quoted(F.col("qualified_name")), F.lit('" ['), _style(F.col("r.kind"), NODE_STYLE), F.lit(' label="'), _quoted(label), F.lit('"];')).alias("line"))
    e = edges.select("source", "target", "kind").distinct()
    e = e.select(F.lit(2).alias("part"), F.lit(0).alias("i"), F.concat(F.lit('  "'), _quoted(F.col("source")), F.lit('" -> "'), _quoted(F.col("target")), F.lit('" '), _style(F.col("kind"), EDGE_STYLE), F.lit(";")).alias("line"))
    return head.unionAll(n).unionAll(e).orderBy("part", "i", "line")


#: Up to so many files are broadcast.
MANY_FILES = 100_000
#: How many lines follow each other of what has lines: the head, a document, a symbol, a call's place, a name's references, a call's and a definition's item.
LSIF_LINES = (2, 2, 7, 2, 1, 1, 1)
_PLACE = ("start_line", "start_col", "end_line", "end_col")


def lsif(files: DataFrame, symbols: DataFrame, edges: DataFrame, root: str = ".", tool: str = "skeingraph") -> DataFrame:
    """id, json: vertices and edges of an LSIF dump with ids from 1 without gaps, in an order that later lines only refer back.

    Symbols and edges without a known file are left out. A name's references are the places that call it.
    Documents, symbols, calls and called names are numbered, not lines: a line's id, and those that it refers to, are sums. Lines are made
    after the sort, which moves one short row for all that follow each other.
    """
    spark = files.sparkSession
    files = few(files.select("path", F.lower(F.coalesce("language", F.lit(""))).alias("language")), "files", MANY_FILES)  # most symbols lie in some files: shuffled by file, one task would read them
    docs = few(numbered(files, ["path"], "_n").select("path", "language", (2 * F.col("_n") + 1).alias("_doc")), "documents", MANY_FILES)
    s = symbols.join(docs.withColumnRenamed("path", "file_path"), "file_path")
    s = numbered(s.select("id", "qualified_name", "kind", "name", "signature", "language", "_doc", *_PLACE), ["qualified_name", "id"], "_n")
    calls = edges.where("kind = 'calls'").join(docs.select(F.col("path").alias("source_file"), "_doc"), "source_file")
    calls = calls.select("source", F.coalesce("target", F.lit("")).alias("target"), "source_file", "_doc", *[F.col(f"source_{c}").alias(c) for c in _PLACE]).distinct()
    calls = materialized(calls.select("target", "_doc", *_PLACE, F.xxhash64("source", "target", "source_file", *_PLACE).alias("_place")), "calls")
    names = numbered(calls.select("target").distinct(), ["target"], "_t")
    calls = numbered(calls.join(names.hint("shuffle_hash"), "target").drop("target"), ["_t", "_place"], "_n")
    linked = numbered(s.join(names, s["qualified_name"] == names["target"]).select(F.col("_n").alias("_s"), "_t"), ["_s"], "_n")
    held = [1, *(x.count() for x in (docs, s, calls, names, calls))]
    before = [sum(n * k for n, k in zip(held[:i], LSIF_LINES, strict=False)) for i in range(len(LSIF_LINES))]

    def first(part: int, number: str) -> Column:
        """The id of the first line of what has a number."""
        return F.lit(before[part] + 1) + LSIF_LINES[part] * (F.col(number) - 1)

    def rows(df: DataFrame, part: int, at: Column, *columns: Column | str) -> DataFrame:
        return df.select(F.lit(part).alias("part"), at.alias("first"), *columns)

    table = [
        rows(spark.range(1), 0, F.lit(1).cast("long")),
        rows(docs, 1, F.col("_doc"), F.col("path").alias("name"), "language"),
        rows(s, 2, first(2, "_n"), F.col("_doc").alias("a"), "kind", "name", "signature", "language", *_PLACE),
        rows(calls, 3, first(3, "_n"), F.col("_doc").alias("a"), *_PLACE),
        rows(names, 4, first(4, "_t")),
        rows(calls, 5, first(5, "_n"), first(4, "_t").alias("a"), first(3, "_n").alias("b")),
        rows(linked, 6, first(6, "_n"), (first(2, "_s") + 4).alias("a"), first(4, "_t").alias("b")),
    ]
    ordered = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), table).orderBy("first")
    step = F.explode(F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, LSIF_LINES)), F.col("part") + 1) - 1)).alias("step")
    lines = ordered.select("*", step).withColumn("id", F.col("first") + F.col("step"))

    uri = f"file://{root}"
    a, b, own = F.col("a"), F.col("b"), F.col("first")
    text = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")

    def line(label: str, out: Column | None = None, to: Column | None = None, many: bool = False, **fields: Column) -> Column:
        body = F.to_json(F.struct(F.lit("vertex" if out is None else "edge").alias("type"), F.lit(label).alias("label"), *[v.alias(k) for k, v in fields.items()]))
        ends = [] if out is None else [',"outV":', out, *([',"inVs":[', to, "]"] if many else [',"inV":', to])]
        return F.concat(*map(text, ['{"id":', F.col("id"), *ends, ","]), F.substring(body, 2, 1 << 30))

    start, end = F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("character")), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("character"))
    hover = F.struct(F.struct("language", F.concat(F.coalesce("kind", F.lit("")), F.lit(" "), "name", F.lit(": "), F.coalesce("signature", F.lit(""))).alias("value")).alias("contents"))
    made = {
        0: [line("metaData", version=F.lit(LSIF_VERSION), projectRoot=F.lit(uri), toolInfo=F.struct(F.lit(tool).alias("name"))), line("project", kind=F.lit("code"), resource=F.lit(uri))],
        1: [line("document", uri=F.concat(F.lit("file://"), "name"), languageId=F.col("language")), line("contains", F.lit(2), own, True)],
        2: [
            line("range", start=start, end=end, tag=_style(F.col("kind"), RANGE_TAG)), line("contains", a, own, True),
            line("hoverResult", result=hover), line("textDocument/hover", own, own + 2),
            line("definitionResult"), line("textDocument/definition", own, own + 4), line("item", own + 4, own, True, property=F.lit("definitions")),
        ],
        3: [line("range", start=start, end=end, tag=F.lit("ref")), line("contains", a, own, True)],
        4: [line("referenceResult")],
        5: [line("item", a, b, True, property=F.lit("references"))],
        6: [line("item", a, b, True, property=F.lit("references"))],
    }
    json = F.coalesce(*[F.when((F.col("part") == p) & (F.col("step") == i), x) for p, own_lines in made.items() for i, x in enumerate(own_lines)])
    return lines.select("id", json.alias("json"))
