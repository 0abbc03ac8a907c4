"""Queries over source files that are made from the tables, a file for each row, parsed on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, documents, lookup
from ..operators.tables import materialized
from ..sources import project, stores
from .registering import registrar

QUERIES, ORACLES, query = registrar()

#: A customer's module: a docstring, an import, a constant, a function that calls another and branches, a class with two methods.
MODULE = '''"""Customer {k} of {m}."""
import lib_{n}

LIMIT = {k}


# keeps {k}
def load_{k}(a, b, c):
    if a:
        for x in b:
            save_{n}(x)
    return a and b


class Base{n}(Root):
    def get(self, key):
        return load_{k}(key, [], 1)

    def put(self):
        pass
'''


def _sources(spark: SparkSession, d: str) -> DataFrame:
    c = project.dealt(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    text = F.lit(MODULE)
    for mark, column in (("{k}", "c_custkey"), ("{n}", "c_nationkey"), ("{m}", "c_mktsegment")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    path = F.concat(F.lit("m/c_"), F.col("c_custkey").cast("string"), F.lit(".py"))
    return c.select(path.alias("path"), F.encode(text, "utf-8").alias("content"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return materialized(project.parse(_sources(spark, d)), "parsed")


_FILES = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, 'm/c_' || c_custkey || '.py' AS path FROM customer) "


@query(_FILES + "SELECT path AS file_path, x.name, x.kind, x.parent AS parent_symbol, x.line::INT AS start_line FROM (SELECT path, unnest([{name: 'LIMIT', kind: 'variable', parent: NULL, line: 3}, {name: 'load_' || k, kind: 'function', parent: NULL, line: 7}, {name: 'Base' || n, kind: 'class', parent: NULL, line: 14}, {name: 'get', kind: 'method', parent: 'Base' || n, line: 15}, {name: 'put', kind: 'method', parent: 'Base' || n, line: 18}]) AS x FROM c)")
def module_symbols(spark, d):
    return project.relations(_parsed(spark, d), resolve=False)["symbols"].select("file_path", "name", "kind", "parent_symbol", "start_line")


@query(_FILES + "SELECT path AS source_file, x.source, x.target, x.kind FROM (SELECT path, unnest([{source: '<module>', target: 'lib_' || n, kind: 'imports'}, {source: 'load_' || k, target: 'save_' || n, kind: 'calls'}, {source: 'Base' || n, target: 'Root', kind: 'extends'}, {source: 'get', target: 'load_' || k, kind: 'calls'}]) AS x FROM c)")
def module_edges(spark, d):
    e = project.relations(_parsed(spark, d), resolve=False)["edges"]
    return e.select("source_file", F.when(F.col("kind") == "imports", "<module>").otherwise(F.col("source")).alias("source"), "target", "kind")


@query(_FILES + "SELECT path AS source_file, 'load_' || k AS target, path AS target_file, 7 AS target_start_line FROM c")
def module_references(spark, d):
    """Calls whose definition is found, over all files."""
    e = project.relations(_parsed(spark, d))["edges"]
    return e.where("kind = 'calls' AND target_file IS NOT NULL").select("source_file", "target", "target_file", "target_start_line")


@query(_FILES + "SELECT path AS file, x.name, x.line::INT AS lineno, x.c::INT AS complexity, 'A' AS rank FROM (SELECT path, unnest([{name: 'load_' || k, line: 8, c: 4}, {name: 'Base' || n || '.get', line: 16, c: 1}, {name: 'Base' || n || '.put', line: 19, c: 1}]) AS x FROM c)")
def module_complexity(spark, d):
    return project.complexity(project.relations(_parsed(spark, d), resolve=False)["shapes"])


@query(_FILES + "SELECT path AS file, 20 AS loc, 13 AS lloc, 13 AS sloc, 1 AS comments, 0 AS multi, 6 AS blank FROM c")
def module_raw_metrics(spark, d):
    return _parsed(spark, d).select(F.col("path").alias("file"), "raw.*")


@query(_FILES + "SELECT path AS file, 'load_' || k AS symbol, 3 AS parameters, 2 AS nesting FROM c")
def module_shapes(spark, d):
    shapes = project.relations(_parsed(spark, d), resolve=False)["shapes"]
    return shapes.where("symbol LIKE 'load%'").select("file", "symbol", "parameters", "nesting")


@query(_FILES + "SELECT path AS file, 'Customer ' || k || ' of ' || m || '.' AS module_summary, 'auto-analysis' AS source, 3::BIGINT AS functions, 4 AS worst, 20 AS loc, 'A,A,A' AS ranks FROM c")
def analysed_documents(spark, d):
    parsed = _parsed(spark, d)
    docs = project.analysis_documents(project.relations(parsed), parsed)
    c = F.col("metrics.complexity")
    return docs.select("file", "module_summary", "source", F.size(c).cast("long").alias("functions"), F.array_max(F.transform(c, lambda x: x.complexity)).alias("worst"), F.col("metrics.raw.loc").alias("loc"), F.array_join(F.transform(c, lambda x: x["rank"]), ",").alias("ranks"))


@query(_FILES + "SELECT path AS file, x.name, x.c::INT AS complexity FROM (SELECT path, unnest([{name: 'load_' || k, c: 4}, {name: 'Base' || n || '.get', c: 1}, {name: 'Base' || n || '.put', c: 1}]) AS x FROM c WHERE k = 7)")
def complexity_listing(spark, d):
    """Of one file's document."""
    parsed = _parsed(spark, d)
    docs = project.analysis_documents(project.relations(parsed), parsed)
    return documents.complexity_rows(docs, "m/c_7.py").select("file", "name", "complexity")


@query(_FILES + "SELECT path, sha256(path) AS file_hash, left(sha256(path), 16) AS document_key, 'graph_' || left(sha256(path), 8) AS project_schema FROM c")
def short_hashes(spark, d):
    s = _sources(spark, d)
    return s.select("path", F.sha2("path", 256).alias("file_hash"), stores.document_key(F.col("path")).alias("document_key"), stores.project_schema(F.col("path")).alias("project_schema"))


@query(_FILES + "SELECT path, CASE k % 4 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'fine' ELSE 'unknown language' END AS outcome FROM c")
def broken_files(spark, d):
    """Errors are data: a file that does not parse, one that can't be read, one without an extractor."""
    k = F.regexp_extract("path", r"(\d+)", 1).cast("int") % 4
    s = _sources(spark, d).withColumn("content", F.when(k == 0, F.encode(F.lit("def broken(:\n"), "utf-8")).when(k == 1, None).otherwise(F.col("content"))).withColumn("was", F.col("path"))
    s = s.withColumn("path", F.when(k == 3, F.replace("path", F.lit(".py"), F.lit(".zzz"))).otherwise(F.col("path")))
    p = project.parse(s)
    said = F.when(F.contains("fatal_error", F.lit("unreadable")), "unreadable").when(F.col("fatal_error").isNotNull(), "unknown language").when(F.size("errors") > 0, "SyntaxError").otherwise("fine")
    return p.select(F.replace("path", F.lit(".zzz"), F.lit(".py")).alias("path"), said.alias("outcome"))


@query(_FILES + ", up AS (SELECT 'save_' || n AS target, count(*) AS callers FROM c GROUP BY 1) SELECT target AS symbol, callers::INT AS caller_count FROM up WHERE callers > 10")
def module_smells(spark, d):
    """Shotgun surgery in parsed code: names that more than ten functions call."""
    return analytics.shotgun_surgery(project.relations(_parsed(spark, d), resolve=False)["edges"]).select("symbol", "caller_count")


@query(_FILES + "SELECT path, 5 AS symbol_count, 4 AS edge_count, 'python' AS language FROM c")
def module_files(spark, d):
    return lookup.list_files(project.relations(_parsed(spark, d), resolve=False)["files"]).select("path", "symbol_count", "edge_count", "language")


#: A supplier's module in each language: an interface with a method, a class that fulfils it, a function where there are such.
LANGUAGES = {
    'a.ts': '''import { lib{n} } from "./lib_{n}";

interface Shape{k} extends Base{n} {
  area(): number;
}

export class Box{k} extends Root{n} implements Shape{k} {
  area(): number {
    return measure{n}(this);
  }
}

export function make{k}(a: number): Box{k} {
  return build{n}(a);
}

type Alias{k} = string;
const limit{k} = 3;
''',
    'a.go': '''package p{n}

import "lib/{n}"

type Shape{k} interface {
	Area() int
}

type Box{k} struct {
	Side int
}

func (b *Box{k}) Area() int {
	return measure{n}(b)
}

func Make{k}(a int) *Box{k} {
	return build{n}(a)
}

const Limit{k} = 3
''',
    'A.java': '''package p{n};

import lib.Lib{n};

public interface Shape{k} {
    int area();
}

public class Box{k} extends Root{n} implements Shape{k} {
    public int area() {
        return measure{n}(this);
    }
}
''',
    'a.rs': '''use lib::part_{n};

pub trait Shape{k} {
    fn area(&self) -> i32;
}

pub struct Box{k} {
    side: i32,
}

impl Shape{k} for Box{k} {
    fn area(&self) -> i32 {
        measure_{n}(self)
    }
}

pub fn make_{k}(a: i32) -> Box{k} {
    build_{n}(a)
}

const LIMIT_{k}: i32 = 3;
''',
    'A.cs': '''using Lib{n};

namespace P{n}
{
    public interface IShape{k}
    {
        int Area();
    }

    public class Box{k} : Root{n}, IShape{k}
    {
        public int Area()
        {
            return Measure{n}(this);
        }
    }
}
''',
    'a.js': '''import lib{n} from "./lib_{n}";

class Box{k} extends Root{n} {
  area() {
    return measure{n}(this);
  }
}

function make{k}(a) {
  return build{n}(a);
}
''',
}

#: What the modules hold: language, name, kind, parent; {k} is the supplier's key.
HELD = (
    ("a.ts", "Shape{k}", "interface", None), ("a.ts", "area", "method", "Shape{k}"), ("a.ts", "Box{k}", "class", None), ("a.ts", "area", "method", "Box{k}"), ("a.ts", "make{k}", "function", None), ("a.ts", "Alias{k}", "type", None), ("a.ts", "limit{k}", "variable", None),
    ("a.go", "Shape{k}", "interface", None), ("a.go", "Area", "method", "Shape{k}"), ("a.go", "Box{k}", "class", None), ("a.go", "Area", "method", "Box{k}"), ("a.go", "Make{k}", "function", None), ("a.go", "Limit{k}", "variable", None),
    ("A.java", "Shape{k}", "interface", None), ("A.java", "area", "method", "Shape{k}"), ("A.java", "Box{k}", "class", None), ("A.java", "area", "method", "Box{k}"),
    ("a.rs", "Shape{k}", "interface", None), ("a.rs", "area", "method", "Shape{k}"), ("a.rs", "Box{k}", "class", None), ("a.rs", "area", "method", "Box{k}"), ("a.rs", "make_{k}", "function", None), ("a.rs", "LIMIT_{k}", "variable", None),
    ("A.cs", "IShape{k}", "interface", None), ("A.cs", "Area", "method", "IShape{k}"), ("A.cs", "Box{k}", "class", None), ("A.cs", "Area", "method", "Box{k}"),
    ("a.js", "Box{k}", "class", None), ("a.js", "area", "method", "Box{k}"), ("a.js", "make{k}", "function", None),
)
#: And their edges: language, source, target, kind; {n} is the nation's key.
LINKED = (
    ("a.ts", "area", "measure{n}", "calls"), ("a.ts", "make{k}", "build{n}", "calls"), ("a.ts", "<module_level>", "./lib_{n}", "imports"), ("a.ts", "Shape{k}", "Base{n}", "extends"), ("a.ts", "Box{k}", "Root{n}", "extends"), ("a.ts", "Box{k}", "Shape{k}", "implements"),
    ("a.go", "Area", "measure{n}", "calls"), ("a.go", "Make{k}", "build{n}", "calls"), ("a.go", "<module_level>", "lib/{n}", "imports"), ("a.go", "<module_level>", "Box{k}", "type_refs"),
    ("A.java", "area", "measure{n}", "calls"), ("A.java", "<module_level>", "lib.Lib{n}", "imports"), ("A.java", "Box{k}", "Root{n}", "extends"), ("A.java", "Box{k}", "Shape{k}", "implements"),
    ("a.rs", "area", "measure_{n}", "calls"), ("a.rs", "make_{k}", "build_{n}", "calls"), ("a.rs", "<module_level>", "lib::part_{n}", "imports"), ("a.rs", "Box{k}", "Shape{k}", "implements"),
    ("A.cs", "Area", "Measure{n}", "calls"), ("A.cs", "<module_level>", "Lib{n}", "imports"), ("A.cs", "Box{k}", "Root{n}", "extends"), ("A.cs", "Box{k}", "IShape{k}", "implements"),
    ("a.js", "area", "measure{n}", "calls"), ("a.js", "make{k}", "build{n}", "calls"), ("a.js", "<module_level>", "./lib_{n}", "imports"), ("a.js", "Box{k}", "Root{n}", "extends"),
)


def _languages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    modules = F.explode(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])).alias("name", "text")
    k, n = (F.col(c).cast("string") for c in ("s_suppkey", "s_nationkey"))
    rows = project.dealt(s.select("s_suppkey", "s_nationkey", modules), "s_suppkey")
    text = F.replace(F.replace("text", F.lit("{k}"), k), F.lit("{n}"), n)
    sources = rows.select(F.concat(F.lit("s"), k, F.lit("/"), "name").alias("path"), F.encode(text, "utf-8").alias("content"))
    return project.relations(materialized(project.parse(sources), "parsed"), resolve=False)


def _expected(rows: tuple, columns: tuple[str, ...]) -> str:
    said = lambda x: "NULL" if x is None else f"'{x}'"
    values = ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)
    cells = ", ".join(f"replace(replace({c}, '{{k}}', s_suppkey::VARCHAR), '{{n}}', s_nationkey::VARCHAR) AS {c}" for c in columns)
    return f"SELECT 's' || s_suppkey || '/' || file AS path, {cells} FROM supplier, (VALUES {values}) AS t(file, {', '.join(columns)})"


@query(_expected(HELD, ("name", "kind", "parent_symbol")))
def language_symbols(spark, d):
    return _languages(spark, d)["symbols"].select(F.col("file_path").alias("path"), "name", "kind", "parent_symbol")


@query(_expected(LINKED, ("source", "target", "kind")))
def language_edges(spark, d):
    return _languages(spark, d)["edges"].select(F.col("source_file").alias("path"), "source", "target", "kind")


@query("SELECT 's' || s_suppkey || '/' || x.f AS path, x.l AS language FROM (SELECT s_suppkey, unnest([{f: 'a.ts', l: 'typescript'}, {f: 'a.go', l: 'go'}, {f: 'A.java', l: 'java'}, {f: 'a.rs', l: 'rust'}, {f: 'A.cs', l: 'csharp'}, {f: 'a.js', l: 'javascript'}]) AS x FROM supplier)")
def languages(spark, d):
    return _languages(spark, d)["files"].select("path", "language")
