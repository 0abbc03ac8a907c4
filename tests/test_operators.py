"""Operators on small literal inputs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeingraph.functions.names import glob_regex, role
from skeingraph.operators import analytics, documents, export, graph, lookup, search, sync, usage
from skeingraph.sources import changes, conversations, project
from skeingraph.sources.extract import BUILTIN, complexity, raw_metrics
from skeingraph.sources.languages import Analyzer, Extractor, UnknownLanguage, builtin

EDGE = "source string, target string, kind string, source_file string, target_file string"


def edges_of(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, "f", None) for a, b in pairs], EDGE)


def test_walk_is_the_set_of_all_walks(spark):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)}
    e = edges_of(spark, [*pairs, *list(pairs)[:5]])
    level, want = {p for p in pairs if p[0] == "n3"}, set()
    for d in range(1, 5):
        want |= {(*p, d) for p in level}
        level = {q for q in pairs if q[0] in {p[1] for p in level}}
    assert {tuple(r) for r in graph.callees(e, "n3", 4).collect()} == want
    assert graph.callees(e, "n3", 0).count() == sum(p[0] == "n3" for p in pairs)


def test_callers_by_short_name_and_file(spark):
    e = spark.createDataFrame([("caller", "do_work", "calls", "a.py", "b.py"), ("other", "X.Do_Work", "calls", "a.py", "c.py"), ("do_work", "helper", "calls", "b.py", None), ("x", "dosework", "calls", "a.py", None), ("m", "do_work", "imports", "a.py", None)], EDGE)
    assert {r.source for r in graph.callers(e, "MyClass.do_work").collect()} == {"caller", "other"}
    assert {r.target for r in graph.callees(e, "MyClass.do_work").collect()} == {"helper"}
    assert {r.source for r in graph.callers(e, "MyClass.do_work", 1, "b.py").collect()} == {"caller"}
    strict = graph.walk(e, graph.one(spark, "MyClass.do_work"), graph.UP, 1, suffix=False)
    assert {r.source for r in strict.collect()} == {"caller"}


def test_shortest_paths_are_shortest(spark):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)}
    e = edges_of(spark, pairs, "imports")
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    for target in ("n1", "n2", "nowhere", "n0"):
        distance, level, d = {"n0": 0}, {"n0"}, 0
        while level:
            d += 1
            level = {b for a in level for b in out[a]} - set(distance)
            distance |= dict.fromkeys(level, d)
        path = [r.name for r in graph.shortest_path(e, "n0", target).orderBy("step").collect()]
        assert len(path) == (distance[target] + 1 if target in distance else 0)
        assert all(p in pairs for p in zip(path, path[1:]))
    assert graph.shortest_path(e, "n0", "n1", kinds=("calls",)).count() == 0


def test_neighbourhood_caps_and_totals(spark):
    e = edges_of(spark, [("a", f"b{i}") for i in range(9)] + [("z", "a")])
    s = spark.createDataFrame([(i, n, n, "function", "f") for i, n in enumerate(["a", "z", *[f"b{i}" for i in range(8)]])], "id long, name string, qualified_name string, kind string, file_path string")
    shown, inside, totals = graph.neighbourhood_graph(s, e, "a", 1, cap=4)
    assert [r.qualified_name for r in shown.collect()] == ["a", "b0", "b1", "b2"] and inside.count() == 3
    assert tuple(totals.first()) == (10, 6)


def symbols_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, name string, qualified_name string, kind string, signature string, parent_symbol string, file_path string")


def test_search_tiers(spark):
    s = symbols_of(spark, [("do_work_helper", "do_work_helper", "function", None, None, "/a.py"), ("helper_do_work", "helper_do_work", "function", None, None, "/a.py"), ("do_work", "do_work", "function", None, None, "/b.py"), ("work", "work", "class", None, None, "/b.py"), ("MyThing", "MyThing", "variable", None, None, "/b.py"), ("MyThing", "MyThing2", "class", None, None, "/b.py")])
    index = search.of_symbols(s)
    found = [r.symbol_name for r in search.search(index, "do_work").collect()]
    assert found == ["do_work", "do_work_helper", "helper_do_work"]
    assert [r.kind for r in search.search(index, "MyThing").collect()] == ["class", "variable"]
    assert [r.symbol_name for r in search.search(index, "do_work", file_path="/b.py").collect()] == ["do_work"]
    assert {r.symbol_name for r in search.search(index, "do_wor*").collect()} == set(found)
    assert search.search(index, "...").count() == 0
    with pytest.raises(ValueError):
        search.search(index, "a NEAR b")
    assert search.search_words(index, "do_work mything", 5).first().score == 1.0
    assert search.search_words(index, "zzz yyy", 5).count() == 0


def test_cosine_and_hybrid(spark):
    v = spark.createDataFrame([("f1", [1.0, 0.0, 0.0]), ("f2", [0.0, 1.0, 0.0]), ("f3", [0.5, 0.0, 0.0]), ("f4", None), ("f5", [0.0, 0.0, 0.0]), ("f6", [1.0])], "qualified_name string, embedding array<float>")
    found = search.vector_search(v, [1.0, 0.0, 0.0]).collect()
    assert [(r.qualified_name, round(r.similarity, 6)) for r in found] == [("f1", 1.0), ("f3", 1.0), ("f2", 0.0), ("f5", 0.0)]
    t = spark.createDataFrame([("f1", 10.0), ("f2", 5.0)], "qualified_name string, score double")
    w = spark.createDataFrame([("f2", 0.9), ("f3", 0.8)], "qualified_name string, similarity double")
    assert [(r.qualified_name, round(r.combined, 4)) for r in search.hybrid(t, w).collect()] == [("f2", 0.8), ("f3", 0.5333), ("f1", 0.4)]
    assert search.hybrid(t.limit(0), w.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "callers", "callees", "want"), [("UserController", 1, 2, "controller"), ("app.OrderService", 0, 0, "service"), ("orderSTORE", 0, 0, "repository"), ("Orchestrator", 1, 10, "orchestrator"), ("PlainName", 10, 2, "utility"), ("UnknownName", 0, 0, "unknown"), ("Equal", 2, 4, "unknown"), ("PathBuilder", 9, 0, "factory")])
def test_roles(spark, name, callers, callees, want):
    assert spark.range(1).select(role(F.lit(name), F.lit(callers), F.lit(callees)).alias("r")).first().r == want


def test_patterns(spark):
    s = symbols_of(spark, [("create_user", "create_user", "function", "def create_user() -> User:", None, "f"), ("AStrategy", "AStrategy", "class", None, "PaymentStrategy", "f"), ("BStrategy", "BStrategy", "class", None, "PaymentStrategy", "f"), ("Lone", "Lone", "class", None, "Parent", "f"), ("nothing", "nothing", "function", "def nothing() -> None:", None, "f")])
    e = edges_of(spark, [("create_user", "User.__init__"), ("create_user", "User.validate"), ("nothing", "None.x")])
    got = {(r.pattern, r.symbol, r.confidence): r.evidence for r in analytics.patterns(s, e).collect()}
    assert set(got) == {("Factory", "create_user", "low"), ("Strategy", "PaymentStrategy", "medium")}
    assert got["Strategy", "PaymentStrategy", "medium"] == "Abstract base with 2 implementations: AStrategy, BStrategy"


def test_feature_envy(spark):
    e = edges_of(spark, [("do_work", "api.call"), ("do_work", "api.fetch"), ("do_work", "do_work.helper"), ("main", "do_work"), ("main", "balanced"), ("balanced", "balanced.helper"), ("balanced", "balanced.utils")])
    assert [(r.symbol, r.external, r.internal) for r in analytics.feature_envy(e).collect()] == [("do_work", 2, 1)]


DOC = "file string, ingest_seq long, file_hash string, ingested_at string, source string, module_summary string, annotations array<struct<symbol: string, kind: string, summary: string, design_intent: string, pitfalls: string>>, unknowns array<struct<symbol: string, question: string, context: string>>, insights array<struct<insight: string, related_symbols: array<string>>>, metrics struct<complexity: array<struct<name: string, lineno: int, complexity: int, rank: string>>, raw: struct<loc: int, lloc: int, sloc: int, comments: int, multi: int, blank: int>>, odors array<struct<rule: string, symbol: string, severity: string, count: int, lines: int, depth: int, caller_count: int, external: int, internal: int>>, module_roles map<string, string>"


def test_merge(spark):
    a = lambda s, t: (s, "function", t, "", "")
    rows = [
        ("f", 1, "h1", "t1", "x", "first", [a("p", "old"), a("q", "only")], [("p", "why?", "c1")], [("i1", [])], None, [], {"p": "model", "q": "service"}),
        ("f", 2, "h2", "t2", "y", "", [a("r", "new"), a("p", "newer")], [("p", "why?", "c2"), ("p", "how?", "c3")], [("i1", ["p"])], None, [], {"p": "config"}),
        ("g", 1, "h", "t", "x", None, None, None, None, None, None, None),
    ]
    m = {r.file: r for r in documents.merge_documents(spark.createDataFrame(rows, DOC)).collect()}
    f = m["f"]
    assert (f.module_summary, f.file_hash) == ("first", "h2") and [(x.symbol, x.summary) for x in f.annotations] == [("p", "newer"), ("q", "only"), ("r", "new")]
    assert [(x.question, x.context) for x in f.unknowns] == [("why?", "c1"), ("how?", "c3")] and [x.insight for x in f.insights] == ["i1", "i1"] and f.module_roles == {"p": "config", "q": "service"}
    assert m["g"].annotations == [] and m["g"].module_summary == "" and m["g"].module_roles == {}


def test_coverage(spark):
    a = [("s", "function", "t", "", "")]
    docs = spark.createDataFrame([("f", 1, None, None, None, "", a, [], [], None, [], {})], DOC)
    assert documents.coverage(docs, spark.range(5), spark.range(10)).first().coverage == "20.0% files, 10.0% symbols"
    assert documents.coverage(docs.limit(0), spark.range(0), spark.range(0)).first().coverage == "0% files, 0% symbols"


def test_usage(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": 1.0, "tool": "search", "query": "q", "symbols": ["b", "a"]}\nnot json\n{"ts": 2.0, "tool": "node", "symbols": ["a"]}\n{broken\n{"ts": 3.0, "tool": "x", "symbols": ["c", "b"]}\n')
    log = changes.query_log(spark, str(tmp_path))
    assert log.count() == 3
    assert [tuple(r) for r in usage.hot_symbols(log).collect()] == [("b", 2), ("a", 2), ("c", 1)]
    assert [r.symbol for r in usage.hot_symbols(log, first=1).collect()] == ["b", "a"]
    samples = spark.createDataFrame([(x,) for x in (0.0005, 0.02, 0.02, 9.0)], "seconds double")
    lines = [r.line for r in usage.prometheus({"requests_total": 3}, samples).collect()]
    assert lines[1] == "requests_total 3" and 'request_latency_seconds_bucket{le="0.025"} 3' in lines and 'request_latency_seconds_bucket{le="+Inf"} 4' in lines
    assert usage.hit_rate(spark.createDataFrame([], "hit boolean")).first().hit_rate == 0.0


def test_diff_paths(spark):
    d = spark.createDataFrame([("diff --git a/x b/x\n--- a/src/app.py\n+++ b/src/app.py\n@@\n+++ b/new.py\n--- /dev/null",)], "diff string")
    assert {r.path for r in changes.changed_paths(d).collect()} == {"src/app.py", "new.py"}


def test_classify_and_replace(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    stored = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, file_hash string")
    assert dict(sync.classify(disk, stored).collect()) == {"a": "new", "b": "unchanged", "c": "changed", "d": "deleted"}
    before = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, mtime double")
    now = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "path string, mtime double")
    assert {r.path for r in sync.newer(before, now).collect()} == {"b", "c"}


def test_globs(spark):
    for glob, path, hit in (("*.py", "a/b.py", True), ("*.py", "a.pyc", False), ("doc?", "docs", True), ("[ab]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False)):
        assert spark.range(1).select(F.lit(path).rlike(glob_regex(glob)).alias("r")).first().r == hit


PY = '''import os
from a.b import c

COUNT = 0


class Calc(Base):
    def add(self, a, b):
        return helper(a) if a and b else self.sub(a)

    def __init__(self):
        pass


class Other:
    def __init__(self):
        pass


def main():
    Calc().add(1, 2)
'''


def test_python_extractor():
    got = BUILTIN[0].extract("x.py", PY.encode())
    assert [(s["name"], s["kind"], s["parent_symbol"]) for s in got["symbols"]] == [("COUNT", "variable", None), ("Calc", "class", None), ("add", "method", "Calc"), ("__init__", "method", "Calc"), ("Other", "class", None), ("__init__", "method", "Other"), ("main", "function", None)]
    assert {(e["source"], e["target"], e["kind"]) for e in got["edges"]} >= {("<module_level>", "a.b", "imports"), ("<module_level>", "os", "imports"), ("Calc", "Base", "extends"), ("add", "helper", "calls"), ("add", "self.sub", "calls"), ("main", "Calc", "calls")}
    bad = BUILTIN[0].extract("x.py", b"def broken(:\n    pass\nclass Fine:\n    pass\n")
    assert {s["name"] for s in bad["symbols"]} == {"broken", "Fine"} and all(s["is_partial"] for s in bad["symbols"]) and bad["errors"]


SAMPLES = {
    "typescript": ("import { x } from './lib';\nexport interface Shape { area(): number; }\ntype Id = string;\nclass Circle extends Base implements Shape {\n  area(): number {\n    return compute(this.r);\n  }\n}\nconst twice = (n: number) => n * 2;\nfunction run() { new Circle(); log.write('a(b)'); }\n",
                   {("Shape", "interface"), ("Id", "type"), ("Circle", "class"), ("area", "method"), ("run", "function"), ("twice", "function")}, {("run", "log.write", "calls"), ("area", "compute", "calls"), ("Circle", "Base", "extends"), ("Circle", "Shape", "implements"), ("<module_level>", "./lib", "imports")}),
    "go": ("package main\nimport \"fmt\"\ntype Greeter interface { Greet() string }\ntype Person struct { Name string }\nfunc (p *Person) Greet() string { return fmt.Sprintf(\"x\") }\nfunc main() { show(Person{}) }\nfunc show(p Person) {}\n",
           {("Greeter", "interface"), ("Person", "class"), ("Greet", "method"), ("main", "function"), ("show", "function")}, {("main", "show", "calls"), ("Greet", "fmt.Sprintf", "calls"), ("<module_level>", "fmt", "imports")}),
    "rust": ("use std::fmt;\nconst NAME: &str = \"x\";\nstruct Point { x: i32 }\ntrait Area { fn area(&self) -> i32; }\nimpl Area for Point { fn area(&self) -> i32 { square(self.x) } }\nfn main() { run(); }\n",
             {("NAME", "variable"), ("Point", "class"), ("Area", "interface"), ("area", "method"), ("main", "function")}, {("main", "run", "calls"), ("<module_level>", "std::fmt", "imports"), ("Point", "Area", "implements")}),
    "java": ("import java.util.List;\npublic class Calculator extends Base implements Runnable, Closeable {\n  public int add(int a, int b) {\n    return helper(a);\n  }\n}\ninterface Shape { }\n",
             {("Calculator", "class"), ("add", "method"), ("Shape", "interface")}, {("add", "helper", "calls"), ("Calculator", "Base", "extends"), ("Calculator", "Runnable", "implements"), ("Calculator", "Closeable", "implements"), ("<module_level>", "java.util.List", "imports")}),
    "csharp": ("using System;\nclass Program : Base, IGreeter {\n  public static Greeter CreateGreeter() {\n    return Build();\n  }\n}\n", {("Program", "class"), ("CreateGreeter", "method")}, {("CreateGreeter", "Build", "calls"), ("Program", "Base", "extends"), ("Program", "IGreeter", "implements"), ("<module_level>", "System", "imports")}),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_other_extractors(language):
    text, symbols, edges = SAMPLES[language]
    got = builtin().extractors[language].extract("x", text.encode())
    assert symbols <= {(s["name"], s["kind"]) for s in got["symbols"]}
    assert edges <= {(e["source"], e["target"], e["kind"]) for e in got["edges"]}


def test_metrics():
    import ast

    f = ast.parse("def f(x):\n    if x and y:\n        pass\n    for i in [a for a in x if a]:\n        try:\n            pass\n        except E:\n            pass\n").body[0]
    assert complexity(f) == 7
    assert raw_metrics('"""a\nb"""\n\n# c\nx = 1\n') == {"loc": 5, "lloc": 2, "sloc": 1, "comments": 1, "multi": 2, "blank": 1}
    assert raw_metrics("")["loc"] == 0 and raw_metrics("def (")["lloc"] == 0


def test_registry_and_plugins(spark):
    class Shell(Extractor):
        language, extensions = "shell", (".sh",)

        def extract(self, path, source):
            return {"symbols": [], "edges": [], "shapes": [], "errors": ["seen"], "fatal": None}

    class Count(Analyzer):
        name = "count"

        def analyze(self, symbols, callers, callees, source):
            return {"n": len(symbols)}

    r = builtin()
    r.register(Shell())
    r.register(Count())
    assert r.detect("a/B.PY") == "python" and r.detect("x.sh") == "shell" and len(builtin().supported_extensions()) == 15
    with pytest.raises(UnknownLanguage):
        r.detect("README")
    paths = spark.createDataFrame([("a.tsx",), ("b.SH",), ("c",)], "path string")
    assert [x[0] for x in paths.select(r.language_of(F.col("path"))).collect()] == ["typescript", "shell", None]


def test_summary():
    assert project.summary('"""Doc."""\n', "python", "x.py") == "Doc."
    assert project.summary("/*\n * Block\n * two\n */\n", "java", "x") == "Block two"
    assert project.summary("import a\n// a longer comment\n", "go", "x") == "a longer comment"
    assert project.summary("import a\nlet x\n", "rust", "x") == "let x"
    assert project.summary("", "rust", "x.rs") == "rust source file: x.rs"


def test_conversation(spark):
    assert conversations.flat({"messages": [{"content": "a"}, {"content": [{"text": "b"}, {"image": 1}]}, {"text": "c"}, "d"]}) == "a\nb\nc\nd"
    assert conversations.flat({"x": "y" * 51, "z": {"text": "t"}, "short": "s"}) == "y" * 51 + "\nt"
    raw = spark.createDataFrame([(1, '"TODO: add retry logic\\n"'), (2, "function `load` handles rows."), (3, None)], "id int, json string")
    found = {(r.id, r.family, r.symbol, r.statement) for r in conversations.statements(conversations.texts(raw)).collect()}
    assert (1, "pitfalls", "add retry logic", "add retry logic") in found and (2, "summary", "load", "rows") in found
    docs = {r.id: r for r in conversations.statement_documents(conversations.statements(conversations.texts(raw))).collect()}
    assert docs[1].annotations[0].pitfalls == "add retry logic"
    cut = conversations.relevant(spark.createDataFrame([(1, "The cache function stores data rows. Lovely weather we have today, my friend."), (2, "short")], "id int, text string"), ["cache function stores data"])
    assert [tuple(r) for r in cut.collect()] == [(1, "The cache function stores data rows.")]


def test_dot_quotes(spark):
    s = symbols_of(spark, [('a"b', 'a"b', "class", None, None, "f")])
    lines = [r.line for r in export.dot(s, edges_of(spark, [('a"b', "c\nd")])).collect()]
    assert lines[0] == "digraph code {" and lines[-1] == "}"
    assert any(x.startswith('  "a\\"b" [shape=hexagon') for x in lines) and any('"c\\nd"' in x for x in lines)


def test_numbering_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = lookup.numbered(rows, ["k"]).collect()
    assert all(r.position == r.k + 1 for r in got)


def test_walks_over_stored_adjacency(spark, tmp_path):
    """The same walks, and only the buckets of the frontier are read."""
    import random

    rng = random.Random(3)
    names = [f"m{i % 5}.f{i}" if i % 3 else f"F{i}" for i in range(60)]
    rows = [(rng.choice(names), rng.choice(names + ["f7", "F9"]), "calls" if i % 9 else "imports", f"{i % 4}.py", None) for i in range(200)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, source_file string, target_file string")
    at = {}
    for name, table in graph.Adjacency.tables(edges).items():
        table.write.partitionBy("bucket").parquet(str(tmp_path / name))
        at[name] = spark.read.schema(table.schema).parquet(str(tmp_path / name))
    stored = graph.Adjacency(at["edges_out"], at["edges_in"], at["degrees"])
    anchors = spark.createDataFrame([(n,) for n in ("m1.f1", "F9", "x.f7", "none")], "anchor string")
    for way in (graph.UP, graph.DOWN):
        for suffix in (True, False):
            want = sorted(map(tuple, graph.walk(edges, anchors, way, 4, suffix).collect()))
            assert sorted(map(tuple, graph.walk(stored, anchors, way, 4, suffix).collect())) == want
    plan = stored.near(anchors.limit(1), "anchor", graph.DOWN)._jdf.queryExecution().toString()
    assert "PartitionFilters: []" not in plan
    assert graph.callees(stored, "F9", 2).count() == graph.callees(edges, "F9", 2).count()


def test_near_against_brute_force(spark):
    """Random fields of few words: what NEAR finds, and how many places of each phrase lie in a cover."""
    import itertools
    import random

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14))), "q", None, "function", "x.py") for i in range(120)]
    index = search.of_symbols(spark.createDataFrame(rows, "id long, name string, qualified_name string, signature string, kind string, file_path string"))
    for query, phrases, far in (("NEAR(a b, 2)", ["a", "b"], 2), ("NEAR(a a, 1)", ["a", "a"], 1), ('NEAR("a b" c d, 3)', ["a b", "c", "d"], 3), ("NEAR(a b c, 0)", ["a", "b", "c"], 0), ("NEAR(a e)", ["a", "e"], 10), ('name:NEAR(b "c d" "e e", 4)', ["b", "c d", "e e"], 4)):
        want = {}
        for i, text, *_ in rows:
            w = text.split()
            spots = [[(s, len(p.split())) for s in range(len(w)) if w[s : s + len(p.split())] == p.split()] for p in phrases]
            covers = [c for c in itertools.product(*spots) if all(max(s for s, _ in c) - (s + n) <= far for s, n in c)]
            if covers:
                want[i] = tuple(len({c[k] for c in covers}) for k in range(len(phrases)))
        asked, tree = search.parse(query)
        groups = search.near_groups(tree)
        assert groups == [(tuple(range(len(phrases))), far)]
        got = search.near_spots(search.phrase_spots(index, [(k, *p) for k, p in enumerate(asked)]), *groups[0]).where("field = 'symbol_name'").groupBy("doc", "phrase").count().collect()
        assert {(r.doc, r.phrase): r["count"] for r in got} == {(i, k): c for i, n in want.items() for k, c in enumerate(n)}, query
        assert {r.id for r in search.match(index, query).collect()} == set(want)
    both = {r.id for r in search.match(index, "NEAR(a b, 1) AND c").collect()}
    assert both == {r.id for r in search.match(index, "NEAR(a b, 1)").collect()} & {r.id for r in search.match(index, "c").collect()}
    for bad in ("NEAR(a b", "NEAR(a b, x)", "NEAR(a b,"):
        try:
            search.parse(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert search.parse("NEAR(a)") == ([(["a"], False, None)], 0) and search.parse("NEAR()")[1] is None


def test_versions_say_the_same_as_merged_documents(spark):
    """Counts, odors, roles and metrics read from the versions are those of the merged documents, with nothing listed that is not asked for."""
    a = lambda s: (s, "function", "t", "", "")
    odor = ("long_method", "p", "info", None, 60, None, None, None, None)
    rows = [
        ("f", 1, "h1", "t1", "x", "first", [a("p"), a("q")], [("p", "why?", "c1")], [("i1", [])], ([("p", 1, 2, "A")], None), [odor], {"p": "model", "q": "service"}),
        ("f", 2, "h2", "t2", "y", "", [a("r"), a("p")], [("p", "why?", "c2"), ("p", "how?", "c3")], [("i1", ["p"])], (None, (1, 2, 3, 4, 5, 6)), [odor, odor], {"p": "config"}),
        ("g", 1, "h", "t", "x", None, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOC)
    merged = documents.merge_documents(docs)
    key = lambda df: sorted((tuple(sorted(r.asDict(True).items())) for r in df.collect()), key=str)
    assert key(documents.summaries_of(docs)) == key(documents.summaries(merged))
    assert key(documents.odors_of(docs)) == key(merged.select("file", F.explode("odors").alias("o")).select("file", "o.*"))
    assert key(documents.roles_of(docs)) == key(merged.select("file", "metrics", "module_roles"))
    assert key(documents.documented_files(docs)) == key(documents.documented_files(merged))
    plan = documents.summaries_of(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
