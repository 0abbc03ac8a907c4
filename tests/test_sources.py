"""Stores, generated projects and table functions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skeingraph.sources import project, stores, table_functions


def test_semantic_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file": "a.py", "module_summary": None, "annotations": [{"symbol": "f", "kind": "function", "summary": "s", "design_intent": "", "pitfalls": ""}], "unknown_key": 1}, indent=1))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.txt").write_text("{}")
    rows = stores.semantic_documents(spark, str(tmp_path)).collect()
    assert [(r.file, r.module_summary, r.annotations[0].symbol, r.unknowns, r.module_roles) for r in rows] == [("a.py", "", "f", [], {})]
    key = spark.range(1).select(stores.document_key(F.lit("a.py")).alias("k"), stores.project_schema(F.lit("/p")).alias("s")).first()
    assert len(key.k) == 16 and key.s.startswith("graph_") and len(key.s) == 14


def test_saved_conversation():
    assert json.loads(stores.saved_conversation("plain"))["text"] == "plain"
    assert set(json.loads(stores.saved_conversation('{"messages": []}'))) == {"messages", "saved_at"}


def test_generated_project_parses(spark):
    sources = stores.synthetic_project(spark, files=60, functions=5, profile="complex").repartition(4)
    assert sources.subtract(stores.synthetic_project(spark, files=60, functions=5, profile="complex")).count() == 0
    rel = project.relations(project.parse(sources))
    assert rel["symbols"].count() == 300 and rel["files"].where("fatal_error IS NOT NULL").count() == 0
    calls = rel["edges"].where("kind = 'calls'")
    assert 0.15 < calls.count() / 300 < 0.45 and calls.where("target_file IS NULL").count() == 0
    ranks = {r["rank"] for r in project.complexity(rel["shapes"]).select("rank").distinct().collect()}
    assert {"A", "B", "C"} <= ranks


def test_serial_and_parallel_parsing_agree(spark):
    sources = stores.synthetic_project(spark, files=40)
    one, many = (project.parse(sources.repartition(n)).select("path", F.size("symbols").alias("s"), F.size("edges").alias("e")) for n in (1, 8))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([("a.py", bytearray(b"def f():\n    g()\n")), ("x.unknown", bytearray(b"?")), ("b.py", None)], "path string, content binary").createOrReplaceTempView("sources")
    assert [r.name for r in spark.sql("SELECT path, s.name FROM sources, LATERAL source_symbols(path, content) s").collect()] == ["f"]
    assert [(r.source, r.target) for r in spark.sql("SELECT e.* FROM sources, LATERAL source_edges(path, content) e").collect()] == [("f", "g")]


def test_analyzers_run_per_file(spark):
    from skeingraph.sources.languages import Analyzer, builtin

    class Count(Analyzer):
        name = "count"

        def analyze(self, symbols, callers, callees, source):
            return {"n": len(symbols), "called": sum(map(len, callers.values()))}

    class Bad(Analyzer):
        name = "bad"

        def analyze(self, symbols, callers, callees, source):
            raise RuntimeError("no")

    r = builtin()
    r.register(Count())
    r.register(Bad())
    sources = spark.createDataFrame([("a.py", bytearray(b"def f():\n    g()\n\ndef g():\n    pass\n"))], "path string, content binary")
    got = {x.analyzer: json.loads(x.result) for x in project.analyze_with(project.relations(project.parse(sources)), r).collect()}
    assert got == {"count": {"n": 2, "called": 1}, "bad": {"error": "RuntimeError: no"}}


def test_config(tmp_path, monkeypatch):
    from skeingraph.config import load

    (tmp_path / "skeingraph.toml").write_text('git_log_count = 7\nother = 1\nsearch_limit = 3\n')
    monkeypatch.setenv("SKEINGRAPH_SEARCH_LIMIT", "9")
    c = load(str(tmp_path))
    assert (c.git_log_count, c.search_limit, c.max_depth) == (7, 9, 5)


def test_history_of_nothing(tmp_path):
    assert project.history(str(tmp_path), "f", "a.py") == []


def test_database(spark):
    """A relation written to a database and read back in ranges of its key."""
    url, driver = "jdbc:derby:memory:relations;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).selectExpr("id", "'s' || id AS name")
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "symbols").save()
    got = stores.database(spark, url, "symbols", key="id", low=0, high=100, parts=4, driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in got.collect()) == [(i, f"s{i}") for i in range(100)]


def test_stored_tree_is_the_scanned_one(spark, tmp_path):
    from skeingraph.engine import Engine

    (tmp_path / "src" / "pkg" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "a b.py").write_text("def one():\n    pass\n")
    (tmp_path / "src" / "pkg" / "node_modules" / "x.py").write_text("def no():\n    pass\n")
    (tmp_path / "src" / "notes.txt").write_text("no")
    (tmp_path / "src" / "b.go").write_text("package b\n\nfunc Two() {}\n")
    found = {}
    for name, root in (("local", str(tmp_path / "src")), ("address", f"file://{tmp_path}/src")):
        e = Engine(spark, str(tmp_path / name))
        e.init()
        e.index(root)
        found[name] = sorted(tuple(r) for r in e.files().select("path", "file_hash", "symbol_count").collect())
        assert {r.status: r.n for r in e.freshness(root).collect()} == {"unchanged": 2}
    assert found["local"] == found["address"] and len(found["local"]) == 2


def test_files_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """One small split of many files is parsed by several tasks, and no file is lost or parsed twice."""
    from skeingraph.plans import code

    monkeypatch.setattr(project, "PER_TASK", 50)
    rows = spark.range(200).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey", "'M' AS c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sources = code._sources(spark, str(tmp_path))
    assert sources.rdd.getNumPartitions() == 4 and sources.where(F.spark_partition_id() == 0).count() < 100
    assert sorted(r.path for r in project.parse(sources).where("fatal_error IS NULL").collect()) == sorted(f"m/c_{i}.py" for i in range(200))
    assert project.dealt(rows.limit(0), "c_custkey").count() == 0


def test_conversations_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from skeingraph.plans import records

    monkeypatch.setattr(project, "PER_TASK", 50)
    spark.range(200).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey", "'M' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    said = records._said(spark, str(tmp_path))
    assert said.rdd.getNumPartitions() == 4 and sorted(r.id for r in said.collect()) == list(range(200))
