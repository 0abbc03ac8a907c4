"""Registered exports and reports over the whole graph, against counts made in Python."""

from __future__ import annotations

import json

from skeingraph.operators import export, lookup
from skeingraph.plans import records, registry
from skeingraph.sources import star

SF = "/root/testdata/sf0.001"


def test_lsif_has_every_file(spark):
    files = {r.path for r in star.files(spark, SF).collect()}
    symbols = star.symbols(spark, SF).collect()
    calls = {(r.source, r.target, r.source_file, r.source_line) for r in star.edges(spark, SF).collect() if r.kind == "calls" and r.source_file in files}
    targets = {c[1] for c in calls}
    lines = [json.loads(r.json) for r in export.lsif(*records._placed(spark, SF)).collect()]
    assert {x["uri"].removeprefix("file://") for x in lines if x["label"] == "document"} == files
    assert sum(x["label"] == "hoverResult" for x in lines) == len(symbols)
    linked = sum(s.qualified_name in targets for s in symbols)
    assert len(lines) == 2 + 2 * len(files) + 7 * len(symbols) + 3 * len(calls) + len(targets) + linked
    assert [x["id"] for x in lines] == list(range(1, len(lines) + 1))


def test_json_document_has_every_kind_and_fifty_files(spark):
    symbols = star.symbols(spark, SF).collect()
    few = set(sorted({s.file_path for s in symbols})[:50])
    document = json.loads(export.json_document(star.symbols(spark, SF), star.edges(spark, SF)).first().json)
    assert len({n["file"] for n in document["nodes"]}) == len(few) > 20
    assert sorted(n["id"] for n in document["nodes"]) == sorted(s.qualified_name for s in symbols if s.file_path in few)
    assert {n["kind"] for n in document["nodes"]} == {s.kind for s in symbols if s.file_path in few} >= {"method"}


def test_encoded_search_ranks_every_symbol(spark, monkeypatch):
    from skeingraph.operators import search

    seen = []
    ranked = search.vector_search
    monkeypatch.setattr(search, "vector_search", lambda stored, *a, **b: seen.append(stored) or ranked(stored, *a, **b))
    assert registry.queries()["encoded_search"](spark, SF).count() == 10
    assert seen[0].count() == star.symbols(spark, SF).count()


def test_numbers_of_many_rows(spark):
    """Three million rows with another column: every number once, in order."""
    from pyspark.sql import functions as F

    rows = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), "id").alias("p"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = lookup.numbered(rows, ["k"])
        one = got.agg(F.count_distinct("position").alias("n"), F.max("position").alias("m"), F.min("position").alias("least")).first()
        assert tuple(one) == (3_000_000, 3_000_000, 1)
        order = got.where("position % 1000 = 0").orderBy("position").select("k").collect()
        assert [r.k for r in order] == sorted(r.k for r in order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.catalog.clearCache()


def test_document_lines_hold_what_the_document_holds(spark):
    """As many rows as nodes and calls, so no row grows with the files."""
    symbols, edges = star.symbols(spark, SF), star.edges(spark, SF)
    whole = json.loads(export.json_document(symbols, edges, 7).first().json)
    lines = [json.loads(r.line) for r in export.document_lines(symbols, edges, 7).collect()]
    key = lambda x: sorted(json.dumps(y, sort_keys=True) for y in x)
    assert key(x["node"] for x in lines if "node" in x) == key(whole["nodes"]) and key(x["edge"] for x in lines if "edge" in x) == key(whole["edges"])
    assert len(lines) == len(whole["nodes"]) + len(whole["edges"]) > 7


def test_lsif_numbers_what_has_lines_and_looks_no_line_up(spark, monkeypatch):
    """Ids are sums over numbered documents, symbols, calls and names: no line is numbered or found by a key. Two symbols of one id have lines of their own."""
    counted, real = [], lookup.numbered
    monkeypatch.setattr(export, "numbered", lambda rows, *a: counted.append(rows.count()) or real(rows, *a))
    files, symbols, edges = records._placed(spark, SF)
    again = symbols.where("id = 1000").unionAll(symbols.where("id <= 1000"))
    lines = [json.loads(r.json) for r in export.lsif(files, again, edges).collect()]
    assert [x["id"] for x in lines] == list(range(1, len(lines) + 1))
    assert sum(x["label"] == "hoverResult" for x in lines) == again.count()
    assert max(counted) == edges.where("kind = 'calls'").select("source", "target", "source_file", "source_start_line").distinct().join(files.select("path"), edges["source_file"] == files["path"], "left_semi").count()


def test_json_document_reads_its_whole_table(spark):
    """Every symbol of every file, and every call into one; there are more files than the fifty of a report in one row."""
    symbols = star.symbols(spark, SF).collect()
    many = [(f"src/f{n:02}.py", f"s{n}") for n in range(60)]
    names = {s.qualified_name for s in symbols}
    rows = records.json_document(spark, SF).collect()
    assert sorted(r.a for r in rows if r.d is not None) == sorted(s.qualified_name for s in symbols)
    assert sorted((r.a, r.b) for r in rows if r.d is None) == sorted((e.source, e.target) for e in star.edges(spark, SF).collect() if e.kind == "calls" and e.target in names)
    nodes = spark.createDataFrame([(p, q, q, "function", 1) for p, q in many], "file_path string, qualified_name string, name string, kind string, start_line int")
    edges = spark.createDataFrame([(q, many[-1][1], "calls") for _, q in many], "source string, target string, kind string")
    assert export.document_lines(nodes, edges).count() == 120
