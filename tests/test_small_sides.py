"""Large sides are not shuffled for small ones, and no list grows with the input."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skeingraph.operators import documents, export, graph, tables
from skeingraph.sources import star

SF = "/root/testdata/sf0.001"


@pytest.fixture
def spark_alone(spark):
    """Without Spark's own choice of small sides, which comes after both are shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_rows_are_broadcast_and_many_are_not(spark_alone):
    big, side = spark_alone.range(100), spark_alone.range(5)
    assert "BroadcastHashJoin" in plan(big.join(tables.few(side, "side"), "id"))
    assert "BroadcastHashJoin" not in plan(big.join(tables.few(side, "side", 4), "id"))


def test_ordered_md5(spark):
    rows = [(k, i, f"é{k}{i}" if i % 7 else "") for k in ("a", "b", "c") for i in range(3000)] + [("n", 1, None), ("c", 3000, None), ("e", 1, "")]
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    found = tables.ordered_md5(spark.createDataFrame(mixed, "k string, i int, t string").repartition(7), ["k"], ["i"], "t")
    want = {k: hashlib.md5(",".join(t for kk, _, t in rows if kk == k and t is not None).encode()).hexdigest() for k in "abce"}
    assert {r.k: r.md5 for r in found.collect()} == want


def test_merged_digests_are_those_of_merged_documents_without_their_lists(spark):
    from skeingraph.plans import records

    versions = records._versions(spark, SF)
    said = lambda c, f: F.md5(F.array_join(F.transform(c, f), ",")).alias(c)
    roles = F.transform(F.array_sort(F.map_entries("module_roles")), lambda e: F.concat(e["key"], e["value"]))
    want = documents.merge_documents(versions).select(
        "file", "ingested_at", "module_summary", said("annotations", lambda a: F.concat(a["symbol"], a["summary"])), said("unknowns", lambda u: F.concat(u["symbol"], u["question"], u["context"])),
        said("insights", lambda i: F.concat(i["insight"], i["related_symbols"][0])), F.md5(F.array_join(roles, ",")).alias("roles"),
    )
    found = documents.merged_digests(versions)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "collect_list" not in plan(records.merged_documents(spark, SF))


def test_walks_do_not_shuffle_edges(spark_alone):
    edges = spark_alone.createDataFrame([(f"a{i}", f"a{i + 1}", "calls") for i in range(50)], "source string, target string, kind string")
    found = graph.walk(edges, graph.one(spark_alone, "a3"), graph.DOWN, 3)
    assert sorted(r.source for r in found.collect()) == ["a3", "a4", "a5"]
    assert "BroadcastHashJoin [source" in plan(found)


def test_discovery_looks_up_only_the_names_it_meets(spark_alone):
    symbols = star.symbols(spark_alone, SF)
    found = graph.discovery(symbols, star.edges(spark_alone, SF), "part_9", 2, 20)
    assert "BroadcastHashJoin [qualified_name" in plan(found["nodes"]) and found["nodes"].count() == 20


def test_context_does_not_shuffle_by_file(spark_alone):
    results = spark_alone.createDataFrame([("x", "f.py"), ("d.y", "f.py"), ("z", "g.py")], "qualified_name string, file_path string")
    edges = spark_alone.createDataFrame([("x", "y", "calls"), ("x", "y", "calls"), ("x", "d.y", "calls"), ("z", "y", "calls")], "source string, target string, kind string")
    docs = spark_alone.createDataFrame([("f.py", "about f")], "file string, module_summary string")
    found = documents.context(results, edges, docs)
    assert "hashpartitioning(file_path" not in plan(found)
    assert sorted(map(tuple, found.select("qualified_name", "callers", "n_callers", "callees", "n_callees", "module_summary").collect()), key=lambda r: r[0]) == [
        ("d.y", ["x", "z"], 2, [], 0, "about f"), ("x", [], 0, ["d.y", "y"], 2, "about f"), ("z", [], 0, ["y"], 1, None),
    ]


def test_lsif_attaches_files_without_a_shuffle(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(export, "few", lambda rows, label, most: kept.append(label) or tables.few(rows, label, most))
    from skeingraph.plans import records

    export.lsif(*records._placed(spark, SF)).count()
    assert kept == ["files", "documents"]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_context_of_many_results_is_that_of_few(spark, monkeypatch, most):
    """Dotted and bare names that share callers, repeated and null ends, results of one name, a name that everything calls: as by sets, and no edge is joined to a result."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)] + [f"c{i % 3}.n{i}" for i in range(12)] + ["d.c1.n1", "x."]
    edges = [(rng.choice(names), rng.choice(names[4:]), "calls" if rng.random() < 0.9 else "imports") for _ in range(400)]
    edges += [(f"m{i:05}", "n1", "calls") for i in range(25_000)] + [(None, "n2", "calls"), ("n2", None, "calls")]
    results = [(i, q, "f.py") for i, q in enumerate([*names, *names[:5], "nobody", None])]
    rows = spark.createDataFrame(results, "id int, qualified_name string, file_path string")
    calls = spark.createDataFrame(edges, "source string, target string, kind string").repartition(5)
    docs = spark.createDataFrame([("f.py", "about f")], "file string, module_summary string")
    monkeypatch.setattr(documents, "ASKED", 5)
    found = documents.context(rows, calls, docs, most)
    want = {}
    for i, q, _ in results:
        mine = {q, (q or "").rsplit(".", 1)[-1]}
        up, down = ({e[a] for e in edges if e[2] == "calls" and e[b] in mine and None not in e[:2]} if q is not None else set() for a, b in ((0, 1), (1, 0)))
        want[i] = (sorted(up)[:most], len(up), sorted(down)[:most], len(down), "about f")
    assert {r[0]: tuple(r)[1:] for r in found.select("id", "callers", "n_callers", "callees", "n_callees", "module_summary").collect()} == want
    few = documents.context(rows.where("qualified_name = 'n2'"), calls, docs, most).collect()  # joined to the edges: the same, null ends included
    assert {r.id: (r.callers, r.n_callers, r.callees, r.n_callees, r.module_summary) for r in few} == {i: want[i] for i, q, _ in results if q == "n2"}
    assert "WindowGroupLimit" not in plan(found) and "rangepartitioning(name" in plan(found)
