"""From a source tree to answers, incrementally; and the streaming forms."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skeingraph import segments
from skeingraph.engine import Engine
from skeingraph.streaming import queries as streams


def test_end_to_end(spark, tmp_path):
    root, home = tmp_path / "src", tmp_path / "home"
    (root / "node_modules").mkdir(parents=True)
    (root / "pkg").mkdir()
    (root / ".gitignore").write_text("# made\nskip_*\n")
    (root / "node_modules" / "x.py").write_text("def no(): pass\n")
    (root / "skip_me.py").write_text("def no(): pass\n")
    (root / "pkg" / "__init__.py").write_text("from .utils import load\n")
    (root / "main.py").write_text("def main():\n    load()\n\n\nclass UserRepository:\n    pass\n")
    (root / "pkg" / "utils.py").write_text("def load():\n    parse()\n\n\ndef parse():\n    pass\n")
    e = Engine(spark, str(home))
    e.init()
    assert e.status().first().last_indexed == "never"
    assert {r.path: r.status for r in e.index(str(root), analyze=True).collect()} == {"main.py": "new", "pkg/__init__.py": "new", "pkg/utils.py": "new"}
    assert [r.target for r in e.callees("main", 2).collect()] == ["load", "parse"]
    assert [r.name for r in e.shortest_path("main", "parse").orderBy("step").collect()] == ["main", "load", "parse"]
    assert e.search("load").first().symbol_name == "load"
    assert {r.symbol for r in e.patterns().collect()} == {"UserRepository"}
    assert e.table("edges").where("target = 'load' AND target_file = 'pkg/utils.py'").count() == 1
    (root / "main.py").write_text("def main():\n    parse()\n")
    (root / "pkg" / "__init__.py").unlink()
    assert {r.path: r.status for r in e.index(str(root)).collect()} == {"main.py": "changed", "pkg/__init__.py": "deleted", "pkg/utils.py": "unchanged"}
    assert [r.target for r in e.callees("main", 2).collect()] == ["parse"]
    assert {r.path for r in e.files().collect()} == {"main.py", "pkg/utils.py"}
    e.annotate("main.py", "main", "starts all")
    e.add_insight("main.py", "small")
    e.add_unknown("main.py", "parse", "why?")
    e.add_insight("main.py", "smaller")
    assert e.annotations("main.py").first().summary == "starts all" and [r.insight for r in e.insights().collect()] == ["small", "smaller"]
    assert e.unknowns().first().reference_count == 2
    e.ingest_conversation(json.dumps({"messages": [{"content": "The function `load` handles files.\n"}]}), "main.py")
    assert {r.symbol for r in e.annotations().collect()} >= {"main", "load"}
    e.log_query("search", "q" * 300, ["a"] * 30)
    assert len(e.table("query_log").first().query) == 200 and e.hot_symbols().first().hits == 20
    e.embed(32)
    assert e.search_semantic("load files", dim=32).count() > 0 and e.context("load parse").count() > 0
    lines = [json.loads(r.json) for r in e.export_lsif().collect()]
    ids = [x["id"] for x in lines]
    assert ids == list(range(1, len(ids) + 1)) and all(x.get("outV", 0) < x["id"] and x.get("inV", 0) < x["id"] for x in lines)
    assert json.loads(e.export_json().first().json)["nodes"]
    e.delete_files(["main.py"])
    assert e.node("main").count() == 0
    e.backup(str(tmp_path / "b.tgz"))
    Engine(spark, str(tmp_path / "again")).restore(str(tmp_path / "b.tgz"))
    assert Engine(spark, str(tmp_path / "again")).files().count() == 1


def test_changed_files_stream(spark, tmp_path):
    scans = tmp_path / "scans"
    scans.mkdir()
    seen = []
    for i, rows in enumerate([[("a", 1.0), ("b", 1.0)], [("a", 1.0), ("b", 2.0)], [("a", None), ("b", 2.0)]]):
        (scans / f"{i}.json").write_text("\n".join(json.dumps({"path": p, "mtime": m}) for p, m in rows))
        changes = streams.changed_files(spark.readStream.schema("path string, mtime double").json(str(scans)))
        streams.sync(changes, lambda df, n: seen.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "cp"), every=None).awaitTermination()
    assert sorted(seen[:2]) == [("a", "new"), ("b", "new")] and seen[2:] == [("b", "changed"), ("a", "deleted")]


def test_late_events_are_left_out(spark, tmp_path):
    at = tmp_path / "events"
    at.mkdir()
    (at / "0.json").write_text('{"ts": "2024-01-01T00:10:00Z", "event_type": "x", "value": 1.0}\n{"ts": "2024-01-01T05:00:00Z", "event_type": "x", "value": 1.0}\n')
    run = lambda: streams.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").json(str(at))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    (at / "1.json").write_text('{"ts": "2024-01-01T00:20:00Z", "event_type": "x", "value": 9.0}\n')
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).select(F.hour("start").alias("h"), "n", "total").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1.0)]


def test_versions_appends_and_writers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    folders = lambda: {p.name for p in (tmp_path / "home").iterdir() if p.name.startswith(("documents-", "query_log-"))}
    for i in range(4):
        e.log_query("search", f"q{i}", ["a"])
        e.add_insight("x.py", f"note {i}")
    assert e.table("query_log").count() == 4 and [r.insight for r in e.insights().collect()] == [f"note {i}" for i in range(4)]
    assert len(folders()) == 10  # one for each row, none rewritten
    seen, tables = e._version()
    e.log_query("search", "other", [])
    try:
        e._commit(seen, tables)
        raise AssertionError("a stale writer went through")
    except RuntimeError:
        pass
    (tmp_path / "home" / "versions" / "999.json").write_text('{"query_')  # a writer that died
    assert e.table("query_log").count() == 5
    (tmp_path / "home" / "versions" / "999.json").unlink()
    e.compact()
    assert len(folders()) == 2 and e.table("query_log").count() == 5 and e.insights().count() == 4


def test_log_in_batches(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "home"), log_every=3)
    e.init()
    before = e._version()[0]
    for i in range(7):
        e.log_query("search", f"q{i}", [f"s{i}"])
    assert e._version()[0] == before + 2 and e.hot_symbols().count() == 7 and e._version()[0] == before + 3
    assert [r.query for r in e.table("query_log").orderBy("ts").collect()] == [f"q{i}" for i in range(7)]


def test_search_reads_its_buckets_and_repeats_from_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LARGE", 0)  # as a large segment is laid out
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("def load_file():\n    pass\n\n\ndef save_file():\n    pass\n")
    (root / "b.py").write_text("class Loader:\n    def load(self):\n        pass\n")
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    e.index(str(root))
    names = lambda q: {r.qualified_name for r in e.search(q).collect()}
    assert names("load") == {"load_file", "Loader.load"} and names("load*") == {"load_file", "Loader.load", "Loader"}
    assert names("load OR save") == {"load_file", "Loader.load", "save_file"} and names("file NOT save") == {"load_file"}
    assert names('"load file"') == {"load_file"} and names("kind:class") == {"Loader"} and names("(load OR save) AND file") == {"load_file", "save_file"}
    for bad in ("load OR", "(load", "size:3", "load)"):
        try:
            e.search(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    from skeingraph.operators import search

    plan = search.phrase_hits(e._index(), [(0, ["load"], False, None)])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters:")[1][:120]
    again = len(e._searches)
    e.search("load", log=True)
    assert len(e._searches) == again and e.table("query_log").first().symbols == [r.qualified_name for r in e.search("load").collect()]
    (root / "c.py").write_text("def load_more():\n    pass\n")
    e.index(str(root))
    assert "load_more" in names("load")
    e.embed(16)
    assert {r.qualified_name for r in e.rerank_semantic("load", dim=16).collect()} >= {"load_file", "load_more"}
    assert {r.hits for r in e.context("load file").collect()} >= {1}


def test_affected_by_named_paths(spark, tmp_path):
    root = tmp_path / "src"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "a.py").write_text("def one():\n    two()\n\n\ndef two():\n    pass\n")
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    e.index(str(root))
    for paths, at in ((["pkg/a.py"], None), ([f"{root}/pkg/a.py"], str(root)), (["/elsewhere/pkg/a.py"], None), (["./pkg/a.py"], None)):
        assert {r.target for r in e.affected(paths=paths, root=at).collect()} == {"two"}
    assert e.affected(paths=["no.py"]).count() == 0


def test_watch(spark, tmp_path):
    import os

    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("def one():\n    pass\n")
    (root / "node_modules" / "x.py").write_text("def no():\n    pass\n")
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    q = e.watch(str(root), str(tmp_path / "cp"), every="100 milliseconds")
    try:
        q.processAllAvailable()
        assert {r.path for r in e.files().collect()} == {"a.py"}
        (root / "b.py").write_text("def two():\n    one()\n")
        os.utime(root / "b.py", (4e9, 4e9))
        q.processAllAvailable()
        assert {r.path for r in e.files().collect()} == {"a.py", "b.py"} and e.node("two").count() == 1
    finally:
        q.stop()
