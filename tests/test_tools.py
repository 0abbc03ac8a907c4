"""Operations by name, the semantic repository and its homes."""

from __future__ import annotations

import json
import logging

import pytest

from skeingraph import repository as repo
from skeingraph import tools
from skeingraph.engine import Engine


@pytest.fixture
def engine(spark, tmp_path):
    root = tmp_path / "src"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "a.py").write_text("def one():\n    two()\n\n\ndef two():\n    pass\n")
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    e.index(str(root))
    e.annotate("pkg/a.py", "one", "starts")
    e.annotate("pkg/a.py", "one", "starts all")
    e.add_unknown("pkg/a.py", "two", "why?")
    e.add_insight("pkg/a.py", "small", ["one"])
    return e


def test_tools(engine, tmp_path):
    t = tools.Tools(engine)
    assert t.call("search", {}) == {"error": "missing: query"} and "unknown: x" in t.call("search", {"query": "", "x": 1})["error"]
    assert t.call("nothing", {}) == {"error": "no such operation: nothing"} and "error" in t.call("search", {"query": "a NEAR b"})
    assert [r["qualified_name"] for r in t.call("search", {"query": "one"})["rows"]] == ["one"] and t.call("search", {"query": ""}) == {"rows": []}
    assert engine.table("query_log").where("tool = 'search' AND size(symbols) = 1").first().symbols == ["one"]
    assert t.call("node", {"name": "two"})["found"] and t.call("node", {"name": "no"}) == {"found": False, "node": None}
    assert [r["target"] for r in t.call("callees", {"name": "one"})["rows"]] == ["two"]
    found = t.call("semantic_context", {"file": "pkg/a.py"})
    assert found["annotations"][0]["summary"] == "starts all" and len(found["unknowns"]) == len(found["insights"]) == 1
    assert t.call("annotate", {"file": "pkg/a.py", "symbol": "two", "summary": "ends"}) == {"done": True}
    assert t.call("health", {})["status"] == "healthy" and t.call("file_tree", {"part": "PKG"}) == {"pkg": {"a.py": None}}
    path = t.call("save_conversation", {"text": "not json", "to": str(tmp_path)})["path"]
    with open(path.removeprefix("file:")) as f:
        assert set(json.load(f)) == {"text", "saved_at"}
    assert t.counters()["requests"]["search"] == 3 and t.counters()["errors"]["search"] == 3
    lines = t.metrics()
    assert "# TYPE graph_symbols gauge" in lines and "graph_symbols 2" in lines and any(x.startswith("requests_total ") for x in lines)


def test_cut_answers_say_so(engine, monkeypatch):
    monkeypatch.setattr(tools, "LIMIT", 1)
    t = tools.Tools(engine)
    assert len(t.call("search", {"query": "one OR two"})["rows"]) == 1 and t.call("search", {"query": "one OR two"})["truncated"] and "truncated" not in t.call("search", {"query": "one"})
    monkeypatch.setattr(tools, "LIMIT", 1000)
    found = t.call("graph", {"root": "one", "depth": 1})
    assert [n["qualified_name"] for n in found["nodes"]] == ["one", "two"] and found["edges"] == [{"source": "one", "target": "two"}] and not found["truncated"]
    cut = t.call("graph", {"root": "one", "cap": 1})
    assert [n["qualified_name"] for n in cut["nodes"]] == ["one"] and cut["truncated"] and cut["total_available"] == 2
    assert [{k: b[k] for k in ("symbol", "depth", "direction")} for b in cut["truncated_branches"]] == [{"symbol": "two", "depth": 1, "direction": "callee"}]
    assert [r["qualified_name"] for r in t.call("search_plain", {"query": "ones"})["rows"]] == ["one"]


def test_bodies_and_log_lines():
    assert tools.body(b'{"a": 1}') == {"a": 1}
    for raw, status in ((b"", 400), (b"[1]", 400), (b"{", 400), (b" " * (tools.LONGEST_BODY + 1), 413)):
        with pytest.raises(tools.Refused) as e:
            tools.body(raw)
        assert e.value.status == status
    record = logging.LogRecord("x", logging.INFO, "f", 1, "say %s", ("é",), None)
    assert json.loads(tools.JsonLines().format(record)) | {"time": ""} == {"time": "", "level": "INFO", "logger": "x", "message": "say é"}


def test_repository_homes(engine, spark, tmp_path):
    own = repo.repository(spark, engine.home, engine)
    assert isinstance(own, repo.Versions) and isinstance(repo.repository(spark, "jdbc:x:y"), repo.Tables)
    files = repo.repository(spark, str(tmp_path / "json"))
    assert files.versions().count() == 0
    files.save(engine.documents().drop("ingest_seq"))
    (tmp_path / "json" / "other.json").write_text(json.dumps({"file": "other.py", "module_summary": "m"}))
    for r in (own, files):
        assert r.annotation("pkg/a.py", "one").first().summary == "starts all" and r.annotation("pkg/a.py", "zz").count() == 0
        assert [x.question for x in r.relation("unknowns").collect()] == ["why?"] and r.relation("insights", "other").count() == 0
        assert r.module("pkg/a.py").count() == 1 and {x.file for x in r.relation("modules").collect()} - {"other.py"} == {"pkg/a.py"}
    with pytest.raises(ValueError):
        own.relation("others")


def test_documents_of_an_engine(engine, spark, tmp_path):
    root = str(tmp_path / "src")
    (tmp_path / "src" / "b.py").write_text('"""Says b."""\n')
    assert engine.start(root, enabled=False) == {"status": "off"} and engine.start(root) == {"status": "synced", "new": 1} and engine.start(root) == {"status": "fresh"}
    engine.summarize(root)
    assert engine.file_semantics("b.py").first().module_summary == "Says b." and engine.file_semantics("none.py").count() == 0
    engine.ingest_conversation(json.dumps(["nothing to see"]), "b.py")
    assert engine.file_semantics("b.py").first().annotations == []
    none = lambda texts: texts.sparkSession.createDataFrame([], "id int, family string, pattern int, place int, symbol string, statement string")
    own = lambda texts: texts.selectExpr("id", "'summary' AS family", "0 AS pattern", "0 AS place", "'b' AS symbol", "text AS statement")
    engine.ingest_conversation(json.dumps(["hello"]), "b.py", tiers=[none, own])
    assert [a.summary for a in engine.file_semantics("b.py").first().annotations] == ["hello"]
    (tmp_path / "tours").mkdir()
    (tmp_path / "tours" / "one.json").write_text('{"steps": []}')
    (tmp_path / "tours" / "bad.json").write_text("{")
    assert [(r.file, json.loads(r.tour)) for r in engine.tours(str(tmp_path / "tours")).collect()] == [("one.json", {"steps": []})]
    plain = Engine(spark, engine.home, encoder=None)
    assert plain.search_semantic("one").first().qualified_name == "one"
    with pytest.raises(ValueError):
        plain.embed(8)
