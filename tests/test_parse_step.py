"""Parsing walks a tree's nodes once, and its rows go to Spark as Arrow, with the same results."""

from __future__ import annotations

import ast

import pytest

from skeingraph.plans.code import MODULE
from skeingraph.sources import extract, project

TEXT = MODULE.replace("{k}", "7").replace("{n}", "3").replace("{m}", "A") + "\nclass C(a.b.D, E[int]):\n    async def f(self, x):\n        return [y.z(1) + g()(2) for y in x if y and not x]\n"


def test_steps_share_the_nodes_of_a_tree(monkeypatch):
    bare = extract._BARE
    whole = [x for x in ast.walk(ast.parse(TEXT)) if not isinstance(x, bare)]
    extract.syntax.cache_clear()
    monkeypatch.setattr(ast, "iter_child_nodes", lambda node: pytest.fail("a step walks the tree by itself"))
    got = extract.Python().extract("a.py", TEXT.encode())
    assert [(e["source"], e["target"]) for e in got["edges"] if e["kind"] == "extends"] == [("Base3", "Root"), ("C", "a.b.D"), ("C", "E[int]")]
    assert {e["target"] for e in got["edges"] if e["kind"] == "calls"} == {"save_3", "load_7", "y.z", "g"}
    assert {x["symbol"]: (x["complexity"], x["nesting"]) for x in got["shapes"] if x["node"] == "function"} == {"load_7": (4, 2), "Base3.get": (1, 0), "Base3.put": (1, 0), "C.f": (4, 0)}
    assert extract.raw_metrics(TEXT)["lloc"] == sum(isinstance(x, ast.stmt) for x in whole)
    assert sorted(type(x).__name__ for x in extract.every(extract.syntax(TEXT)[0])) == sorted(type(x).__name__ for x in whole)


def test_parsed_rows_go_by_arrow(spark, capsys):
    sources = spark.createDataFrame([("a.py", TEXT.encode()), ("b.py", b"def broken(:\n"), ("c.py", None), ("d.zzz", b"x")], "path string, content binary")
    p = project.parse(sources)
    p.explain()
    assert "MapInArrow" in capsys.readouterr().out
    rows = {r.path: r for r in p.collect()}
    assert rows["a.py"].fatal_error is None and rows["a.py"].raw.loc == len(TEXT.splitlines()) and rows["a.py"].symbols[0].name == "LIMIT" and rows["a.py"].symbols[0].is_partial is False
    assert rows["b.py"].errors and all(s.is_partial for s in rows["b.py"].symbols)
    assert "unreadable" in rows["c.py"].fatal_error and rows["c.py"].content_hash is None and rows["c.py"].symbols == []
    assert rows["d.zzz"].language is None and rows["d.zzz"].fatal_error.startswith("UnknownLanguage")
