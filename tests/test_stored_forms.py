"""A stored query writes the forms that it reads, once in a session, and what it does not read is not made."""

from __future__ import annotations

import re

import pytest

from skeingraph import segments
from skeingraph.operators import stemmed
from skeingraph.plans import feeds, plain, stored

SF = "/root/testdata/sf0.001"


@pytest.fixture
def alone(monkeypatch):
    monkeypatch.setattr(stored, "_KEPT", {})
    monkeypatch.setattr(stored, "_PARSED", {})


def written() -> dict[tuple[str, ...], set[str]]:
    return {forms: set(own[0].folders) for (_, _, forms), (_, own) in stored._KEPT.items()}


def test_walks_write_the_sides_that_they_read_once(spark, alone):
    assert stored.QUERIES["stored_callers"](spark, SF).count() > 0
    assert written() == {("edges_in",): {"files", "edges", "edges_in"}}
    stored.QUERIES["stored_impact"](spark, SF)
    both = written()
    assert both == {("edges_in",): {"files", "edges", "edges_in"}, ("edges_out",): {"files", "edges", "edges_out"}}
    stored.QUERIES["stored_neighbourhood"](spark, SF)
    assert written() == both


def test_merges_keep_what_the_log_was_written_for(spark, alone):
    """The merged log has one form, and of it all rows that the log has."""
    merged = stored.QUERIES["merged_segments"](spark, SF).select("source", "target", "kind", "source_file").collect()
    assert written() == {("edges_in",): {"files", "edges", "edges_in"}}
    at, own = stored.log(spark, SF, "edges_in")
    one = at.merge(at.merge(own, 3, ("edges_in",)), 2, ("edges_in",))
    assert [set(s.folders) for s in one] == [{"files", "edges_in"}]
    assert sorted(merged) == sorted(at.live("edges_in", own).select("source", "target", "kind", "source_file").collect()) != []


def test_searches_make_no_edges(spark, alone):
    assert plain.QUERIES["stored_plain_search"](spark, SF).count() > 0
    assert {label for _, _, label in stored._PARSED} == {"symbols", "sources"}


def test_many_terms_are_made_once(spark, alone, monkeypatch):
    """The dictionary comes from the stored postings, and is the one that comes from the symbols."""
    monkeypatch.setattr(segments, "ROWS", 50)
    read, real = [], stemmed.dictionary
    monkeypatch.setattr(stemmed, "dictionary", lambda postings: read.append(bool(postings.inputFiles()) and "postings" in postings.inputFiles()[0]) or real(postings))
    at, own = stored.log(spark, SF, *stored.INDEX, "stems")
    assert True in read
    want = real(at._read("postings", own[0].folders["postings"]))
    assert sorted(map(tuple, at._read("stems", own[0].folders["stems"]).collect())) == sorted(map(tuple, want.collect()))
    assert set(own[0].folders) == {"files", "symbols", "search_docs", "postings", "stems"}


def test_targets_are_looked_up_without_a_sort(spark, monkeypatch, capsys):
    kept = {}
    monkeypatch.setattr(stored, "_parsed", lambda spark, d, label, rows: kept.setdefault(label, rows))
    stored.batches(spark, SF)
    kept["edges"].explain()
    said = capsys.readouterr().out
    assert "ShuffledHashJoin [target" in said and "SortMergeJoin" not in said
    assert kept["edges"].where("target_file IS NOT NULL").count() > 0


def test_a_feed_stores_what_it_compares(spark, alone, monkeypatch):
    """Files and symbols of each version; symbols are not shuffled by their file."""
    seen, real = [], segments.Segments.changes
    monkeypatch.setattr(segments.Segments, "changes", lambda self, before, after: seen.append((after, out := real(self, before, after))) or out)
    assert feeds.QUERIES["change_feed"](spark, SF).count() > 0
    assert len(seen) == 4 and {n for after, _ in seen for s in after for n in s.folders} == {"files", "symbols", "gone"}
    plan = seen[1][1]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_path#" in plan and not re.search(r"hashpartitioning\(file_path#\d+, \d+\)", plan)
