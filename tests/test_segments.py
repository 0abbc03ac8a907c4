"""The log of segments against rebuilding everything, and the tree stream against what was done to the tree."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from skeingraph import segments
from skeingraph.engine import Engine
from skeingraph.operators import graph, search, sync
from skeingraph.streaming import queries as streams

SYMBOLS = "id long, file_path string, name string, qualified_name string, kind string, signature string"
EDGES = "source string, target string, kind string, source_file string, target_file string"


def relations(spark, files: dict[str, int]):
    """Files with a content number: symbols and edges that follow from it."""
    s = [(hash((f, i)) % 10**9, f, f"n{v}_{i}", f"{f[:-3]}.n{v}_{i}", "function" if i % 2 else "class", f"def n{v}(word{v % 3})") for f, v in files.items() for i in range(v % 4 + 1)]
    e = [(f"{f[:-3]}.n{v}_0", f"f{j}.n{v}_0", "calls" if j % 3 else "imports", f, f"f{j}.py") for f, v in files.items() for j in range(v % 5)]
    return {"files": spark.createDataFrame([(f, str(v)) for f, v in files.items()], "path string, file_hash string"), "symbols": spark.createDataFrame(s, SYMBOLS), "edges": spark.createDataFrame(e, EDGES)}, s, e


@pytest.mark.parametrize("small, large", [(2000, 0), (2000, 9999), (3, 9999)])
def test_log_equals_a_rebuild(spark, tmp_path, monkeypatch, small, large):
    monkeypatch.setattr(segments, "SMALL", small)
    monkeypatch.setattr(segments, "LARGE", large)
    rng, at = random.Random(4), segments.Segments(spark, str(tmp_path))
    log, state, symbols, edges = [], {}, [], []
    for step in range(9):
        names = [f"f{i}.py" for i in range(12)] if step == 0 else [f"f{rng.randrange(14)}.py" for _ in range(rng.randrange(3))]
        gone = [] if step == 0 else rng.sample(sorted(state), min(len(state), rng.randrange(3)))
        now = {n: rng.randrange(50) for n in names if n not in gone}
        new, s, e = relations(spark, now)
        out = [(p, True) for p in gone] + [(p, False) for p in now if p in state]
        symbols = [r for r in symbols if r[1] not in gone and r[1] not in now] + s
        edges = [r for r in edges if r[3] not in gone and r[3] not in now and r[4] not in gone] + e
        state = {k: v for k, v in state.items() if k not in gone} | now
        log = at.settled([*log, at.write(new, spark.createDataFrame(out, segments.GONE))])
    live = lambda n, *c: Counter(map(tuple, at.live(n, log).select(*c).collect()))
    assert len(log) < 6 and live("files", "path") == Counter((p,) for p in state)
    assert live("symbols", *[c.split()[0] for c in SYMBOLS.split(", ")]) == Counter(symbols)
    for n in ("edges", "edges_out", "edges_in"):
        assert live(n, *[c.split()[0] for c in EDGES.split(", ")]) == Counter(edges)
    whole = search.of_symbols(spark.createDataFrame(symbols, SYMBOLS))
    stored = search.Index(at.live("search_docs", log), at.live("postings", log))
    for q in ("word1", "n7 OR word0", "kind:class NOT word2"):
        rank = lambda i: sorted((r.id, round(r.rank, 9)) for r in search.match(i, q).collect())  # noqa: B023, E731
        assert rank(stored) == rank(whole)
    flat, near = spark.createDataFrame(edges, EDGES), graph.Adjacency(*(at.live(n, log) for n in ("edges_out", "edges_in", "degrees")))
    roots = Counter(r[0] for r in edges).most_common(2)
    for kinds in (("calls",), None):
        for root, _ in roots:
            assert sorted(map(tuple, graph.neighbourhood(near, root, 3, kinds).collect())) == sorted(map(tuple, graph.neighbourhood(flat, root, 3, kinds).collect()))
    for a, _ in roots:
        for b in {r[1] for r in edges[:6]}:
            assert graph.shortest_path(near, a, b).count() == graph.shortest_path(flat, a, b).count()
    whole = at.merge(log, len(log)) if len(log) > 1 else log
    assert whole[0].gone == 0 or len(log) == 1
    assert Counter(map(tuple, at.live("symbols", whole).select("id", "file_path").collect())) == Counter((r[0], r[1]) for r in symbols)


def test_when_segments_are_merged():
    for sizes, n in (([1024, 1, 1, 1], 0), ([1024, 1, 1, 1, 1], 4), ([1024, 4, 1, 1, 1, 1], 5), ([1024, 4, 4, 1, 4], 4), ([4, 1, 1, 1], 0), ([1, 1, 1, 1], 4), ([1, 1, 1], 0), ([], 0)):
        assert segments.mergeable(sizes) == n
    sizes, written = [4**8], 0  # one file at a time into 65,536
    for _ in range(4**5):
        sizes.append(1)
        while n := segments.mergeable(sizes):
            written += sum(sizes[-n:])
            sizes[-n:] = [sum(sizes[-n:])]
        assert len(sizes) < 10
    assert sizes[0] == 4**8 and written <= 8 * 4**5


def size_of(home) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(home) for f in names if f.endswith(".parquet"))


def test_a_changed_file_writes_its_own_rows(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for i in range(300):
        (root / f"m{i}.py").write_text("".join(f"def f_{i}_{j}(a):\n    f_{(i * 7 + 1) % 300}_{j}()\n\n\n" for j in range(20)))
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    e.index(str(root))
    first = size_of(e.home)
    (root / "m7.py").write_text("def changed(a):\n    f_3_3()\n")
    e.ingest_paths(spark.createDataFrame([("m7.py",)], "path string"), str(root))
    assert size_of(e.home) - first < first / 5 and len(e._segments()) == 2 and e._segments()[1].files == 1
    assert e.node("changed").count() == 1 and e.node("f_7_1").count() == 0 and e.search("changed").count() == 1 and e.search("f_7_1").where("symbol_name = 'f_7_1'").count() == 0
    assert [r.source for r in e.callers("f_3_3").collect()].count("changed") == 1
    e.delete_files(["m7.py", "nowhere.py"])
    assert e.node("changed").count() == 0 and e.files().count() == 299 and e._segments()[2].gone == 1
    before = e.table("symbols").count()
    e.compact()
    assert len(e._segments()) == 1 and e.table("symbols").count() == before and e.table("edges").where("source = 'changed'").count() == 0


def test_a_walk_reads_its_buckets_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LARGE", 0)
    at = segments.Segments(spark, str(tmp_path))
    new, *_ = relations(spark, {f"f{i}.py": i for i in range(40)})
    log = [at.write(new, spark.createDataFrame([], segments.GONE))]
    near = graph.Adjacency(*(at.live(n, log) for n in ("edges_out", "edges_in", "degrees")))
    for direction in (graph.UP, graph.DOWN):
        plan = near.near(spark.createDataFrame([("f3.n3_0",)], "name string"), "name", direction)._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "bucket" in filters and "kind" in filters


def test_differences(spark):
    rows = lambda x: spark.createDataFrame(x, "path string, mtime double, size long")
    before = rows([("a", 5.0, 1), ("b", 5.0, 2), ("c", 5.0, 3), ("d", 5.0, 3), ("e", 5.0, 4), ("same", 1.0, 1)])
    now = rows([("a", 3.0, 1), ("b", 5.0, 9), ("x/c", 5.0, 3), ("y/d", 5.0, 3), ("z", 5.0, 3), ("same", 1.0, 1), ("old", 0.5, 7)])
    want = {("a", "changed", None), ("b", "changed", None), ("x/c", "moved", "c"), ("y/d", "moved", "d"), ("z", "new", None), ("e", "deleted", None), ("old", "new", None)}
    assert {tuple(r) for r in sync.differences(before, now).collect()} == want
    none = rows([])
    assert {r.change for r in sync.differences(none, now).collect()} == {"new"} and {r.change for r in sync.differences(now, none).collect()} == {"deleted"}


def test_watch_sees_older_times_deletions_and_moves(spark, tmp_path):
    root = tmp_path / "src"
    (root / "pkg").mkdir(parents=True)
    (root / "a.py").write_text("def one():\n    pass\n")
    (root / "pkg" / "b.py").write_text("def two():\n    one()\n")
    (root / "c.py").write_text("def three():\n    two()\n")
    for n in ("a.py", "pkg/b.py", "c.py"):
        os.utime(root / n, (2000, 2000))
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    q = e.watch(str(root), str(tmp_path / "cp"), every="100 milliseconds")
    try:
        q.processAllAvailable()
        assert {r.path for r in e.files().collect()} == {"a.py", "pkg/b.py", "c.py"}
        (root / "old.py").write_text("def old():\n    pass\n")
        os.utime(root / "old.py", (1000, 1000))
        (root / "a.py").write_text("def uno():\n    pass\n")
        os.utime(root / "a.py", (500, 500))
        (root / "c.py").unlink()
        (root / "pkg" / "b.py").rename(root / "moved.py")
        q.processAllAvailable()
        assert {r.path for r in e.files().collect()} == {"a.py", "old.py", "moved.py"}
        assert e.node("one").count() == 0 and e.node("uno").count() == 1 and e.node("old").count() == 1 and e.node("three").count() == 0
        assert {r.file_path for r in e.node("two").collect()} == {"moved.py"}
    finally:
        q.stop()
    (root / "late.py").write_text("def late():\n    pass\n")
    (root / "moved.py").unlink()
    q = e.watch(str(root), str(tmp_path / "cp"), every="100 milliseconds")  # goes on from the last listing
    try:
        q.processAllAvailable()
        assert {r.path for r in e.files().collect()} == {"a.py", "old.py", "late.py"}
    finally:
        q.stop()


def test_tree_changes_again_after_a_failure(spark, tmp_path):
    at, seen, failed = tmp_path / "scans", [], []
    at.mkdir()
    frame = lambda x: spark.createDataFrame(x, "path string, mtime double, size long, scan long").coalesce(1).write.mode("append").json(str(at))

    def apply(df, n):
        seen.append((n, sorted((r.scan, r.path, r.change) for r in df.collect())))
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("lost")

    def run():
        rows = spark.readStream.schema("path string, mtime double, size long, scan long").json(str(at))
        streams.tree_changes(rows, apply, str(tmp_path / "cp"), every=None).awaitTermination()

    frame([("a", 2.0, 1, 0), ("b", 2.0, 1, 0), (None, None, None, 0)])
    run()
    frame([("a", 1.0, 1, 1), (None, None, None, 1), (None, None, None, 2)])
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert seen[0][1] == [(0, "a", "new"), (0, "b", "new")] and seen[1] == seen[2]
    assert seen[2][1] == [(1, "a", "changed"), (1, "b", "deleted"), (2, "a", "deleted")]


def test_many_rows_of_few_files_are_dealt(spark, tmp_path, monkeypatch):
    """Symbols and edges, not files, say how a segment is written: one file's rows go to several tasks."""
    monkeypatch.setattr(segments, "ROWS", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        at = segments.Segments(spark, str(tmp_path))
        s = [(i, "a.py", f"n{i}", f"a.n{i}", "function", f"def n{i}(word)") for i in range(600)]
        e = [(f"a.n{i}", f"a.n{i * 7 % 600}", "calls", "a.py", "a.py") for i in range(600)]
        new = {"files": spark.createDataFrame([("a.py", "h")], "path string, file_hash string"), "symbols": spark.createDataFrame(s, SYMBOLS), "edges": spark.createDataFrame(e, EDGES)}
        log = [at.write(new, spark.createDataFrame([], segments.GONE))]
        parts = {n: sum(f.endswith(".parquet") for f in os.listdir(tmp_path / log[0].folders[n])) for n in ("symbols", "edges", "search_docs", "postings", "edges_out", "edges_in", "degrees")}
        assert min(parts.values()) > 1, parts
        assert sorted(map(tuple, at.live("symbols", log).select(*[c.split()[0] for c in SYMBOLS.split(", ")]).collect())) == sorted(s)
        near = graph.Adjacency(*(at.live(n, log) for n in ("edges_out", "edges_in", "degrees")))
        assert graph.walk(near, graph.one(spark, "a.n7"), graph.UP, 1).select("source").collect() == [("a.n1",)]
        assert search.match(search.Index(at.live("search_docs", log), at.live("postings", log)), "word").count() == 600
        few = at.merge(log, 1)
        assert few[0].files == 1 and at.live("edges", few).count() == 600
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_log_that_is_read_in_part_is_written_in_part(spark):
    """What searches read comes from symbols, what walks read from edges: the other's rows are not written for it."""
    from skeingraph.plans import stored

    for forms, written in ((stored.INDEX, {"files", "symbols", "search_docs", "postings"}), (stored.NEAR, {"files", "edges", "edges_out", "edges_in", "degrees"})):
        _, own = stored.log(spark, "/root/testdata/sf0.001", *forms)
        assert set(own[0].folders) == written and set(own[1].folders) == {*written, "gone"} and set(own[2].folders) == {"gone"}
