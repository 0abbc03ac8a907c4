"""Stems, addresses and moments against literal cases; latency state against a list; a subscriber after a failure."""

from __future__ import annotations

import random
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from skeingraph.engine import Engine
from skeingraph.functions import stems, times, urls
from skeingraph.operators import search, stemmed
from skeingraph.operators.usage import BUCKETS
from skeingraph.streaming import queries as streams

STEMS = (
    "consign:consign consigned:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori console:consol consolidating:consolid consolingly:consol conspicuously:conspicu conspiracy:conspiraci "
    "conspirator:conspir knackeries:knackeri knaves:knave knavish:knavish kneaded:knead knees:knee knife:knife knightly:knight knitted:knit knives:knive knocker:knocker knots:knot skies:sky dying:die news:news herrings:herring "
    "proceed:proceed generate:generat generously:generous communication:communic happy:happi by:by say:say cry:cri running:run hoping:hope hopping:hop relational:relat conditional:condit formative:format national:nation adoption:adopt "
    "gas:gas this:this gaps:gap ties:tie cries:cri agreed:agre feed:feed luxuriated:luxuri bed:bed rate:rate rolling:roll controlled:control geology:geolog ab2:ab2 été:été youth:youth argue:argu vileness:vile hopefulness:hope early:earli"
)


def test_stems(spark):
    want = dict(x.split(":") for x in STEMS.split())
    rows = spark.createDataFrame([(k,) for k in [*want, "running"]], "term string")
    assert {r.term: r.stem for r in stems.stems(rows).collect()} == want
    assert stems.stems(rows).where("stem = 'run'").count() == 1


def test_plain_search(spark):
    rows = [(1, "load_file", "a.load_file", "def loading files(path)", "function", "a.py"), (2, "Loader", "a.Loader", "class of the loaded", "class", "a.py"), (3, "file", "b.file", None, "variable", "b.py"), (4, "save", "b.save", "files far " + "x " * 120 + "loads", "function", "b.py")]
    index = search.of_symbols(spark.createDataFrame(rows, "id long, name string, qualified_name string, signature string, kind string, file_path string"))
    by_stem = stemmed.dictionary(index.postings)
    found = lambda q, **k: [r.id for r in stemmed.search_plain(index, by_stem, q, **k).collect()]
    assert found("loads the file") == [1, 4] and found("files") == [1, 3, 4] and found("load", file_path="b.py") == [4]
    assert found("the of") == [] and found("") == [] and found("nowhere load") == [] and found("loads", limit=1) == [1]
    ranks = {r.id: r["rank"] for r in stemmed.search_plain(index, by_stem, "file").collect()}
    assert ranks[3] == pytest.approx(0.1 / 1.64493406685) and ranks[1] == pytest.approx(0.1 * 1.25 / 1.64493406685)


def test_urls(spark):
    given = ["HTTP://User@WWW.Example.com:80/a/index.html?b=2&utm_source=x&a=1#top", "https://example.com:8443/a//", "//host/x", "mailto:a@b.c", "/only/path?x", "", None, "https://example.com", "http://e.com/a?b=1&b=2&c=&=d&e%20f=g+h&z=%zz"]
    u = F.col("u")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, u string")
    for r in rows.select("u", urls.parts(u).alias("p"), urls.parameters(urls.query(u)).alias("q")).collect():
        want = urlsplit(r.u or "")
        assert (r.p.scheme, r.p.host, r.p.path, r.p.query, r.p.fragment) == (want.scheme, want.hostname or "", want.path, want.query, want.fragment)
        assert r.p.port == (str(want.port) if want.port else "") and [tuple(x) for x in r.q if x.name != "z"] == [x for x in parse_qsl(want.query) if x[0] != "z"]
    normal = [r.n for r in rows.orderBy("i").select(urls.normal(u).alias("n")).collect()]
    assert normal[0] == "http://example.com/a?a=1&b=2" and normal[1] == "https://example.com:8443/a" and normal[7] == "https://example.com"
    base = "http://h.com/d/e/f.html?q=1#x"
    links = ["g", "/g", "//o.com/g", "?y=2", "#s", "http://z/", "", "g?y#s"]
    got = spark.createDataFrame([(x,) for x in links], "l string").select("l", urls.resolved(F.lit(base), F.col("l")).alias("r")).collect()
    assert {r.l: r.r for r in got if r.l} == {x: urljoin(base, x) for x in links if x} and [r.r for r in got if not r.l] == [base]


def test_times(spark):
    rows = spark.sql("SELECT timestamp_seconds(1700000000.5) AS t")
    now = lambda s: F.timestamp_seconds(F.lit(1700000000.5 + s))
    r = rows.select(times.iso(F.col("t")).alias("iso"), times.saved_name(F.col("t"), "x").alias("name"), times.epoch_seconds(F.col("t")).alias("s"), *[times.age(F.col("t"), now(s)).alias(f"a{s}") for s in (-5, 0, 1, 61, 7200, 90000, 200000)]).first()
    assert tuple(r) == ("2023-11-14T22:13:20.500000+00:00", "x-20231114-221320", 1700000000.5, "now", "now", "1 second ago", "1 minute ago", "2 hours ago", "1 day ago", "2 days ago")


def test_latencies_of_any_batches():
    """The processor alone, over a state that is a plain list."""

    class Kept:
        def __init__(self):
            self.x = None

        def exists(self):
            return self.x is not None

        def get(self):
            return self.x if self.x is not None else iter(())

        def update(self, x):
            self.x = x

        put = update

        def appendList(self, x):
            self.x = [*(self.x or []), *x]

    import pandas as pd

    rng = random.Random(2)
    for most, keep in ((10, 5), (7, 7), (20, 1)):
        p, every, plain = streams.Latencies(most, keep), [], []
        p.samples, p.counts = Kept(), Kept()
        for _ in range(30):
            batch = [(float(len(every) + i), rng.random()) for i in range(rng.choice([1, 2, 5, 40]))]
            for x in batch:
                plain.append(x)
                if len(plain) > most:
                    plain = plain[-keep:]
            every += batch
            rng.shuffle(batch)
            cut = rng.randrange(len(batch) + 1)
            frames = [pd.DataFrame(b, columns=["ts", "seconds"]) for b in (batch[:cut], batch[cut:])]
            (out,) = p.handleInputRows(("k",), iter(frames), None)
            assert list(p.samples.get()) == plain and out.n[0] == len(every) and out.kept[0] == len(plain) and out.p50[0] == sorted(s for _, s in plain)[len(plain) // 2]
            assert all(out[streams.bound(b)][0] == sum(s <= b for _, s in every) for b in BUCKETS)


def test_subscribers_have_places_of_their_own(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    e = Engine(spark, str(tmp_path / "home"))
    e.init()
    (root / "a.py").write_text("def one():\n    pass\n\n\ndef two():\n    pass\n")
    e.index(str(root))
    first, second, failed = [], [], []

    def rows(df):
        return sorted((r.version, r.relation, r.entity, r.change) for r in df.collect())

    e.feed(lambda df, n: first.append(rows(df)), str(tmp_path / "one"), every=None).awaitTermination()
    (root / "a.py").write_text("def one(x):\n    pass\n\n\ndef three():\n    pass\n")
    (root / "b.py").write_text("def four():\n    pass\n")
    e.index(str(root))
    (root / "b.py").unlink()
    e.index(str(root))
    e.annotate("a.py", "one", "a note")  # no change of files or symbols

    def lost(df, n):
        second.append(rows(df))
        if not failed:
            failed.append(n)
            raise RuntimeError("lost")

    e.feed(lambda df, n: first.append(rows(df)), str(tmp_path / "one"), every=None).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        e.feed(lost, str(tmp_path / "two"), every=None).awaitTermination()
    e.feed(lost, str(tmp_path / "two"), every=None).awaitTermination()
    assert second[0] == second[1] == sorted([*first[0], *first[1]])
    assert [(r, x, c) for _, r, x, c in first[0]] == [("files", "a.py", "new"), ("symbols", "one", "new"), ("symbols", "two", "new")]
    steps = sorted({v for v, *_ in first[1]})
    assert [(r, x, c) for v, r, x, c in first[1] if v == steps[0]] == [("files", "a.py", "changed"), ("files", "b.py", "new"), ("symbols", "four", "new"), ("symbols", "one", "changed"), ("symbols", "three", "new"), ("symbols", "two", "deleted")]
    assert [(r, x, c) for v, r, x, c in first[1] if v == steps[1]] == [("files", "b.py", "deleted"), ("symbols", "four", "deleted")] and len(steps) == 2
