"""License scans, importance resampling and centroid clustering against brute force, with every odd row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n_words long, places string, weight long, score double, rank int, row long, part int, n int"
VECTORS = "vec_id long, embedding array<float>, cluster int, distance long, h string, v string, label int"


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def docs_table(spark, texts: list[tuple[int | None, str | None]]):
    return spark.createDataFrame([(d, t, "en", 5, "clash", 7, 0.5, 9, 1, 2, 3) for d, t in texts], DOCS).repartition(3)


def damaged(rng: random.Random, phrase: str, n: int) -> str:
    for _ in range(n):
        at = rng.randrange(len(phrase))
        phrase = rng.choice([phrase[:at] + phrase[at + 1 :], phrase[:at] + rng.choice("xé 7") + phrase[at:], phrase[:at] + rng.choice("yß日") + phrase[at + 1 :]])
    return phrase


def notice_texts() -> list[tuple[int | None, str | None]]:
    from skeingraph.llm.notices import BASE, MORE

    rng, out = random.Random(3), []
    for i in range(150):
        said = [rng.choice(["license", "general", "public", "word", "été", "mit", "the"]) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            said.insert(rng.randrange(len(said) + 1), damaged(rng, rng.choice([*BASE, *MORE]), rng.randrange(5)))
        out.append((i * 3, rng.choice([" ", "-", "\n\t", ", "]).join(said).title() if i % 2 else " ".join(said)))
    out += [(1000, None), (1001, ""), (1002, " -,"), (1003, "MIT License"), (1003, "MIT License"), (None, "the apache licence"), (None, None), (1004, "mit license " * 2000), (1005, "word " * 300_000 + "cc by"), (1006, "K" * 500_000), (1007, "apachelicense"), (1008, "x apa che license"), (1009, "Kit license İ")]
    return out


def test_notices_against_brute_force(spark):
    from skeingraph.llm.notices import BASE, MORE, find_notices, notices

    wanted = notices(BASE | MORE)
    assert {n.phrase: n.edits for n in wanted} == {"gnu general public license": 3, "apache license": 1, "cc by": 0, "mit license": 1, "bsd license": 1, "mozilla public license": 2, "creative commons attribution": 3}

    def brute(text):
        w, out = WORD.findall(lowered(text)), []
        if len(w) > 10_000:
            return len(w), None
        for n in wanted:
            hit = {}
            for a in range(len(w)):
                for z in range(a, min(len(w), a + 8)):
                    run = " ".join(w[a : z + 1])
                    if abs(len(run) - len(n.phrase)) <= n.edits and (e := edits(run, n.phrase)) <= n.edits:
                        hit[a, z] = e
            taken = set()
            for (a, z), e in sorted(hit.items(), key=lambda x: (x[1], x[0])):
                if e == 0 or not taken & set(range(a, z + 1)):
                    taken |= set(range(a, z + 1))
                    out.append((n.phrase, n.label, a, z, e))
        return len(w), sorted(out, key=lambda x: (x[2], x[3], x[0]))

    texts = notice_texts()
    got = Counter((r.doc_id, r.n_words, tuple(tuple(p) for p in r.places)) for r in find_notices(docs_table(spark, texts), wanted).collect())
    for (d, n, p), times in got.items():
        if n > 10_000:
            assert p == (("cc by", "cc-by", 300_000, 300_001, 0),) and d == 1005
    want = Counter((d, n, tuple(p)) for d, t in texts for n, p in [brute(t)] if p is not None)
    assert Counter({k: v for k, v in got.items() if k[1] <= 10_000}) == want
    found = [p for _, _, ps in want for p in ps]
    assert len({p[4] for p in found}) == 4 and len({p[0] for p in found}) == len(wanted)
    assert find_notices(docs_table(spark, []), wanted).collect() == [] and find_notices(docs_table(spark, texts[:3]), []).where("size(places) > 0").count() == 0


def test_any_split_of_edits_leaves_a_piece(spark):
    from skeingraph.llm.notices import Notice, flat, places

    rng, notice = random.Random(8), Notice("gnu general public license", "gpl", 3)
    for _ in range(500):
        bad = damaged(rng, notice.phrase, 3)
        text = flat(f"so {bad} it".encode())
        whole = " ".join(WORD.findall(bad))
        n, found = places(text, [notice])
        if edits(whole, notice.phrase) <= 3 and whole:
            assert found and found[0][4] <= edits(whole, notice.phrase), bad


def brute_resample(docs, target, percent, least, buckets, longest, seed):
    def features(text):
        w = WORD.findall(lowered(text))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        rows.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = Counter()
    drawn = [(d, n, w, sc, i) for i, (d, _, n, w, sc) in enumerate(may[: percent * len(may) // 100], 1)]
    ranks.update((d, n, w, sc) for d, n, w, sc, _ in drawn)
    rest = Counter((d, n, w, sc) for d, _, n, w, sc in rows) - ranks
    return Counter(drawn) + Counter({(*k, None): v for k, v in rest.items()})


def resample_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["É", "日本", "K9"]
    out = [(i, rng.choice([" ", "--", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(400)]
    same = " ".join(words[:30])
    out += [(500, same)] * 200 + [(501, same), (502, None), (503, ""), (504, " . "), (None, same), (None, None), (505, " ".join(rng.choice(words) for _ in range(200_000)))]
    return out


@pytest.mark.parametrize("longest, percent, least, buckets", [(1, 10, 20, 10_000), (3, 50, 5, 64), (1, 100, 0, 65_536), (1, 0, 20, 10)])
def test_resample_against_brute_force(spark, longest, percent, least, buckets):
    from skeingraph.llm.resampling import resample

    docs, target = resample_texts(), ["w1 w2 w3 É", None, "", "w1 w1 日本"]
    got = resample(docs_table(spark, docs), docs_table(spark, [(None, t) for t in target]), percent, least, buckets, longest, 2024)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == brute_resample(docs, target, percent, least, buckets, longest, 2024)
    drawn = sorted(r[4] for r in rows if r[4] is not None)
    assert drawn == list(range(1, len(drawn) + 1))


def test_resample_of_empty_tables(spark):
    from skeingraph.llm.resampling import resample

    docs, none = resample_texts()[:50], docs_table(spark, [])
    assert resample(none, docs_table(spark, docs)).collect() == []
    assert Counter(tuple(r) for r in resample(docs_table(spark, docs), none).collect()) == brute_resample(docs, [], 10, 20, 10_000, 1, 2024)


def test_counts_and_gathers(spark):
    from skeingraph.llm.resampling import counts, packed, stream_of, weights

    assert stream_of(b"") [0] == 0 and stream_of(b"a b a")[1].tolist() == [zlib.crc32(x) % 10_000 for x in (b"a", b"b", b"a")]
    docs = docs_table(spark, [(1, "a b a"), (2, ""), (3, None), (4, "b")])
    streams = packed(docs, "doc_id", 1, 100)
    n = counts(streams, 100)
    assert n.sum() == 4 and n[zlib.crc32(b"a") % 100] == 2
    gain = np.zeros(100, np.int64)
    gain[zlib.crc32(b"a") % 100], gain[zlib.crc32(b"b") % 100] = 5, -3
    assert {tuple(r) for r in weights(streams, gain).collect()} == {(1, 3, 3, 7), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 1, -3)}


def brute_cluster(rows, k, rounds, seed, d, scale):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, j, q in last:
        by[j] += q
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, q, by[j], sum(by.values()), sha[j]) for i, j, q in last)


def vector_rows(n: int, d: int, kind: str) -> list:
    rng = np.random.default_rng(4)
    if kind == "grid":  # many ties, many copies
        v = rng.integers(-2, 3, (n, d)) / 4
    elif kind == "groups":
        v = rng.normal(size=(8, d))[rng.integers(0, 8, n)] + rng.normal(size=(n, d)) * 0.05
    else:
        v = rng.normal(size=(n, d)) * (1000 if kind == "wide" else 1)
    v = v.astype(np.float32).tolist()
    v[: n // 3] = [v[0]] * (n // 3)  # a third are copies
    rows = list(enumerate(v))
    odd = [(n, None), (n + 1, []), (n + 2, [0.5] * (d - 1)), (n + 3, [None] + [0.5] * (d - 1)), (n + 4, [float("nan")] * d), (n + 5, [float("inf")] + [0.0] * (d - 1)), (n + 6, [0.0] * d), (None, v[-1]), (None, v[-2]), (3, v[-3]), (3, v[-3])]
    return rows + odd


@pytest.mark.parametrize("kind, k, d", [("grid", 10, 3), ("groups", 12, 8), ("spread", 40, 6), ("wide", 7, 4), ("grid", 1, 2), ("grid", 2, 2)])
def test_cluster_against_brute_force(spark, kind, k, d):
    from skeingraph.llm.clustering import cluster

    rows = vector_rows(300, d, kind)
    table = spark.createDataFrame([(i, v, 5, 6, "clash", "clash", 1) for i, v in rows], VECTORS).repartition(3)
    got = cluster(table, k, 5, 2, d, 256)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_cluster(rows, k, 5, 2, d, 256)


def test_cluster_of_few_or_no_vectors(spark):
    from skeingraph.llm.clustering import cluster

    assert cluster(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(1, [0.5, 1.0]), (2, [-0.5, 0.25])]
    few = spark.createDataFrame([(i, v, 5, 6, "", "", 1) for i, v in rows], VECTORS)
    assert Counter(tuple(r) for r in cluster(few, 40, 5, 2, 2).collect()) == brute_cluster(rows, 40, 5, 2, 2, 256)
    with pytest.raises(Exception, match="beyond"):
        cluster(spark.createDataFrame([(1, [1e30, 0.0], 0, 0, "", "", 1)], VECTORS), 4, 1, 2, 2).collect()


def test_exponion_looks_at_few_and_misses_none():
    from skeingraph.llm import clustering

    rng = np.random.default_rng(9)
    for scale in (8, 300, 1 << 22):  # the last one needs longs
        x = (rng.normal(size=(30, 5)) * scale).astype(np.int64)[rng.integers(0, 30, 4000)] + rng.integers(-2, 3, (4000, 5))
        c = clustering.Centroids(x[rng.choice(len(x), 25, replace=False)])
        state = clustering.assign(x, np.full(len(x), -1, np.int32), np.zeros(len(x)), np.zeros(len(x)), c)
        looked, plain = [], clustering.two_nearest
        for _ in range(8):
            exact = ((x[:, None, :] - c.values[None]) ** 2).sum(axis=2)
            assert (state[0] == exact.argmin(axis=1)).all()
            means = np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c.values[j] for j in range(25)])
            c = clustering.Centroids(means, np.sqrt(((means - c.values) ** 2).sum(axis=1).astype(float)))
            clustering.two_nearest = lambda a, which, c: looked.append(len(a) * len(which)) or plain(a, which, c)  # noqa: B023
            state = clustering.assign(x, *state, c)
            clustering.two_nearest = plain
        assert sum(looked) < 0.7 * 8 * len(x) * 25


def test_a_task_gives_its_memory_back(monkeypatch):
    from skeingraph.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = common.released(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2]))) == [2, 4] and given == [1]
    half = run(iter([1, 2]))
    next(half)
    half.close()  # a task that is stopped
    assert given == [1, 1]
