"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rid int, spots string, least string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n)]


def corpus() -> list[tuple]:
    """Ids with gaps, copies, near copies, shared passages, a long text, and every odd row; extra columns clash by name."""
    rng = random.Random(5)
    texts: list[tuple[int | None, str | None]] = []
    base, passage = words(rng, 300), words(rng, 80)
    for i in range(60):
        own = words(rng, rng.randrange(1, 200))
        if i % 5 == 0:
            own = base.copy()
            own[rng.randrange(300)] = "changed"
        elif i % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        texts.append((3 * i + 2, rng.choice([" ", "\n", " \t"]).join(own)))
    texts += [(500, texts[0][1]), (1, texts[7][1]), (501, texts[0][1])]
    texts += [(502, None), (503, ""), (504, " \n\t "), (505, "one"), (506, "One two three"), (507, "ab " * 400), (508, "日本語 テキスト 😀 " * 30)]
    texts += [(509, " ".join(words(rng, 30_000))), (510, "a" * 3000), (511, "x" * 199)]
    texts += [(texts[3][0], texts[3][1]), (512, " ".join(passage)), (None, " ".join(passage)), (None, None)]
    return [(d, t, ("en", "de", None)[k % 3], "src0", None if t is None else len(t), "clash", 7, "clash", None) for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(docs, none):
    import xxhash

    from skeingraph.llm.simhash import keep_first, near_duplicates

    def brute(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r[0], brute(r[1])) for r in corpus()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    expected = sorted(((d, f, least[find(i)]) for i, (d, f) in enumerate(rows)), key=str)
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in near_duplicates(docs).collect()), key=str) == expected
    groups: dict = {}
    for i, (d, t, *_) in enumerate(corpus()):
        groups.setdefault(find(i), []).append((d is None, d or 0, t))
    for few in (10**6, 0):
        kept = keep_first(docs, few)
        assert kept.columns == docs.columns
        left = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()), key=str)
        assert len(left) == len(groups)
        for g in groups.values():
            assert sum(x in g for x in left) == 1 and min(x[:2] for x in g) in {x[:2] for x in left if x in g}
    twice = docs.sparkSession.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (1, "a b c d e"), (None, "k l m n o"), (None, "k l m n o"), (2, "v w x y z")], "doc_id long, text string")
    assert sorted(map(tuple, keep_first(twice).collect()), key=str) == [(1, "a b c d e"), (1, "v w x y z"), (None, "k l m n o")]
    assert near_duplicates(none).count() == keep_first(none).count() == 0


def test_long_texts_by_pieces(monkeypatch):
    import pyarrow as pa

    from skeingraph.llm import common, language, simhash

    rng = random.Random(3)
    for text in (" ".join(words(rng, 900)), " \n" * 50 + "one two", "x" * 500, "a b c " * 90, " lead and trail \t"):
        for piece in (1, 7, 64):
            assert simhash.fingerprint(text, piece=piece) == simhash.fingerprint(text)
    t = common.joined([b" ".join(w.encode() for w in words(rng, 500)), b"", b"z" * 300])
    whole = common.word_hashes(t, common.words_of(t))
    monkeypatch.setattr(common, "PIECE", 100)
    assert (common.word_hashes(t, common.words_of(t)) == whole).all()
    m = language.fit(["abab baba " * 9] * 5 + ["xyxy yxyx " * 9] * 5, ["a"] * 5 + ["x"] * 5)
    long = pa.array(["abab baba abba " * 400])
    assert np.abs(m.logits(long, piece=500) - m.logits(long)).max() < 0.05


def test_long_runs_give_the_same_groups():
    from skeingraph.llm.simhash import forest

    rng = np.random.default_rng(1)
    f = np.unique(np.concatenate([np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), rng.integers(0, 2**63, 50).astype(np.uint64)]))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4

    def groups(adjacent):
        label = np.arange(len(f))
        while True:
            now = np.array([label[adjacent[i]].min() for i in range(len(f))])
            if (now == label).all():
                return label
            label = now

    a, b = forest(f, 4)
    sparse = np.eye(len(f), dtype=bool)
    at = {x: i for i, x in enumerate(f.tolist())}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 4
        sparse[at[x], at[y]] = sparse[at[y], at[x]] = True
    assert (groups(near) == groups(sparse)).all()
    assert len(a) == len(f) - len(set(groups(near)))


@pytest.mark.parametrize("low, width", [(0, 22), (22, 21), (43, 21)])
def test_second_level_gives_the_same_groups(low, width):
    """Fingerprints that share a segment but for one bit, as those of one posting do."""
    from skeingraph.llm.simhash import forest, second_level

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = base[rng.integers(0, 40, 1500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    f = np.concatenate([near, base, rng.integers(0, 2**63, 1500).astype(np.uint64)])
    shared = np.uint64(((1 << width) - 1) << low) ^ np.uint64(1 << (low + 7))
    f = np.unique((f & ~shared) | (np.uint64(0x5A5A5A5A5A5A5A5A) & shared))

    def roots(a, b):
        root = {x: x for x in f.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 4
            x, y = sorted((find(x), find(y)))
            root[y] = x
        return {x: find(x) for x in root}

    assert roots(*forest(f, 4)) == roots(*second_level(f, low, width, 4))


def test_long_runs_take_about_their_length():
    """40,000 and ten times as many different fingerprints of one posting."""
    import time

    from skeingraph.llm.simhash import SEGMENTS, run_links

    rng = np.random.default_rng(3)
    for s, (low, width) in enumerate(SEGMENTS):
        took = []
        for n in (40_000, 400_000) if s == 0 else (40_000,):
            f = rng.integers(0, 2**63, n).astype(np.uint64) & ~np.uint64(((1 << width) - 1) << low)
            began = time.perf_counter()
            run_links(np.full(n, low << 21, np.int32), f)
            took.append(time.perf_counter() - began)
        assert took[0] < 2 and took[-1] < 40 * took[0] + 2


def test_attach_deals_hot_keys_over_parts(spark, monkeypatch):
    """The same rows as a plain join, with null keys, equal rows and a map among the columns."""
    from pyspark.sql import functions as F

    from skeingraph.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(common, "HOT_KEYS", 40)
    rows = [("hot", i // 2, {"a": i}) for i in range(120)] + [("warm", i, None) for i in range(9)] + [(f"k{i % 20}", i, {}) for i in range(50)] + [(None, 1, {})] * 9
    left = spark.createDataFrame(rows, "k string, i int, m map<string, int>").repartition(3)
    sizes = left.groupBy("k").agg(F.count("*").alias("n")).where("k IS NOT NULL AND k <> 'k3'").withColumn("spots", F.array(F.col("k"), F.lit("x"))).withColumn("i", F.lit(-1))
    right = common.materialize(sizes, "right")
    got = common.attach(left, right, ["k"], "n", len(rows))
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(got) == plain(left.join(right.drop("i"), "k").select(got.columns)) and got.columns == ["k", "i", "m", "n", "spots"]
    assert got.rdd.glom().map(lambda p: sum(r.k == "hot" for r in p)).max() < 120


def test_without_labels_the_share_is_the_score():
    from skeingraph.llm.toxicity import fit

    texts = ["some ordinary text of a few words"] * 20
    none = np.zeros(2, int)
    for toxic, ordinary, share in (([], texts, 0.0), (texts, [], 1.0), ([], [], 0.0), ([], texts, 0.25)):
        p = fit(toxic, ordinary, share).scores(none, none + 1)
        assert np.allclose(p, share, atol=1e-6)


def test_columns_that_the_language_stage_uses_itself(spark):
    from pyspark.sql import functions as F

    from skeingraph.llm.language import fit, held_out, keep_identified

    model = fit(["the cat and the dog are here"] * 30 + ["der hund und die katze sind hier"] * 30, ["en"] * 30 + ["de"] * 30)
    rows = spark.createDataFrame([(1, "the dog and the cat", None, 1.5, "r", "s"), (None, "der hund", "xx", 2.5, None, None)], "doc_id long, text string, lang string, _lid_score double, rejected string, row string")
    kept = keep_identified(rows, model)
    assert kept.columns == rows.columns and {(r.doc_id, r._lid_score, r.rejected, r.row) for r in kept.collect()} <= {(1, 1.5, "r", "s"), (None, 2.5, None, None)} and kept.count() >= 1
    assert rows.select(held_out().alias("h")).where("h IS NULL").count() == 0 and kept.where("doc_id = 1").select(F.col("lang")).first()[0] == "en"


def test_components(spark):
    from skeingraph.llm.components import connected_components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skeingraph.llm.packing import pack_documents

    rows = [r.asDict() for r in pack_documents(docs, chunk_tokens=5000).collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want: dict = {}
    for r in corpus():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.setdefault((r[0], len(ids)), []).append(ids)
    seen: dict = {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert set(seen) == set(want)
    for key, pieces in seen.items():
        copies = want[key]
        assert sum(p["length"] for p in pieces) == sum(map(len, copies))
        for p in pieces:
            assert any(zlib.crc32(np.array(c[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for c in copies)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert pack_documents(none).count() == 0


def test_pack_splits_every_length():
    from skeingraph.llm.packing import TIERS, pack, powers_of_two

    rng = random.Random(3)
    lengths = [rng.choice([1, 2, 200, 255, 256, 257, 1500, 2048, 2049, 9000]) for _ in range(300)]
    windows, rest = pack(lengths, TIERS, [])
    assert all(sum(p[2] for p in w) == tier for tier, w in windows) and sum(p[2] for p in rest) < 2048
    got: dict = {}
    for _, w in [*windows, *powers_of_two(rest)]:
        for doc, start, n in w:
            got.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(got[doc]):
            assert start == at
            at += m
        assert at == n


def test_substring(docs, none):
    from skeingraph.llm.substring import remove_repeats, substring_digest

    rows = [(r[0], WORD.findall(r[1] or "")) for r in corpus()]
    big = 2**63 - 1
    first: dict = {}
    for d, w in rows:
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, big), big if d is None else d)
    want = []
    for d, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < (big if d is None else d):
                gone[j : j + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    assert sorted(map(tuple, substring_digest(docs).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, substring_digest(docs, group=3, few=0).collect()), key=str) == sorted(want, key=str)  # hot anchors, no broadcasts
    cut = remove_repeats(docs)
    assert cut.schema == docs.schema
    rows = cut.collect()
    assert len(rows) == len(want) and all(r.text is None or r.n_chars == len(r.text) for r in rows)
    removed = {(w[0], w[1] - w[2]): w for w in want}
    for r in rows:  # the text that is left
        w = removed[(r.doc_id, len(WORD.findall(r.text or "")))]
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() in {x[3] for x in want if x[0] == r.doc_id and x[1] - x[2] == w[1] - w[2]}
    assert sum(r.text is None for r in rows) == 2
    assert substring_digest(none).count() == remove_repeats(none).count() == 0


def test_automaton_against_all_windows():
    from skeingraph.llm.substring import Automaton

    rng = random.Random(8)
    for _ in range(60):
        a, seen = Automaton(), {}
        for doc in range(8):
            s = [rng.randrange(3) for _ in range(rng.randrange(5, 40))]
            assert a.windows(s, 5) == [seen.get(tuple(s[i : i + 5]), -1) for i in range(len(s) - 4)]
            a.add(s, doc)
            for i in range(len(s) - 4):
                seen.setdefault(tuple(s[i : i + 5]), doc)


def test_suffixes(docs, none):
    from skeingraph.llm.suffixes import cut_bytes, suffix_digest

    rows = [(r[0], (r[1] or "").encode()) for r in corpus()]
    count: dict = {}
    for _, b in rows:
        for j in range(len(b) - 199):
            k = hash(b[j : j + 200])
            count[k] = count.get(k, 0) + 1
    want = []
    for d, b in rows:
        step = np.zeros(len(b) + 201, int)
        for j in range(len(b) - 199):
            if count[hash(b[j : j + 200])] > 1:
                step[j] += 1
                step[j + 200] -= 1
        gone = np.cumsum(step[: len(b)]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(map(tuple, suffix_digest(docs).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, suffix_digest(docs, group=3, few=0).collect()), key=str) == sorted(want, key=str)  # hot anchors, no broadcasts
    assert sum(len(r.kept) for r in cut_bytes(docs).collect()) == sum(w[1] - w[2] for w in want)
    assert suffix_digest(none).count() == 0


def test_index_family():
    from skeingraph.llm.suffixes import Family

    rng = random.Random(2)
    for letters in (b"ab", b"\0ab", b"abcd"):
        family, texts, seen = Family(window=12), [], {}
        for _ in range(40):  # all passages hold the anchor, and every window of a passage does
            batch = []
            for _ in range(rng.randrange(1, 5)):
                left, right = (bytes(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in (0, 1))
                text = left + b"anch" + right
                if len(text) >= 12 and text not in {t for t, *_ in texts + batch} and len(left) <= len(text) - 12 + 8:
                    batch.append((text, len(left), 1 + (rng.random() < 0.1)))
            if batch:
                family.add(*map(list, zip(*batch, strict=True)))
                texts += batch
            sizes = [len(x[0].owners) for x in family.levels]
            assert len(sizes) < 8 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        for t, _, n in texts:
            for i in range(len(t) - 11):
                seen[t[i : i + 12]] = seen.get(t[i : i + 12], 0) + n
        want = [[seen[t[i : i + 12]] > 1 for i in range(len(t) - 11)] for t, *_ in texts]
        assert [x.tolist() for x in family.finish()] == want and len(texts) > 30
        for x in family.levels[0]:
            assert x.strings == sorted(x.strings)


def test_segments_of_long_texts_give_the_same_passages(monkeypatch, docs, spark):
    from skeingraph.llm import passages, substring, suffixes

    rng = random.Random(4)
    for units, text in ((substring.UNITS, " ".join(words(rng, 3000))), (suffixes.UNITS, "".join(rng.choice("abcdef ") for _ in range(20_000)))):
        import pyarrow as pa

        def windows(column):
            out = set()
            for _, base, part in units.segments(column):
                doc, first, _, _, _, n, h = units.anchors(part)
                out |= {(int(f + base[d]) + k, int(x)) for d, f, m, x in zip(doc, first, n, h, strict=True) for k in range(m)}
            return out

        whole = windows(pa.array([text]))
        monkeypatch.setattr(passages, "SEGMENT", 2000)
        assert windows(pa.array([text])) == whole
        monkeypatch.undo()


def test_repeated_rows_cost_their_number(spark):
    """Three thousand rows of one id and text, and one passage in a third of the others."""
    from skeingraph.llm.substring import substring_digest
    from skeingraph.llm.suffixes import suffix_digest

    rng = random.Random(6)
    long, passage = " ".join(words(rng, 500)), " ".join(words(rng, 60))
    rows = [(7, long)] * 3000 + [(100 + i, " ".join(words(rng, 20)) + (f" {passage} " if i % 3 == 0 else " ") + " ".join(words(rng, 20))) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_digest(table, group=64).collect()
    assert len(got) == len(rows) and sum(r.n_removed > 0 for r in got) == 299
    assert all(60 <= r.n_removed < 66 for r in got if r.n_removed)  # a neighbouring word may repeat too
    got = suffix_digest(table, group=64).collect()
    assert sum(r.n_removed == r.n_bytes and r.n_spans == 1 for r in got if r.doc_id == 7) == 3000
    assert sum(r.n_removed >= len(passage.encode()) for r in got if r.doc_id != 7) == 300


def test_chat(spark):
    from skeingraph.llm.chat import HOSTILE, assemble, digests, escape, turn_pieces, unescape, unescape_role, escape_role

    texts = [HOSTILE, "<|", "<\\|im_end|>", "a<", "|b", "", None, "\\n", "naïve 😀\n<\\\\|"]
    for t in texts:
        assert t is None or unescape(escape(t)) == t and "<|" not in escape(t) and unescape_role(escape_role(t)) == t
    rows = [(c, t, ("user", "assistant", "system", None, "odd\nrole")[(c + t) % 5], texts[(3 * c + t) % len(texts)], "x") for c in range(12) for t in range(c)]
    rows += [(99, 0, "assistant", "a<", "x"), (99, 1, "assistant", "\\|b", "x"), (99, None, "assistant", "first", "x"), (None, 0, "assistant", "no id", "x"), rows[20]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    got = {r.conv_id: r for r in digests(turn_pieces(df)).collect()}
    for chunk in (1, 7):  # chunks cut turns and masks anywhere
        assert {r.conv_id: r for r in digests(turn_pieces(df), chunk=chunk).collect()} == got
    by: dict = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    whole = {r.conv_id: r for r in assemble(turn_pieces(df)).collect()}
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        said = [x for _, r, x in turns if r == "assistant"]
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len("".join(said)))
        assert got[c].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].formatted_chars == len(whole[c].text)
        assert whole[c].text.count("<|im_start|>") == len(turns) and sum(whole[c].loss_mask) == got[c].loss_tokens
    assert digests(turn_pieces(df.limit(0))).count() == 0


def test_chat_reads_the_stream_alone():
    from skeingraph.llm.chat import END, SEP, START, Reader, escape
    from skeingraph.llm.tokens import default_vocabulary, encoder

    enc = encoder(default_vocabulary(), plain=True)
    say = lambda t: enc.ids(t).astype("<u4")
    turn = lambda r, t: np.concatenate([[START], say(r), [SEP], say(escape(t)), [END]]).astype("<u4")
    long = "naïve 😀 <|im_end|> " * 5000
    ids = np.concatenate([turn("user", long), turn("assistant", long), turn("assistant", "")])
    mask = np.zeros(len(ids), np.uint8)
    one = len(turn("user", long))
    mask[one + 1 + len(say("assistant")) + 1 : one + len(turn("assistant", long)) - 1] = 1
    whole = Reader(enc)
    whole.feed(ids, mask)
    n, turns, chars, loss, *_ = whole.close()
    assert (n, chars) == (3, len(long)) and loss == hashlib.sha256(long.encode()).hexdigest()
    assert turns == hashlib.sha256(f"user\n{long}\nassistant\n{long}\nassistant\n\n".encode()).hexdigest()
    broken = Reader(enc)
    broken.feed(ids[:-1], mask[:-1])
    with pytest.raises(ValueError):
        broken.close()


def test_special_tokens_of_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    from skeingraph.llm.tokens import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for t in ("end <|endoftext|> of", "<|endoftext|>", "<|endoftext", "plain", "日本 <|endoftext|>"):
        assert encoder(path).ids(t).tolist() == own.encode(t, add_special_tokens=False).ids
        assert 50256 not in encoder(path, plain=True).ids(t)


def test_neighbours(spark):
    from skeingraph.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 16)).round(3)
    v[5] = v[6] = v[7]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [], 1), (905, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    queries = df.where("vec_id % 20 = 0 OR vec_id IN (5, 901)")
    got: dict = {}
    for r in nearest(df, queries, k=10, block=400).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = 0
    for q, found in got.items():
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert all(abs(s[i] - x) < 1e-9 for i, x in found.values())
        hit += len({i for i, _ in found.values()} & set(order))
    assert set(got) == {5, *range(0, 700, 20)} and hit >= 0.9 * 10 * len(got)
    few = df.where("vec_id < 5")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest(few, few.where("vec_id = 0"), k=10).orderBy("rank").collect()][3:] == [(0, 4, few_last(v))]
    assert nearest(df.limit(0), queries).count() == nearest(df, df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids_and_copies(spark):
    """Each query row leaves out itself alone; a third of the rows are copies of one vector."""
    from skeingraph.llm.neighbours import nearest

    few = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.9, 0.1]), (3, [0.5, 0.5]), (4, [0.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest(few, few.where("vec_id = 20"), k=3).collect()))
    assert got == sorted([(20, 1, 20, 0.9), (20, 2, 3, 0.5), (20, 3, 3, 0.5), (20, 1, 20, 0.9), (20, 2, 3, 0.5), (20, 3, 3, 0.5)]) or [g[:3] for g in got] == sorted([(20, 1, 20), (20, 1, 20), (20, 2, 3), (20, 2, 3), (20, 3, 3), (20, 3, 3)])
    rng = np.random.default_rng(6)
    v = rng.standard_normal((3000, 16)).round(3)
    v[rng.choice(3000, 1000, replace=False)] = v[0]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    same = np.flatnonzero((v == v[0]).all(axis=1))
    asked = [int(i) for i in [*same[:30], *range(1, 40)]]
    by: dict = {}
    for r in nearest(table, table.where(table.vec_id.isin(asked)), block=700, part=20).collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in set(asked):
        s = (v * v[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert [x[0] for x in sorted(by[q])] == list(range(1, 21))
        hits += len(set(order) & {x[1] for x in by[q]})
        if q in same:  # the smallest ids among the copies
            assert [x[1] for x in sorted(by[q])] == order
    assert hits >= 0.95 * 20 * len(set(asked))


@pytest.mark.parametrize("n, kind, least", [(100_000, "groups", 0.93), (100_000, "spread", 0.93), (1_000_000, "spread", 0.92)])
def test_recall_and_work_at_size(n, kind, least):
    """64 dimensions with little or no structure: what is found, and how much of the index is touched for it."""
    from skeingraph.llm.neighbours import PIVOTS, Block, budget

    rng = np.random.default_rng(9)
    v = rng.standard_normal((n, 64))
    if kind == "groups":
        v += rng.standard_normal((10, 64))[rng.integers(0, 10, n)] * 0.35
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    pivots = v[:PIVOTS] / np.linalg.norm(v[:PIVOTS], axis=1, keepdims=True)
    q = v[rng.choice(n, 40, replace=False)]
    exact = q @ v.T
    found: list[list] = [[] for _ in q]
    size, read, reranked = 131_072, [], 0

    class Counted(np.ndarray):
        def __getitem__(self, x):
            if isinstance(x, slice):
                read.append(x.stop - x.start)
            return np.asarray(super().__getitem__(x))

    for at in range(0, n, size):
        block = Block(v[at : at + size], pivots)
        block.listed = block.listed.view(Counted)
        most = budget(n, len(block.v))
        reranked += most
        for i, (e, s) in enumerate(block.search(q, most, 21)):
            found[i] += [(x, int(j) + at) for x, j in zip(s.tolist(), e.tolist(), strict=True)]
    hit = sum(len({j for _, j in sorted(f, reverse=True)[:20]} & set(np.argpartition(-exact[i], 20)[:20].tolist())) for i, f in enumerate(found))
    assert hit >= least * 20 * len(q)
    assert reranked < 0.09 * n and sum(read) < 2.3 * n * len(q)  # entries of a list are four bytes and one, vectors 512


def test_neighbours_of_one_length(spark):
    from skeingraph.llm.neighbours import nearest

    rows = [(i, [float(i + 1), 1.0]) for i in range(8)] + [(20, [1.0, 2.0, 3.0]), (40, [5.0]), (60, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(table, table.where("vec_id % 20 = 0"), k=3).collect()
    assert {r.query_id for r in got} == {0, 60} and {r.vec_id for r in got} == {7, 6, 5}


def few_last(v: np.ndarray) -> int:
    return int(min(range(1, 5), key=lambda i: v[i] @ v[0]))


def test_decontaminate(spark, docs, none):
    from skeingraph.llm.decontaminate import contained_items, decontaminate, shingles, split

    rng = random.Random(9)
    texts = [r[1] or "" for r in corpus()]
    items: list[tuple] = [(i, " ".join(words(rng, rng.choice([6, 12, 30, 90, 700])))) for i in range(25)]
    for i in range(12):
        w = WORD.findall(texts[i])
        items.append((100 + i, " ".join(w[2 : 2 + rng.choice([3, 9, 20, 60])]).upper() + "!"))
    long = WORD.findall(texts[-7])
    items += [(200, " ".join(long[100:130])), (201, " ".join(long[5000:5040])), (202, None), (203, "..."), (204, " ".join(long[i] for k in range(8) for i in range(1000 * k, 1000 * k + 6))), (205, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in corpus():
        w = split(r[1])
        for i, t in items:
            s = shingles(split(t))
            if s:
                k = next(iter(s)).count(b" ") + 1
                have = {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)}
                if len(s & have) >= 0.8 * len(s):
                    want.append((r[0], i, len(s & have) / len(s), len(s)))
    assert len(want) > 15
    for limit in (10**6, 50):
        assert sorted(map(tuple, contained_items(docs, benchmark, block_shingles=limit).collect()), key=str) == sorted(want, key=str)
    left = decontaminate(docs, benchmark)
    bad = {x[0] for x in want}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} - {None} == {r[0] for r in corpus()} - bad - {None}
    both = spark.createDataFrame([(None, "so " + " ".join(words(random.Random(1), 9)), 1), (4, " ".join(words(random.Random(1), 9)), 2), (4, "another text of the same id", 3), (None, None, 4)], "doc_id long, text string, k1 int")
    item = spark.createDataFrame([(1, " ".join(words(random.Random(1), 9)))], "item_id long, text string")
    assert sorted(r.k1 for r in decontaminate(both, item).collect()) == [3, 4]
    assert contained_items(none, benchmark).count() == contained_items(docs, benchmark.limit(0)).count() == 0


def test_language(spark, none):
    from skeingraph.llm.language import keep_identified, predict, train

    rng = random.Random(6)
    alphabet = {"aa": "aeioubdg", "bb": "kstrzxqy", "cc": "дежзиклм"}
    make = lambda k: " ".join("".join(rng.choice(alphabet[k]) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 80)))
    rows = [(i, make(k), k) for i in range(240) for k in [list(alphabet)[i // 3 % 3]]]
    odd = [(900, None, "aa"), (901, "123 456", "bb"), (902, make("aa"), None), (903, "", None), (None, make("bb"), "bb"), (904, make("cc") * 300, "cc")]
    df = spark.createDataFrame([r + ("s", 0.5) for r in rows + odd], "doc_id long, text string, lang string, source string, score double")
    m = train(df.where("doc_id % 3 <> 1"))
    got = predict(df, m).collect()
    assert len(got) == len(rows) + len(odd) and m.langs == ["aa", "bb", "cc"]
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == k for i, _, k in rows if i % 3 == 1) >= 0.98 * 80
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "aa", "und", "cc"]
    assert all(0 <= r.score <= 1 for r in got) and by[900].rejected and not by[904].rejected
    kept = keep_identified(df, m)
    assert kept.columns == df.columns and {900, 901, 903}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.where("doc_id = 902").first().lang == "aa"
    assert predict(none, m).count() == 0
    assert {r.lang_pred for r in predict(df, train(df.limit(0))).collect()} == {"und"}


def test_toxicity(spark, none):
    from skeingraph.llm.toxicity import score, train

    rng = random.Random(2)
    plain = lambda: [f"{rng.choice(['be', 'lo', 'ma', 'ti'])}{rng.choice(['nar', 'pel', 'sin', 'tor'])}{rng.choice(['e', 'o', 'um', ''])}" for _ in range(rng.randrange(30, 120))]
    docs, labels = [], []
    for i in range(600):
        w = plain()
        toxic = i % 4 == 0
        for _ in range(6 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["wretchgoblin", "filthmonger", "scumbucket"]))
        docs.append((i, " ".join(w), 0.0))
        labels.append((i, int(toxic)))
    docs += [(900, None, 0.0), (901, "", 0.0), (902, " ".join(plain() * 200), 0.0), (None, "text", 0.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    m = train(d, known.where("doc_id % 5 <> 0"))
    got = score(d, m).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) and sum(by[i].predicted == t for i, t in labels if i % 5 == 0) >= 0.95 * 120
    assert by[900].predicted == by[901].predicted == by[902].predicted == 0 and all(0 <= r.score <= 1 for r in got)
    assert score(none, m).count() == 0
    assert {r.predicted for r in score(d, train(d, known.limit(0))).collect()} <= {0, 1}


def brute_model(texts: list[str]):
    """Interpolated modified Kneser-Ney of order 4, straight from its definition."""
    from collections import Counter

    counts = {4: Counter()}
    for t in texts:
        x = "\1\1\1" + t
        counts[4].update(x[i : i + 4] for i in range(len(t)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, t, saved = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d[k] = [max(0.05, i - (i + 1) * y * n[i] / n[i - 1]) if n[i - 1] and n[i] else i * 0.5 for i in (1, 2, 3)]
        for g, v in c.items():
            t[g[:-1], k] = t.get((g[:-1], k), 0) + v
            saved[g[:-1], k] = saved.get((g[:-1], k), 0) + d[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if (g[:-1], k) not in t:
            return lower
        v = counts[k].get(g, 0)
        own = (v - d[k][min(v, 3) - 1]) / t[g[:-1], k] if v else 0.0
        return own + saved[g[:-1], k] / t[g[:-1], k] * lower

    return p


def test_kneser_ney(spark, monkeypatch):
    from skeingraph.llm import quality
    from skeingraph.llm.common import materialize
    from skeingraph.llm.quality import count_grams, score

    rng = random.Random(1)
    texts = ["".join(rng.choice("aab cd") for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    probe = [*texts[:20], "zzz", "abczd", "é😀", "a", ""]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(probe)], "doc_id long, lang string, text string").repartition(3)
    p = brute_model(texts)
    found = score(docs.unionAll(docs), materialize(count_grams(df), "test")).collect()
    monkeypatch.setattr(quality, "SHARD_ROWS", 5)  # more shards, the same sums
    assert quality.shards_for(60) == 16
    more = score(docs, materialize(count_grams(df), "test")).collect()
    assert sorted((r.doc_id, round(r.log_p, 9), r.n) for r in more for _ in (0, 1)) == sorted((r.doc_id, round(r.log_p, 9), r.n) for r in found)
    for r in found:
        x = "\1\1\1" + probe[r.doc_id]
        if "😀" not in x:
            assert r.n == len(probe[r.doc_id]) and abs(r.log_p - sum(np.log(p(x[i : i + 4])) for i in range(r.n))) < 1e-6


def test_language_rejects_even_texts():
    """Most texts of both languages by halves are less sure than the held-back texts, whose quantile is the threshold."""
    import pyarrow as pa

    from skeingraph.llm.language import fit

    rng = random.Random(7)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    m = fit([make("aeiou" if i % 2 else "kstrz") for i in range(200)], ["aa" if i % 2 else "bb" for i in range(200)])
    sure = m.probabilities(pa.array([make("aeiou") for _ in range(50)])).max(axis=1)
    mixed = m.probabilities(pa.array([make("aeioukstrz") for _ in range(50)])).max(axis=1)
    assert 0.5 < m.threshold <= 1 and (mixed < m.threshold).mean() > 0.5 and (sure >= m.threshold).mean() > 0.9


def test_quality(spark, none):
    from skeingraph.llm.quality import classify

    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "under", "old", "stone", "bridges"]) for _ in range(rng.randrange(40, 120)))
    junk = lambda: "".join(rng.choice("!#$%&QXZ01") for _ in range(300))
    rows = [(i, good() if i % 4 else junk(), "en", 1) for i in range(240)]
    rows += [(900, None, "en", 1), (901, "", None, 1), (902, good(), "xx", 1), (903, "q" * 200_000, "en", 1), (None, good(), "en", 1), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int")
    trusted = df.where("doc_id % 4 <> 0 AND doc_id < 200").select("doc_id")
    got = classify(df, trusted).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].keep == bool(i % 4) for i in range(240))
    assert not by[900].keep and not by[901].keep and by[901].lang == "und" and by[900].perplexity is None
    assert by[902].keep and by[902].perplexity is None and not by[903].keep
    assert sorted(map(tuple, classify(df, trusted.unionAll(trusted), few=0).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert classify(none, trusted).count() == 0
    assert all(r.keep for r in classify(df.where("length(text) > 0"), trusted.limit(0)).collect())


def test_quality_threshold_is_the_quantile(spark):
    from skeingraph.llm.quality import STEP, thresholds

    rows = [("en", i / 1000) for i in range(1, 1001)] + [("de", 2 + i / 500) for i in range(1, 1001)]
    got = {r.lang: r.threshold for r in thresholds(spark.createDataFrame(rows, "lang string, x double"), 0.9).collect()}
    for lang, quantile in (("en", 0.9), ("de", 3.8), (None, 3.6)):
        assert quantile - 1e-9 <= got[lang] <= quantile + STEP
    few = thresholds(spark.createDataFrame([("en", 1.0 + 0.1 * (-1) ** i) for i in range(20)], "lang string, x double")).where("lang = 'en'").first()
    assert abs(few.threshold - 1.2576) < 0.005  # mean 1, spread 0.1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= before
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
