"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most 4 of 64 bits differ in at most one bit of one of three
segments (22, 21 and 21 bits). Each distinct fingerprint therefore posts, for every segment and every
bit of it, the segment with that bit left out; fingerprints that share a posting are candidates and
are compared in full. Postings are hash-partitioned and sorted, and a task streams over runs of equal
postings: short runs are compared at once by shifts, long ones grow each component from its members
against those not yet reached (very long ones after a second level of keys within the run), and only a spanning forest leaves the task. So a group of thousands of
near copies costs about its size, not its square, and no link between different texts is lost.

Exact copies share a fingerprint and are one node throughout; each fingerprint has 64 postings, so one
posting never holds more than 1/64 of the rows that are dealt out. A task holds a run as eight bytes for each
distinct fingerprint in it. Fingerprints and components that many rows share are joined back by `attach`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, LOWER_ASCII, PIECE, attach, materialize, read, released, row_keys, ship, small
from .components import connected_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs up to the first length are compared by shifts, longer ones by growing components, those over the second by a second level of keys.
SHORT_RUN, LONG_RUN = 48, 4096
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_by_pieces(data: bytes, piece: int) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time; no word is cut."""
    at = 0
    while at < len(data):
        to = at + piece
        if to < len(data):
            cut = _SPACE.search(data, to)
            to = cut.start() if cut else len(data)
        yield data[at:to].split()
        at = to


def fingerprint(text: str | None, shingle: int = SHINGLE, piece: int = PIECE) -> int:
    """Bit set where over half of the shingles' XXH64 have it; no words: 0."""
    import xxhash

    digest, n, held = xxhash.xxh64_intdigest, 0, []
    ones = np.zeros(64, np.int64)
    for some in words_by_pieces((text or "").encode().translate(LOWER_ASCII), piece):
        words = held + some
        many = len(words) - shingle + 1
        if many <= 0:
            held = words
            continue
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: many - 1] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, many)
        ones += np.unpackbits(h.view(np.uint8).reshape(many, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += many
        held = words[many:]
    if not n:
        return digest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """k1, k2 (the row's key), doc_id, fp (the fingerprint's bits as a signed long) for every row; a null text has no words."""
    ship(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "doc_id")), pa.array(fp.view(np.int64))], names=["k1", "k2", "doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    return d.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """key int, fp long: every segment of every fingerprint with each one of its bits left out."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                fp = b.column("fp").slice(at, 1 << 14).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = np.empty((64, len(fp)), np.int32)
                for s, (low, width) in enumerate(SEGMENTS):
                    seg = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    for j in range(width):
                        under = seg & np.uint64((1 << j) - 1)
                        keys[low + j] = ((seg >> np.uint64(j + 1)) << np.uint64(j) | under) | np.uint64((low + j) << 21)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(fp.view(np.int64), 64))], names=["key", "fp"])

    return fps.mapInArrow(run, "key int, fp long")


def forest(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within `most` bits do, one fewer than members of each group."""
    left = np.arange(len(f))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            met = np.full(len(left), -1, np.int64)
            step = max(1, (1 << 22) // len(left))
            for i in range(0, len(front), step):
                open_ = np.flatnonzero(met < 0)
                if not len(open_):
                    break
                near = np.bitwise_count(f[front[i : i + step], None] ^ f[left[open_]][None, :]) <= most
                hit = near.any(axis=0)
                met[open_[hit]] = front[i : i + step][near[:, hit].argmax(axis=0)]
            new = met >= 0
            a.append(met[new])
            b.append(left[new])
            front, left = left[new], left[~new]
    none = [np.empty(0, np.int64)]
    return f[np.concatenate(a or none)], f[np.concatenate(b or none)]


def short_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of equal keys, each a few long."""
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    s = 1
    while len(same := np.flatnonzero(key[s:] == key[:-s])):
        x, y = fp[same], fp[same + s]
        near = np.bitwise_count(x ^ y) <= most
        a.append(x[near])
        b.append(y[near])
        s += 1
    return np.concatenate(a), np.concatenate(b)


def run_links(key: np.ndarray, fp: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys (postings' keys)."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [len(key)]]))
    short = np.repeat((size > 1) & (size <= SHORT_RUN), size)
    found = [short_links(key[short], fp[short], most)]
    for i in np.flatnonzero(size > SHORT_RUN):
        f = fp[start[i] : start[i] + size[i]]
        low, width = next(x for x in reversed(SEGMENTS) if int(key[start[i]]) >> 21 >= x[0])
        found.append(second_level(f, low, width, most) if len(f) > LONG_RUN else forest(f, most))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def second_level(f: np.ndarray, low: int, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a long run that shares a segment but for a bit.

    The bits outside of the segment are cut into `most` + r pieces, of which two near fingerprints share r, so each choice of r pieces in
    turn is a key; r is so large that the keys are about as many as the run is long.
    """
    outside = (f & np.uint64((1 << low) - 1)) | ((f >> np.uint64(low + width)) << np.uint64(low) if low + width < 64 else np.uint64(0))
    bits = 64 - width
    r = next((r for r in (2, 3, 4) if bits * r // (most + r) >= len(f).bit_length() - 1), 5)
    edges = np.linspace(0, bits, most + r + 1).astype(int).tolist()
    pieces = [((outside >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1), z - a) for a, z in zip(edges, edges[1:])]
    a, b = [], []
    for chosen in itertools.combinations(pieces, r):
        key = np.zeros(len(f), np.uint64)
        for piece, size in chosen:
            key = key << np.uint64(size) | piece
        order = np.argsort(key, kind="stable")
        g, key = f[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(g)]]))
        many = np.repeat((size > 1) & (size <= SHORT_RUN), size)
        found = [short_links(key[many], g[many], most)]
        found += [forest(g[start[j] : start[j] + size[j]], most) for j in np.flatnonzero(size > SHORT_RUN)]
        a += [p for p, _ in found]
        b += [q for _, q in found]
    return np.concatenate(a), np.concatenate(b)


def links(distinct_fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """a, b: verified links between different fingerprints, enough to join whatever all of them would."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = run_links(key, fp, most) if len(key) else (fp, fp)
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, whole_at = 0, 1 << 19
        for b in batches:
            held.append((b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)))
            rows += b.num_rows
            if rows >= whole_at:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.searchsorted(key, key[-1]))  # the last run may go on
                if last:
                    yield out(key[:last], fp[:last])
                held, rows = [(key[last:], fp[last:])], len(key) - last
                whole_at = max(1 << 19, 2 * rows)
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    if most // len(SEGMENTS) > 1:
        raise ValueError("three segments bear at most five differing bits")
    return postings(distinct_fps).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """k1, k2, doc_id, fp, component_id, best (the key of the component's first row) for every row.

    The first row is the one of the smallest doc_id, of the smallest text hash among equal ids; null ids come last.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
    firsts = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), best.alias("best"), F.count("*").alias("n")), "firsts")
    roots = connected_components(links(firsts.select("fp"), most), "a", "b")
    nodes = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", "best", "n", F.coalesce("root", "fp").alias("root"))
    nodes = materialize(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"), F.min("best").alias("chosen"), F.count("*").alias("c"))
    known = attach(nodes, materialize(least, "least"), ["root"], "c", nodes.count()).select("fp", "n", "component_id", F.col("chosen").alias("best"))
    return attach(fps, materialize(known, "known"), ["fp"], "n", fps.count()).select("k1", "k2", "doc_id", "fp", "component_id", "best")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, its own included) for every row.

    docs: doc_id, text; other columns are ignored. Null, empty and wordless texts have fingerprint zero
    and are linked like any other. Rows with the same doc_id each stay. A component whose doc_ids are all
    null has a null id. An empty table gives no rows.
    """
    return grouped(docs).select("doc_id", "fp", "component_id")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """k1, k2 (the row's key), row (all columns of docs)."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    k1, k2 = row_keys(F.col("row.doc_id").cast("long"), F.col("row.text").cast("string"))
    return d.select(k1.alias("k1"), k2.alias("k2"), "row")


def without(docs: DataFrame, keys: DataFrame, few: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs whose key (k1, k2) is not in keys, a materialized table."""
    return keyed_rows(docs).join(small(keys, few), ["k1", "k2"], "left_anti").select("row.*")


def keep_first(docs: DataFrame, few: int = BROADCAST_IDS) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id. Columns and texts stay as they are.

    Rows are told apart by id and text: of different texts of one doc_id each has its own group, null ids come last in
    theirs, and of rows equal in both one stays.
    """
    rows = materialize(grouped(docs).select("k1", "k2", (F.struct("k1", "k2") == F.struct("best.k1", "best.k2")).alias("first")), "groups")
    gone = materialize(rows.where("NOT first").select("k1", "k2").distinct(), "gone")
    again = materialize(rows.where("first").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"), "again")
    kept = keyed_rows(docs).join(small(gone, few), ["k1", "k2"], "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    side = small(again, few)
    one = kept.join(side, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return kept.join(side, ["k1", "k2"], "left_anti").select("row.*").unionAll(one.select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents; nulls, empty texts, repeats and empty tables as there."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
