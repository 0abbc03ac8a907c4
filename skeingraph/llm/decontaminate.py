"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items hide in long documents, so a document's own MinHash says nothing about them. Items are
partitioned by their number of shingles; for each size class a document is seen as blocks of about
four times the class's size, and the minimum of a block under each of 64 hash functions is looked up
among the minima of the class's items. Minima of larger blocks are minima of smaller ones, so all
classes cost one pass. An item of q shingles meets a block of 4q (or less) with a chance of at least 0.16
under each function, at a containment of 0.8, even if its shingles lie scattered over the document;
it is missed with a chance below 0.00002, and items of under 8 shingles post each of them instead.
Candidates are then verified by the exact containment of their shingles in the whole document.

The items are the query set: they go to the executors in blocks of bounded size, one scan of the
documents for each block, so no side ever has to fit as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Text, U, grams, materialize, read, released, row_keys, ship, slices, text_of, word_hashes, words_of
from .simhash import without

SHINGLE, CONTAINMENT, FUNCTIONS, LEAST_BLOCK, LEAST_CLASS = 5, 0.8, 64, 32, 8
#: Shingles in one block of items: about 60 MB on each executor.
BLOCK_SHINGLES = 1_000_000
SCHEMA = "k1 long, k2 long, doc_id long, item_id long, containment double, item_shingles int"

#: Words are runs of anything but ASCII white space and punctuation.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_SPLIT = bytes(0x20 if x else i for i, x in enumerate(NOT_WORD))
_A = np.random.default_rng(11).integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * U(2) + U(1)
_FILTER_BITS = 18


def shingles(words: list[bytes]) -> set[bytes]:
    """Runs of five words; fewer words are one shingle, none give none."""
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row for each function: the least 32-bit value of each run of hashes."""
    out = np.empty((FUNCTIONS, len(starts)), np.uint32)
    for i in range(FUNCTIONS):
        out[i] = np.minimum.reduceat(((hashes * _A[i]) >> U(32)).astype(np.uint32), starts)
    return out


class Index:
    """Items of one block: exact shingles, and for each size class the items' minima."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.shingles = [shingles(w) for _, w in items]
        self.short: dict[int, dict[int, list[int]]] = {}  # by words in the shingle: its hash, the items
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (_, words) in enumerate(items):
            if not words:
                continue
            joined = Text(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))]))
            h = np.unique(grams(word_hashes(joined, words_of(joined)), min(SHINGLE, len(words))))
            if len(h) < LEAST_CLASS:
                for x in h.tolist():
                    self.short.setdefault(min(SHINGLE, len(words)), {}).setdefault(x, []).append(k)
            else:
                by.setdefault((len(h) // LEAST_CLASS).bit_length() - 1, []).append((k, h))
        for level, own in by.items():
            sig = minima(np.concatenate([h for _, h in own]), np.cumsum([0, *(len(h) for _, h in own[:-1])]))
            which = np.broadcast_to(np.array([k for k, _ in own]), sig.shape)
            key = (sig.astype(np.uint64) << U(6) | np.arange(FUNCTIONS, dtype=np.uint64)[:, None]).ravel()
            order = np.argsort(key, kind="stable")
            seen = np.zeros((FUNCTIONS, 1 << _FILTER_BITS), bool)
            seen[np.arange(FUNCTIONS)[:, None], sig & np.uint32((1 << _FILTER_BITS) - 1)] = True
            self.classes[level] = (key[order], which.ravel()[order], seen.ravel())

    def candidates(self, hashes: np.ndarray, n_words: np.ndarray, at: np.ndarray, room: np.ndarray, words: np.ndarray) -> set[tuple[int, int]]:
        """(document, item); hashes: of all shingles, at: each document's first."""
        found: set[tuple[int, int]] = set()
        for size, table in self.short.items():
            h = grams(words, size)
            whole = room[: len(h)] >= size
            hit = np.flatnonzero(np.isin(h, np.fromiter(table, np.uint64, len(table))) & whole)
            docs = np.searchsorted(n_words, hit, side="right") - 1
            found.update((int(d), k) for d, x in zip(docs, h[hit].tolist(), strict=True) for k in table[x])
        if not len(hashes) or not self.classes:
            return found
        counts = np.diff(at)
        doc_of = np.repeat(np.arange(len(counts)), counts)
        local = np.arange(len(hashes)) - at[doc_of]
        starts = np.flatnonzero(local % LEAST_BLOCK == 0)
        low, owner, place = minima(hashes, starts), doc_of[starts], local[starts] // LEAST_BLOCK
        rows = (np.arange(FUNCTIONS) << _FILTER_BITS)[:, None]
        for level in range(max(self.classes) + 1):
            if level:
                first = np.flatnonzero(place % 2 == 0)
                low, owner, place = np.minimum.reduceat(low, first, axis=1), owner[first], place[first] // 2
            if level in self.classes:
                key, which, seen = self.classes[level]
                i, j = np.nonzero(seen[rows + (low & np.uint32((1 << _FILTER_BITS) - 1))])
                mine = low[i, j].astype(np.uint64) << U(6) | i.astype(np.uint64)
                a, z = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
                for n in np.flatnonzero(z > a):
                    found.update((int(owner[j[n]]), int(k)) for k in which[a[n] : z[n]])
        return found


def blocks_of_items(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words = split(r[1])
        held.append((r[0], words))
        n += len(words)
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def _search(docs: DataFrame, index: Index, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in slices(batches):
            lowered = pc.utf8_lower(pc.fill_null(b.column("text"), ""))
            text = text_of(lowered)
            words = words_of(text, NOT_WORD)
            own, room = word_hashes(text, words), words.room()
            h = grams(own, SHINGLE)
            whole = room[: len(h)] >= SHINGLE
            at = np.concatenate([[0], np.cumsum(whole)])[np.minimum(words.at, len(h))]
            rows = []
            by_doc: dict[int, list[int]] = {}
            for d, k in index.candidates(h[whole], words.at, at, room, own):
                by_doc.setdefault(d, []).append(k)
            for d, ks in sorted(by_doc.items()):
                said = lowered[d].as_py().encode().translate(_SPLIT).split()
                have = {SHINGLE: {b" ".join(said[i : i + SHINGLE]) for i in range(len(said) - SHINGLE + 1)}}
                for k in sorted(ks):
                    item = index.shingles[k]
                    size = min(SHINGLE, next(iter(item)).count(b" ") + 1)
                    if size not in have:
                        have[size] = {b" ".join(said[i : i + size]) for i in range(len(said) - size + 1)}
                    share = len(item & have[size]) / len(item)
                    if share >= least:
                        rows.append((*(b.column(c)[d].as_py() for c in ("k1", "k2", "doc_id")), index.ids[k], share, len(item)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [*[pa.int64()] * 4, pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    return d.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text").mapInArrow(run, SCHEMA)


def _hits(docs: DataFrame, benchmark: DataFrame, least: float, block_shingles: int) -> DataFrame:
    ship(docs.sparkSession)
    found = None
    for items in blocks_of_items(benchmark, block_shingles):
        part = _search(docs, Index(items), least)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, containment, item_shingles: items with at least `least` of their five-word shingles in a document.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Letters are lower-cased;
    words are cut at ASCII white space and punctuation. An item of fewer than five words is one shingle of all its words;
    one without words is in nothing. Null texts have no words. Each row counts for itself: repeated rows
    give repeated results. Either table empty: no rows.
    """
    return _hits(docs, benchmark, least, block_shingles).drop("k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain a benchmark item, whether they have an id or not.

    Rows are told apart by id and text, so another text of the same doc_id stays.
    """
    return without(docs, materialize(_hits(docs, benchmark, CONTAINMENT, BLOCK_SHINGLES).select("k1", "k2").distinct(), "leaks"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contained_items of all documents and items; nulls, short items, repeats and empty tables as there."""
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
