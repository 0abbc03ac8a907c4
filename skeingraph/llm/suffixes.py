"""Suffix-array deduplication of bytes with a logarithmic index family.

A byte goes if a 200-byte string that covers it also starts anywhere else. The strings that may
repeat are found by anchors (see `passages`) and dealt into shards. Every window of a passage holds its anchor, so it
is what lies left of the anchor's first byte, read backwards, and the suffix that starts there. A shard takes its
passages in batches. Each batch gets two suffix arrays: its passages in the order of their suffixes at the anchor,
and in the order of what lies before it, backwards. It becomes a level of the shard's index family; while the last two
levels are about equal in size they merge, by one scan over each pair of arrays, so there are never more than the
logarithm of the number of batches. When all batches are in, the levels left are merged, so every two passages have
met. The common prefixes of neighbours then tell which windows are equal: those with o bytes before the anchor that lie
between the same places with less than o common bytes in the one array, and less than 200 - o in the other. Where an
anchor's passages are dealt into several parts, each part has a family of its own, and windows of different parts are
summed up by their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, attach, materialize, read
from .passages import KEY, Units, distinct_passages, in_shards, keyed, outcomes_by_row, passages, shards, windows_of

WINDOW = 200
UNITS = Units(words=False, window=WINDOW, gram=24, piece=1 << 18)
#: Bytes of passages in one shard (a group may exceed it) and in one batch of it, and distinct passages of one anchor in a group.
SHARD, BATCH, GROUP = 1 << 22, 1 << 19, 16_384


class Array:
    """Strings of bounded length in order (shorter ones as if zeros followed), and whose they are."""

    def __init__(self, strings: list[bytes], owners: list[int], ordered: bool = False):
        order = range(len(strings)) if ordered else sorted(range(len(strings)), key=strings.__getitem__)
        self.strings, self.owners = [strings[i] for i in order], [owners[i] for i in order]

    def merged(self, other: Array) -> Array:
        return Array(self.strings + other.strings, self.owners + other.owners)  # two runs, which the sort merges in one scan

    def common(self, width: int) -> np.ndarray:
        """How many bytes each string has in common with the one before (the first: -1)."""
        m = np.frombuffer(b"".join(self.strings), np.uint8).reshape(-1, width)
        out = np.full(len(m), -1, np.int32)
        for i in range(1, len(m), 4096):  # a bounded part of the differences at a time
            differ = m[i : i + 4096] != m[i - 1 : i - 1 + len(m[i : i + 4096])]
            out[i : i + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        return out


class Family:
    """Levels of suffix arrays over batches of passages with their anchors' places, and how often each passage stands anywhere."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.levels: list[tuple[Array, Array]] = []
        self.before: list[int] = []
        self.after: list[int] = []
        self.copies: list[int] = []

    def add(self, contents: list[bytes], places: list[int], counts: list[int]) -> None:
        """A new batch. Passages are different strings; counts: how often each stands anywhere."""
        own = list(range(len(self.copies), len(self.copies) + len(contents)))
        w = self.window
        self.before += [min(p, w) for p in places]
        self.after += [min(len(c) - p, w) for c, p in zip(contents, places, strict=True)]
        self.copies += counts
        right = Array([c[p : p + w].ljust(w, b"\0") for c, p in zip(contents, places, strict=True)], own)
        left = Array([c[max(0, p - w) : p][::-1].ljust(w, b"\0") for c, p in zip(contents, places, strict=True)], own)
        self.levels.append((right, left))
        while len(self.levels) > 1 and len(self.levels[-2][0].owners) <= 2 * len(self.levels[-1][0].owners):
            self._merge_last()

    def _merge_last(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        self.levels.append((b[0].merged(a[0]), b[1].merged(a[1])))

    def finish(self) -> list[np.ndarray]:
        """For each passage, which of its windows repeat."""
        while len(self.levels) > 1:
            self._merge_last()
        w, many = self.window, len(self.copies)
        if not many:
            return []
        before, after, copies = np.array(self.before), np.array(self.after), np.array(self.copies)
        common = [x.common(w) for x in self.levels[0]]
        rank = np.empty((2, many), np.int64)
        for k, x in enumerate(self.levels[0]):
            rank[k, x.owners] = np.arange(many)
        first = before + after - w  # the last window's bytes before the anchor are before - first
        out = [np.full(n + 1, c > 1) for n, c in zip(first.tolist(), copies.tolist(), strict=True)]
        flat, at = np.concatenate(out), np.cumsum(first + 1) - first - 1
        for o in range(int(before.max()) + 1):
            mine = np.flatnonzero((before >= o) & (after >= w - o))
            if not len(mine):
                continue
            right, left = np.cumsum(common[0] < w - o), np.cumsum(common[1] < o)
            key = right[rank[0, mine]] << 32 | left[rank[1, mine]]
            order = np.argsort(key)
            same = np.flatnonzero(key[order][1:] == key[order][:-1])
            hit = mine[order[np.concatenate([same, same + 1])]]
            flat[at[hit] + before[hit] - o] = True
        return np.split(flat, at[1:])


def resolve(distinct: DataFrame, keep: bool = False) -> DataFrame:
    """digest, bits (a bit for each window, set if it repeats), m, and with keep content and n; distinct: see distinct_passages."""
    schema = "digest binary, bits binary, m long" + (", content binary, n long" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents, places, digests, n, m in shards(batches, SHARD, ("content", "place", "digest", "n", "m")):
            family, first, size = Family(), 0, 0
            for i, c in enumerate(contents):
                size += len(c)
                if size >= BATCH or i == len(contents) - 1:
                    family.add(contents[first : i + 1], places[first : i + 1], n[first : i + 1])
                    first, size = i + 1, 0
            bits = [np.packbits(x).tobytes() for x in family.finish()]
            cols = [pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.array(m, pa.int64())]
            cols += [pa.array(contents, pa.binary()), pa.array(n, pa.int64())] if keep else []
            out = pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])
            yield out if keep else out.filter(pa.array([x.strip(b"\0") != b"" for x in bits]))

    return in_shards(distinct).mapInArrow(run, schema)


def byte_windows(content: bytes) -> list[bytes]:
    return [content[i : i + WINDOW] for i in range(len(content) - WINDOW + 1)]


def over_parts(resolved: DataFrame) -> DataFrame:
    """digest, bits, m of passages whose anchor was dealt into parts: windows that repeat in any of the parts or across them."""
    done = materialize(resolved, "parts")
    windows = materialize(windows_of(done, byte_windows, "n", "long"), "windows")
    again = materialize(windows.groupBy("print").agg(F.sum("n").alias("s"), F.count("*").alias("c")).where("s > 1"), "again")
    each = attach(windows.select("digest", "i", "print"), again, ["print"], "c", windows.count()).groupBy("digest").agg(F.collect_list("i").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = []
            for at in b.column("at").to_pylist():
                hit = np.zeros(max(at) + 1, bool)
                hit[at] = True
                bits.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(bits, pa.binary())], names=["digest", "bits"])

    return each.mapInArrow(run, "digest binary, bits binary").join(done.select("digest", "m"), "digest")


def removed_bytes(n: int, spots: list[dict] | None) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for s in spots or ():
        start = s["at"] + np.flatnonzero(np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=s["windows"]))
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
    return np.cumsum(step[:n]) > 0


def repeated_bytes(docs: DataFrame, group: int = GROUP, few: int = BROADCAST_IDS) -> DataFrame:
    """row, id, spots (at, windows, bits) for every row: where 200-byte strings repeat."""
    rows = keyed(docs)
    spots = materialize(passages(rows, F.sum("n") > 1, UNITS, few), "passages")
    whole, split = distinct_passages(spots, group)
    bits = resolve(whole)
    if split is not None:
        bits = bits.unionAll(over_parts(resolve(split, keep=True)).select(bits.columns))
    bits = materialize(bits, "bits")
    hits = attach(spots.select(*KEY, "copies", "at", "windows", "digest"), bits, ["digest"], "m", spots.count())
    return outcomes_by_row(rows, hits.select(*KEY, "copies", "at", "windows", "bits"), few)


def _cleaned(docs: DataFrame, schema: str, row, group: int = GROUP, few: int = BROADCAST_IDS) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data = (b.column("row").field("text")[i].as_py() or "").encode()
                gone = removed_bytes(len(data), b.column("spots")[i].as_py())
                kept = data if not gone.any() else np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append(row(b.column("row").field("doc_id")[i].as_py(), data, kept, spans))
            by = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(by, schema.split(", "), strict=True)], names=names)

    return repeated_bytes(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), group, few).mapInArrow(run, schema)


def suffix_digest(docs: DataFrame, group: int = GROUP, few: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    docs: doc_id, text; other columns are ignored. A null text is empty; texts of under 200 bytes lose
    nothing. Every row is a text of its own: of repeated rows, each holds what the other holds. An empty
    table gives no rows.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _cleaned(docs, schema, lambda d, data, kept, spans: (d, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()), group, few)


def cut_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, kept: the remaining bytes of every row (a cut may fall inside a character)."""
    return _cleaned(docs, "doc_id long, kept binary", lambda d, data, kept, spans: (d, kept))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix_digest of all documents; nulls, empty texts, repeats and empty tables as there."""
    return suffix_digest(read(spark, sf_dir, "documents"))
