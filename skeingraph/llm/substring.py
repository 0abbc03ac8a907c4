"""Substring deduplication across documents by suffix automata.

A window of 50 words goes if the same words also start in a document of a smaller id. Texts that may
share windows are found by anchors (see `passages`). Their distinct passages are the reference, dealt
into shards of bounded size; a shard's suffix automaton is built over its passages, those of the smallest
ids first, while the passages are streamed through it: it keeps the length of the longest match that ends at
each word, and where that reaches 50, the state that holds the last 50 words knows the smallest document
they start in. A passage that is not matched throughout joins the reference. Its letters are the words
themselves, so a match is an equality of words. Where an anchor's passages are dealt into several parts,
each part has an automaton of its own, and their answers for a window are summed up by its digest. The
windows' documents go back to all texts that hold the passage, and each text loses the maximal spans covered
by windows of smaller documents.

The automata are built where they are used: the reference here is the corpus itself, so to broadcast every
shard to all documents would cost the square of the corpus; a shard is sent exactly the passages that can match in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, attach, materialize, read, released
from .passages import KEY, Units, distinct_passages, in_shards, keyed, outcomes_by_row, passages, shards, windows_of

WINDOW = 50
UNITS = Units(words=True, window=WINDOW, gram=8, piece=1 << 19)
#: Bytes of reference passages in one shard (about 20,000 states' worth; a group may exceed it), and distinct passages of one anchor in a group.
SHARD, GROUP = 1 << 17, 4096


class Automaton:
    """Suffix automaton of several sequences; first[s]: the smallest document that a state's strings end in, if added in order."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, sequence: list[int], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:  # already there, from an earlier sequence
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            now = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(doc)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = now
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[now] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = now

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def windows(self, sequence: list[int], window: int) -> list[int]:
        """For each window of the sequence: the first document that holds it, or -1."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        found = []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is not None:
                state, matched = to, matched + 1
            if matched > window:
                matched = window
            while length[link[state]] >= window if state else False:
                state = link[state]
            if i >= window - 1:
                found.append(first[state] if matched >= window else -1)
        return found


def shard_windows(group: list[tuple[int, list[int]]], window: int) -> list[np.ndarray]:
    """For a shard's distinct passages, by ascending document: the smallest document of every window; one number if all agree."""
    out, automaton = [], Automaton()
    for doc, sequence in group:
        least = np.array(automaton.windows(sequence, window), np.int64)
        fresh = least < 0
        if fresh.any():
            automaton.add(sequence, doc)
        least[fresh] = doc
        out.append(least[:1] if (least == least[0]).all() else least)
    return out


def resolve(distinct: DataFrame, window: int, keep: bool = False) -> DataFrame:
    """digest, least (array), m, and with keep the content; distinct: see distinct_passages. Right within each group."""
    schema = "digest binary, least array<long>, m long" + (", content binary" if keep else "")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contents, digests, ids, m in shards(batches, SHARD, ("content", "digest", "id", "m")):
            order = sorted(range(len(ids)), key=lambda i: (ids[i], digests[i]))  # over all groups: a shard may hold several parts of one anchor
            contents, digests, ids, m = ([x[i] for i in order] for x in (contents, digests, ids, m))
            letters: dict[bytes, int] = {}
            group = [(doc, [letters.setdefault(w, len(letters)) for w in c.split(b" ")]) for doc, c in zip(ids, contents, strict=True)]
            cols = [pa.array(digests, pa.binary()), pa.array(shard_windows(group, window), pa.list_(pa.int64())), pa.array(m, pa.int64())]
            cols += [pa.array(contents, pa.binary())] if keep else []
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return in_shards(distinct).mapInArrow(run, schema)


def word_windows(content: bytes) -> list[bytes]:
    words = content.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def over_parts(resolved: DataFrame) -> DataFrame:
    """digest, least, m of passages whose anchor was dealt into parts: the smallest document of all parts for each window."""
    done = materialize(resolved, "parts")
    windows = materialize(windows_of(done, word_windows, "least", "long"), "windows")
    first = materialize(windows.groupBy("print").agg(F.min("least").alias("first"), F.count("*").alias("c")), "first")
    each = attach(windows.select("digest", "i", "print"), first, ["print"], "c", windows.count())
    lists = each.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("i", "first"))).alias("w"))
    return lists.select("digest", F.transform("w", lambda x: x["first"]).alias("least")).join(done.select("digest", "m"), "digest")


def repeated_windows(docs: DataFrame, group: int = GROUP, few: int = BROADCAST_IDS) -> DataFrame:
    """row, id, spots (at, windows, least) for every row: where windows may repeat, and their smallest document."""
    rows = keyed(docs)
    spots = materialize(passages(rows, F.min("id") < F.max("id"), UNITS, few), "passages")
    whole, split = distinct_passages(spots, group)
    found = resolve(whole, WINDOW)
    if split is not None:
        found = found.unionAll(over_parts(resolve(split, WINDOW, keep=True)).select(found.columns))
    found = materialize(found, "least")
    hits = attach(spots.select(*KEY, "id", "copies", "at", "windows", "digest"), found, ["digest"], "m", spots.count())
    hits = hits.where(F.array_min("least") < F.col("id")).select(*KEY, "copies", "at", "windows", "least")
    return outcomes_by_row(rows, hits, few)


def removed_words(n: int, own: int, spots: list[dict] | None) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for s in spots or ():
        least = np.array(s["least"], np.int64)
        start = s["at"] + np.flatnonzero(np.broadcast_to(least < own, s["windows"]) if len(least) == 1 else least < own)
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
    return np.cumsum(step[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, list[tuple[list[bytes], list[bytes]]]]]:
    """A few rows at a time, and for each its words and those that stay; split texts take ten times their size."""
    for b in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
        rows, out = b.column("row"), []
        for text, own, spots in zip(rows.field("text"), b.column("id").to_pylist(), b.column("spots"), strict=True):
            words = (text.as_py() or "").encode().split()
            spots = spots.as_py()
            gone = removed_words(len(words), own, spots).tolist() if spots else ()
            out.append((words, [w for w, g in zip(words, gone, strict=True) if not g] if spots else words))
        yield rows, out


def substring_digest(docs: DataFrame, group: int = GROUP, few: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    docs: doc_id, text; other columns are ignored. A null text has no words; texts of under 50 words lose
    nothing. A null doc_id comes after all ids, and rows with one id (repeated rows, or null ids) take nothing from each
    other. An empty table gives no rows.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, kept in _kept(batches):
            n = np.array([(len(w), len(w) - len(k)) for w, k in kept], np.int64).reshape(-1, 2)
            sha = [hashlib.sha256(b" ".join(k)).hexdigest() for _, k in kept]
            yield pa.RecordBatch.from_arrays([rows.field("doc_id"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return repeated_windows(slim, group, few).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of text, and n_chars (if there) counted anew.

    A text that loses nothing stays as it is, null texts included; of the others the kept words are joined by single
    spaces. Every row and column stays.
    """
    names = docs.columns

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, kept in _kept(batches):
            cut = [None if len(w) == len(k) else b" ".join(k).decode() for w, k in kept]
            cols = {c: rows.field(c) for c in names}
            cols["text"] = pc.coalesce(pa.array(cut, cols["text"].type), cols["text"])
            if "n_chars" in cols:
                cols["n_chars"] = pc.coalesce(pa.array([None if c is None else len(c) for c in cut], cols["n_chars"].type), cols["n_chars"])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return repeated_windows(docs).mapInArrow(run, docs.schema)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """substring_digest of all documents; nulls, empty texts, repeats and empty tables as there."""
    return substring_digest(read(spark, sf_dir, "documents"))
