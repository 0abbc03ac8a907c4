"""Where equal windows of documents can lie: what the two exact substring operators share.

Every window of W units (words or bytes) picks its anchor, the k-gram of least hash inside it. Equal
windows pick equal anchors at equal places, so a window whose anchor occurs once repeats nowhere. A
repeated anchor leads to the windows that picked it, which follow each other: they make one passage of
at most 2W-k units. Equal windows lie in passages of one anchor, so passages are compared anchor by
anchor; equal passages are one, however many documents hold them.

The stages are: anchors of all texts (one scan); anchors that repeat (an aggregation, joined back);
passages of the texts that hold such (a join on the row's key and a second look at the text); distinct
passages; then the operator's own comparison, whose outcome goes back to the texts by the passage's digest.

Anchors only select; what is compared is the content. Keys of contents are 128-bit digests. A row is known by its
id and a hash of its text, so repeated rows are looked at once and share the outcome. Hot anchors, digests and rows
are joined by `attach`; passages of an anchor that has more than `group` distinct ones are dealt into parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, BROADCAST_IDS, LETTER, SEPARATOR, WBASE, WBASE_INV, Text, U, attach, joined, materialize, prefix_sums, released, row_keys, ship, slices, sliding_min, small, span_hash, word_hashes, words_of

#: A row without an id comes after all others.
NO_ID = 2**63 - 1
#: Bytes of one text that are looked at together; windows over a seam belong to the segment they start in.
SEGMENT = 1 << 20
KEY = ["k1", "k2"]
_PLACE = U(24)


@dataclass(frozen=True)
class Units:
    """words or bytes; the window; the anchor's length; bytes of text that are looked at together."""

    words: bool
    window: int
    gram: int
    piece: int

    def content(self, text: str) -> bytes:
        """What is compared: the text's bytes, or its words with single spaces between."""
        return b" ".join(text.encode().split()) if self.words else text.encode()

    def segments(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Text]]:
        """Contents a few at a time, a long one in overlapping segments: the rows, the unit each begins with, the contents."""
        texts = [self.content(t) for t in column.to_pylist()]
        if sum(map(len, texts)) <= SEGMENT:
            yield np.arange(len(texts)), np.zeros(len(texts), np.int64), joined(texts)
            return
        for row, t in enumerate(texts):
            if self.words:
                space = np.flatnonzero(np.frombuffer(t, np.uint8) == 32)
                start, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(t)]])
                step, n = SEGMENT // 8, len(start)
            else:
                step, n = SEGMENT, len(t)
            for at in range(0, n - self.window + 1, step):
                last = min(n, at + step + self.window - 1)
                part = t[start[at] : end[last - 1]] if self.words else t[at:last]
                yield np.array([row]), np.array([at]), joined([part])

    def anchors(self, text: Text) -> tuple[np.ndarray, ...]:
        """For each run of windows with the same anchor: its document, first unit, start, anchor and end in bytes, windows, anchor's hash."""
        words = words_of(text, SEPARATOR) if self.words else None
        values, at = (word_hashes(text, words), words.at) if self.words else (LETTER[text.data], text.at)
        base, inverse = (WBASE, WBASE_INV) if self.words else (BASE, BASE_INV)
        none = np.empty(0, np.int64)
        if len(values) < self.window:
            return none, none, none, none, none, none, none.astype(np.uint64)
        i = np.arange(len(values) - self.gram + 1)
        g = span_hash(prefix_sums(values, base), i, i + self.gram, inverse)
        least = sliding_min((g >> _PLACE << _PLACE) | i.astype(np.uint64), self.window - self.gram + 1)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
        valid = np.flatnonzero(np.arange(len(least)) + self.window <= at[doc + 1])
        if not len(valid):
            return none, none, none, none, none, none, none.astype(np.uint64)
        place = (least[valid] & ((U(1) << _PLACE) - U(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(valid) != 1)]))
        first, last = valid[new], valid[np.concatenate([new[1:], [len(valid)]]) - 1]
        doc = doc[first]
        a, k, z = (words.start[first], words.start[place[new]], words.end[last + self.window - 1]) if self.words else (first, place[new], last + self.window)
        return doc, first - at[doc], a, k, z, last - first + 1, g[place[new]]


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 (the row's key), id, text, row (all columns of docs)."""
    ship(docs.sparkSession)
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    d = d.select(F.col("row.doc_id").cast("long").alias("d"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"), "row")
    k1, k2 = row_keys(F.col("d"), F.col("text"))
    return d.select(k1.alias("k1"), k2.alias("k2"), F.coalesce("d", F.lit(NO_ID)).alias("id"), "text", "row")


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    """k1, k2, id, anchor, n: how many runs of windows each row has for each anchor."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=units.piece):
            for row, _, text in units.segments(b.column("text")):
                doc, _, _, _, _, _, h = units.anchors(text)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
                n = np.diff(np.concatenate([start, [len(h)]]))
                which = pa.array(row[doc[start]])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(which) for c in ("k1", "k2", "id")), pa.array(h[start].view(np.int64)), pa.array(n.astype(np.int32))], names=["k1", "k2", "id", "anchor", "n"])

    return rows.select("k1", "k2", "id", "text").mapInArrow(run, "k1 long, k2 long, id long, anchor long, n int")


def passages(rows: DataFrame, repeats: Column, units: Units, few: int = BROADCAST_IDS) -> DataFrame:
    """k1, k2, id, copies (rows of this key), at (first unit), windows, anchor, place (its first byte), content, digest of every passage whose anchor repeats.

    repeats: over an anchor's rows (id, n), whether it repeats.
    """
    all_ = materialize(anchors(rows, units), "anchors")
    again = materialize(all_.groupBy("anchor").agg(repeats.alias("again"), F.count("*").alias("m")).where("again").select("anchor", "m"), "again")
    mine = attach(all_.select(*KEY, "anchor"), again, ["anchor"], "m", all_.count())
    held = materialize(mine.groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors")), "held")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, limit=units.piece):
            wanted = [np.sort(x.values.to_numpy().view(np.uint64)) for x in b.column("anchors")]
            for row, base, text in units.segments(b.column("text")):
                doc, first, a, place, z, windows, h = units.anchors(text)
                cut = np.searchsorted(doc, np.arange(len(row) + 1))
                hit = [i + np.flatnonzero(np.isin(h[i:j], wanted[row[k]])) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False))]
                hit = np.concatenate(hit) if hit else np.empty(0, np.int64)
                data = text.data.tobytes()
                content = [data[i:j] for i, j in zip(a[hit].tolist(), z[hit].tolist(), strict=True)]
                digest = [xxhash.xxh3_128_digest(x) for x in content]
                which = pa.array(row[doc[hit]])
                new = [pa.array(first[hit] + base[doc[hit]]), pa.array(windows[hit].astype(np.int32)), pa.array(h[hit].view(np.int64)), pa.array((place - a)[hit].astype(np.int32)), pa.array(content, pa.binary()), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(which) for c in ("k1", "k2", "id", "copies")), *new], names=["k1", "k2", "id", "copies", "at", "windows", "anchor", "place", "content", "digest"])

    texts = rows.select(*KEY, "id", "text").join(small(held.select(*KEY), few), KEY, "left_semi")
    once = texts.groupBy(*KEY).agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    return once.join(held, KEY).mapInArrow(run, "k1 long, k2 long, id long, copies long, at long, windows int, anchor long, place int, content binary, digest binary")


def distinct_passages(spots: DataFrame, group: int) -> tuple[DataFrame, DataFrame | None]:
    """anchor, part, digest, place, content, id (the smallest), n (rows that hold it, with copies), m (of spots): passages to be compared.

    First those of anchors with at most `group` distinct ones, all in part 0; then, if there are such, the others, dealt into
    parts of about `group`. spots: materialized.
    """
    shape = [F.min("id").alias("id"), F.sum("copies").alias("n"), F.count("*").alias("m")]
    own = ["anchor", "digest", "place", "content"]
    columns = ["anchor", "part", "digest", "place", "content", "id", "n", "m"]
    many = spots.groupBy("anchor", "digest").agg(F.count("*").alias("c")).groupBy("anchor").agg(F.count("*").alias("distinct"), F.sum("c").alias("c"))
    hot = materialize(many.where(F.col("distinct") > group), "hot")
    if hot.isEmpty():
        return spots.groupBy(*own).agg(*shape).withColumn("part", F.lit(0)).select(columns), None
    whole = spots.join(small(hot.select("anchor")), "anchor", "left_anti").groupBy(*own).agg(*shape).withColumn("part", F.lit(0))
    total = hot.agg(F.sum("c")).first()[0]
    split = attach(spots, hot, ["anchor"], "c", total).groupBy(*own, "distinct").agg(*shape)
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("distinct") / group)).cast("int")
    return whole.select(columns), split.withColumn("part", part).select(columns)


def in_shards(distinct: DataFrame) -> DataFrame:
    """Each group of passages (an anchor's part) next to each other."""
    return distinct.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "digest")


def shards(batches: Iterator[pa.RecordBatch], limit: int, columns: tuple[str, ...]) -> Iterator[list[list]]:
    """Columns of whole groups, about limit bytes of content at a time; columns: content first."""
    held: list[list] = [[] for _ in columns]
    size, now = 0, None
    for b in batches:
        for group, row in zip(zip(b.column("anchor").to_pylist(), b.column("part").to_pylist(), strict=True), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if group != now and size >= limit:
                yield held
                held, size = [[] for _ in columns], 0
            now = group
            size += len(row[0])
            for column, x in zip(held, row, strict=True):
                column.append(x)
    if size:
        yield held


def windows_of(passages_: DataFrame, cut: Callable[[bytes], list[bytes]], extra: str, kind: str) -> DataFrame:
    """digest, i, print (128 bits), and extra's i-th element (or its one value) of every window of passages."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                prints = [[xxhash.xxh3_128_digest(w) for w in cut(c)] for c in part.column("content").to_pylist()]
                many = np.array([len(x) for x in prints], np.int64)
                which = pa.array(np.repeat(np.arange(len(many)), many))
                i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                values = [np.broadcast_to(np.atleast_1d(x), n) for x, n in zip(part.column(extra).to_pylist(), many, strict=True)]
                cols = [part.column("digest").take(which), pa.array(i.astype(np.int32)), pa.array([p for x in prints for p in x], pa.binary()), pa.array(np.concatenate(values).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["digest", "i", "print", extra])

    return passages_.select("digest", "content", extra).mapInArrow(run, f"digest binary, i int, print binary, {extra} {kind}")


def outcomes_by_row(rows: DataFrame, spots: DataFrame, few: int = BROADCAST_IDS) -> DataFrame:
    """row, id and for rows that have any the list of spots (struct); spots: k1, k2, copies and columns."""
    own = [c for c in spots.columns if c not in (*KEY, "copies")]
    per_row = materialize(spots.groupBy(*KEY).agg(F.first("copies").alias("copies"), F.collect_list(F.struct(*own)).alias("spots")), "spots")
    slim = rows.select(*KEY, "row", "id")
    total = per_row.agg(F.sum("copies")).first()[0] or 0
    keys = per_row.select(*KEY)
    if keys.count() <= few:  # then only rows with outcomes are shuffled
        inside = slim.join(F.broadcast(keys), KEY, "left_semi")
        outside = slim.join(F.broadcast(keys), KEY, "left_anti")
    else:
        inside, outside = slim, slim.join(keys, KEY, "left_anti")
    found = attach(inside, per_row, KEY, "copies", total).select("row", "id", "spots")
    return found.unionAll(outside.select("row", "id", F.lit(None).cast(per_row.schema["spots"].dataType).alias("spots")))
