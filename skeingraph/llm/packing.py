"""Hierarchical multi-length packing of tokenized documents into training sequences.

Every document is its token ids plus an end id. Its full longest windows go to the longest tier; what
is left is routed to the shortest tier that holds it. Tiers are packed from the longest down: each
routed remainder opens a window, and the gap behind it is filled with the largest remainders of
shorter tiers that fit, then with a piece cut from one of them. When the shorter tiers run dry a
window is filled from its own tier. A task keeps at most `chunk_tokens` ids; its unfinished window
goes on into the next chunk, and the very last one is cut into powers of two, so nothing is padded.
There is no shuffle: a task packs its own input split, so the work is linear and any lost task is
redone from its split alone.

Step groups: in each chunk the sequences of a tier are dealt, dearest first and back and forth, to
groups of `step_tokens` tokens, so that groups of a tier cost about the same attention work.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, released, ship, slices
from .tokens import default_vocabulary, encoder

END_ID = 1
TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Remainders by length; finds the longest that fits a gap through one integer's bits."""

    def __init__(self) -> None:
        self.by: dict[int, list] = {}
        self.bits = 0

    def add(self, length: int, piece: tuple) -> None:
        self.by.setdefault(length, []).append(piece)
        self.bits |= 1 << length

    def longest(self, most: int) -> int:
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def pop(self, length: int) -> tuple:
        own = self.by[length]
        piece = own.pop()
        if not own:
            self.bits &= ~(1 << length)
        return piece


def pack(lengths: list[int], tiers: tuple[int, ...], carried: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Windows of exactly a tier's size as lists of (document, start, length); what is left, under the longest tier.

    carried: pieces that an earlier call left.
    """
    longest, pool, windows = tiers[0], Pool(), []
    for doc, start, n in carried:
        pool.add(n, (doc, start))
    for doc, n in enumerate(lengths):
        full = n // longest
        windows += [(longest, [(doc, k * longest, longest)]) for k in range(full)]
        if n % longest:
            pool.add(n % longest, (doc, full * longest))
    rest: list[tuple[int, int, int]] = []
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        while (n := pool.longest(tier)) > below:
            doc, start = pool.pop(n)
            window, gap = [(doc, start, n)], tier - n
            while gap:
                n = pool.longest(min(gap, below) if below else gap)
                if n <= 0:
                    n = pool.longest(below) if below else -1
                    n = n if n > 0 else pool.longest(tier)
                    if n <= 0:
                        break
                doc, start = pool.pop(n)
                took = min(n, gap)
                window.append((doc, start, took))
                gap -= took
                if n > took:
                    pool.add(n - took, (doc, start + took))
            if gap:
                rest += window
            else:
                windows.append((tier, window))
    return windows, rest


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list:
    """The last pieces of a task as unpadded sequences."""
    windows, left = [], [list(p) for p in pieces]
    total = sum(p[2] for p in left)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        window, gap = [], size
        while gap:
            doc, start, n = left[-1]
            took = min(n, gap)
            window.append((doc, start, took))
            gap -= took
            if n > took:
                left[-1] = [doc, start + took, n - took]
            else:
                left.pop()
        windows.append((size, window))
    return windows


def packer(path: str, tiers: tuple[int, ...], step_tokens: int, chunk_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        own = TaskContext.get().partitionId() << 40
        n_sequences = n_groups = 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        carried: list[tuple[int, int, int]] = []
        held = 0

        def emit(windows: list) -> pa.RecordBatch:
            nonlocal n_sequences, n_groups
            groups: dict[int, tuple[int, int]] = {}
            by_tier: dict[int, list[int]] = {}
            for i, (tier, _) in enumerate(windows):
                by_tier.setdefault(tier, []).append(i)
            group_of = np.zeros(len(windows), np.int64)
            for tier, at in by_tier.items():
                at.sort(key=lambda i: (-sum(p[2] ** 2 for p in windows[i][1]), i))
                many = -(-len(at) * tier // step_tokens)
                for k, i in enumerate(at):
                    turn, place = divmod(k, many)
                    group_of[i] = own + n_groups + (place if turn % 2 == 0 else many - 1 - place)
                n_groups += many
            rows = []
            for i, (tier, window) in enumerate(windows):
                offset = 0
                for doc, start, n in window:
                    crc = zlib.crc32(np.ascontiguousarray(ids[doc][start : start + n]).astype("<u4").tobytes())
                    rows.append((docs[doc], start, n, crc, len(ids[doc]), own + n_sequences + i, offset, tier, group_of[i]))
                    offset += n
            n_sequences += len(windows)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        end = np.array([END_ID], np.uint32)
        done = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs, carried, held, done
            windows, rest = pack([0] * done + [len(x) for x in ids[done:]], tiers, carried)
            out = emit(windows)
            keep = sorted({p[0] for p in rest})
            to = {d: i for i, d in enumerate(keep)}
            carried = [(to[d], s, n) for d, s, n in rest]
            ids, docs, done, held = [ids[d] for d in keep], [docs[d] for d in keep], len(keep), 0
            return out

        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(np.concatenate([enc.ids(text), end]) if text else end)
                docs.append(doc)
                held += len(ids[-1])
                if held >= chunk_tokens:
                    yield flush()
        yield flush()
        yield emit(powers_of_two(carried))

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16, chunk_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece of a document in a sequence.

    docs: doc_id, text; other columns are ignored. A null text counts as empty (its end id alone); null
    or repeated doc_ids are kept as they are, each row its own document. A special token of the vocabulary in a text is
    its id, as the vocabulary has it. An empty table gives no rows.
    Ties are broken by input order within a split, so the result follows from the input files.
    """
    if any(a <= b or a % b for a, b in zip(tiers, tiers[1:], strict=False)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be falling powers of two")
    ship(docs.sparkSession)
    f = packer(vocabulary or default_vocabulary(), tiers, step_tokens, chunk_tokens)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(f, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents of all documents; nulls, repeats and empty tables as there."""
    return pack_documents(read(spark, sf_dir, "documents"))
