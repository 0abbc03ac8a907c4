"""License scans: fuzzy search for short notices.

A notice that stands in a text with at most k edits leaves one of k + 1 pieces of it untouched (pigeonhole), so
the pieces are searched exactly, as bytes, in the text with its words joined by single spaces. Around each place of a
piece, the runs of whole words that the notice could lie in go to the regex library, whose bounded-error
matching tells whether and with how many edits the notice is there. Runs of one notice that overlap are one place: the one of
the fewest edits. Every text is read once where it lies; nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices

#: Characters of a notice for each edit that it may have, and the most edits.
EDIT_CHARS, MOST_EDITS = 8, 3
#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that the scan knows besides.
MORE = {"bsd license": "bsd", "mozilla public license": "mpl", "creative commons attribution": "cc-by"}
PLACE = "struct<phrase: string, label: string, start_word: long, end_word: long, edits: int>"
SCHEMA = f"doc_id long, n_words long, places array<{PLACE}>"

_NOT_WORD = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)} - set(range(0x41, 0x5B))
_FLAT = bytes(0x20 if x in _NOT_WORD else x + 0x20 if 0x41 <= x <= 0x5A else x for x in range(256))
_GAP = re.compile(b"  +")


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int

    def pieces(self) -> list[tuple[int, bytes]]:
        """Offset and text of edits + 1 pieces of nearly one length."""
        cut = [len(self.phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.phrase[a:z].encode()) for a, z in zip(cut, cut[1:])]


def notices(phrases: dict[str, str]) -> list[Notice]:
    """Lower-case ASCII words with single spaces between them, each with an edit for every EDIT_CHARS characters."""
    return [Notice(p, label, min(MOST_EDITS, len(p) // EDIT_CHARS)) for p, label in phrases.items()]


@functools.lru_cache(maxsize=256)
def _pattern(phrase: str, edits: int):
    import regex

    return regex.compile(f"(?:{regex.escape(phrase)}){{e<={edits}}}", regex.BESTMATCH)


def flat(text: bytes) -> bytes:
    """A-Z lower-cased, words joined by single spaces."""
    return _GAP.sub(b" ", text.translate(_FLAT)).strip(b" ")


def runs(text: bytes, starts: np.ndarray, ends: np.ndarray, notice: Notice) -> dict[tuple[int, int], int]:
    """Edits of each run of words (first, last) that the notice matches; starts, ends: of the words of the flat text."""
    k, found, seen, size = notice.edits, {}, set(), len(notice.phrase)
    known: dict[bytes, int | None] = {}  # a run that stands in the text again is matched once

    def matched(run: bytes) -> int | None:
        if run not in known:
            m = _pattern(notice.phrase, k).fullmatch(run.decode("utf-8", "replace"))
            known[run] = sum(m.fuzzy_counts) if m else None
        return known[run]

    for offset, piece in notice.pieces():
        rest = size - offset - len(piece)
        at = text.find(piece)
        while at >= 0:
            # an edit adds or removes a character, and a character is four bytes at most
            first = np.searchsorted(starts, [at - offset - 4 * k, at - offset + k + 1])
            stop = at + len(piece) + rest
            last = np.searchsorted(ends, [stop - k, stop + 4 * k + 1])
            for a in range(first[0], first[1]):
                for z in range(max(a, last[0]), last[1]):
                    if (a, z) not in seen:
                        seen.add((a, z))
                        if (edits := matched(text[starts[a] : ends[z]])) is not None:
                            found[a, z] = edits
            at = text.find(piece, at + 1)
    return found


def places(text: bytes, wanted: list[Notice]) -> tuple[int, list[tuple[str, str, int, int, int]]]:
    """Number of words of a flat text, and (phrase, label, first word, last word, edits) of each place in order."""
    if not text:
        return 0, []
    asked = [n for n in wanted if any(p in text for _, p in n.pieces())]
    if not asked:
        return text.count(b" ") + 1, []
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])
    out = []
    for n in asked:
        taken: dict[int, bool] = {}
        for (a, z), e in sorted(runs(text, starts, ends, n).items(), key=lambda x: (x[1], x[0])):
            if e == 0 or not any(i in taken for i in range(a, z + 1)):
                taken.update(dict.fromkeys(range(a, z + 1), True))
                out.append((n.phrase, n.label, a, z, e))
    return len(starts), sorted(out, key=lambda x: (x[2], x[3], x[0]))


def find_notices(docs: DataFrame, wanted: list[Notice]) -> DataFrame:
    """doc_id, n_words, places (phrase, label, start_word, end_word, edits; words count from 0) of every row of docs.

    A place is a run of whole words that is the phrase but for the notice's number of edits (characters put in, left out
    or changed). Of overlapping runs of one phrase the one of the fewest edits counts, then the first, then the shorter; those without an
    edit all count. Different phrases may overlap. A null text is empty and has no words; null and repeated ids are
    rows like others; columns besides doc_id and text are ignored. No rows: none. A long text is held once with its spaces.
    """
    ship(docs.sparkSession)
    inner = pa.struct([("phrase", pa.string()), ("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, found = [], []
            for text in b.column("text").cast(pa.binary()):
                n, p = places(flat(text.as_py() or b""), wanted)
                n_words.append(n)
                found.append([dict(zip(inner.names, x, strict=True)) for x in p])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(inner))], names=["doc_id", "n_words", "places"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_notices of BASE and MORE in all documents, as their labels; score: 1 with an exact place of a base phrase, else the best place's share of unedited characters, else 0.

    Nulls, empty and long texts, repeats and an empty table as there.
    """
    found = find_notices(read(spark, sf_dir, "documents"), notices(BASE | MORE))
    base = F.filter("places", lambda p: p.edits.eqNullSafe(0) & p.phrase.isin(*BASE))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p.label))), ",")
    share = F.transform("places", lambda p: (F.length(p.phrase) - p.edits) / F.length(p.phrase))
    rows = found.withColumn("base", base)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p.start_word)).alias("first_word"), F.array_max(F.transform("base", lambda p: p.start_word)).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(share), F.lit(0.0))).alias("score"),
    )
