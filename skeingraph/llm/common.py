"""Shared pieces of the training-data operators: shipping code, shared tables, words and hashes.

Hashing here is a polynomial over 64-bit random letters, so the hash of any word, shingle or
window comes from one prefix sum by a subtraction and a multiplication, for whole batches at once.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: Up to so many keys a side of a join is broadcast (about 200 MB as Spark hashes them); beyond, it is shuffled.
BROADCAST_IDS = 1_000_000
#: A key that more rows than this hold may be hot; there are never more than HOT_KEYS hot ones.
HOT_ROWS, HOT_KEYS = 256, 20_000
_SHIPPED: set[str] = set()
_OWN: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets executors import this package wherever they run (Spark fetches the archive from the driver)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="skein")) / "skeingraph.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, on a single machine only (tests, a laptop)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="skein-shared"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes the rows once into the shared folder and reads them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this process has freed goes back to the system: allocators keep it, and Python workers outlive their tasks."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with give_back at its task's end: a worker that waits for its next task then holds nothing of the last one's peak."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def drop_table(df: DataFrame) -> None:
    """Removes a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A materialized table with the hint to broadcast it, if its rows are few enough."""
    return F.broadcast(df) if df.count() <= limit else df


def attach(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """left inner-joined with right, a materialized table of one row per key, without any task holding a hot key.

    rows: the column of right that tells how many rows of left have the key; total: their sum. Keys of over
    most = max(HOT_ROWS, total / HOT_KEYS) rows are at most HOT_KEYS. Such a key is dealt into parts of about `most` rows, and its row of
    right, however long, goes once to each; only the keys and their numbers of parts are broadcast. A hash of a row's
    plain columns tells its part, so it is the same if a task runs again. The result has left's columns and right's others.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    names = [*left.columns, *(c for c in right.columns if c not in keys and c not in left.columns)]
    right = right.select(*keys, *names[len(left.columns) :])
    hot = right.where(F.col(rows) > most)
    if hot.isEmpty():
        return left.join(right, keys).select(names)
    parts = F.ceil(F.col(rows) / most).alias("_parts")
    marked = left.join(F.broadcast(hot.select(*keys, parts)), keys, "left")
    cold = marked.where("_parts IS NULL").select(left.columns).join(right.where(F.col(rows) <= most), keys)
    plain = [f.name for f in left.schema if isinstance(f.dataType, T.AtomicType)]
    mine = marked.where("_parts IS NOT NULL").withColumn("_part", F.pmod(F.xxhash64(*plain), F.col("_parts")))
    theirs = hot.withColumn("_part", F.explode(F.sequence(F.lit(0), F.ceil(F.col(rows) / most) - 1)))
    return mine.select(*left.columns, "_part").join(theirs, [*keys, "_part"]).select(names).unionAll(cold.select(names))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two longs that rows share only if their ids and texts are equal: the id (without one, a hash of the text) and a hash of the text."""
    return F.coalesce(doc_id, F.xxhash64(text, F.lit("no id"))), F.xxhash64(text)


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(20240229)
LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
WBASE = U(0xC2B2AE3D27D4EB4F)
WBASE_INV = U(pow(int(WBASE), -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.uint64) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start])


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (one shorter by k-1); runs may cross documents, callers mask them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = values[:n].copy()
    c = U(1)
    with np.errstate(over="ignore"):
        for t in range(1, k):
            c = c * WBASE
            out += values[t : t + n] * c
    return mix(out)


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every m consecutive values, in three passes."""
    n = len(x) - m + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % m
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, m)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[m - 1 : m - 1 + n])


# ---------------------------------------------------------------- words

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True


@dataclass
class Text:
    """UTF-8 bytes of some documents, end to end; at: where each begins, and where the last ends."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def doc(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


@dataclass
class Words:
    start: np.ndarray  # byte positions
    end: np.ndarray
    at: np.ndarray  # index of each document's first word, and the number of words

    def room(self) -> np.ndarray:
        """For each word, how many words from it to its document's end."""
        return np.repeat(self.at[1:], np.diff(self.at)) - np.arange(len(self.start))


def text_of(column: pa.Array) -> Text:
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    bufs, n = column.buffers(), len(column)
    if n == 0:
        return Text(np.empty(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[at[0] : at[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return Text(data, at - at[0])


def joined(parts: list[bytes]) -> Text:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return Text(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about limit bytes of text (a longer text stands alone)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64)
        total = np.cumsum(sizes)
        i = 0
        while i < b.num_rows:
            before = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield b.slice(i, j - i)
            i = j


def words_of(text: Text, separator: np.ndarray = SEPARATOR) -> Words:
    n = len(text.data)
    if n == 0:
        z = np.empty(0, np.int64)
        return Words(z, z, np.zeros(len(text) + 1, np.int64))
    inside = ~separator[text.data]
    first = np.zeros(n + 1, dtype=bool)
    first[text.at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    ws = np.flatnonzero(start)
    return Words(ws, np.flatnonzero(end) + 1, np.searchsorted(ws, text.at))


#: Bytes (or characters) of a long text that are worked on at a time where all its parts add up.
PIECE = 1 << 20


def word_hashes(text: Text, words: Words) -> np.ndarray:
    """A 64-bit hash of each word, some megabytes of text at a time."""
    out, at = np.empty(len(words.start), np.uint64), 0
    while at < len(out):
        a = words.start[at]
        to = max(at + 1, int(np.searchsorted(words.start, a + PIECE)))
        part = LETTER[text.data[a : words.end[to - 1]]]
        out[at:to] = span_hash(prefix_sums(part, BASE), words.start[at:to] - a, words.end[at:to] - a, BASE_INV)
        at = to
    return out


LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
