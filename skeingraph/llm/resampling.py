"""Target-distribution importance resampling: hashed word buckets, counted outside memory, and a Gumbel draw.

Each text is cut once. Its words' buckets, two bytes each, are written as packed streams: a row holds the streams
of some documents end to end and where each document's begins. The streams are then sorted and run-length encoded for the counts
of all documents; the target's texts go the same way. With the gains of the buckets, the packed streams are read again: gains
are gathered by bucket and added up for each document with np.add.reduceat. Rows of a document's id and score are put in
order by range partitions and numbered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, read, ship, slices
from .notices import flat

BUCKETS, LONGEST_RUN, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
STREAMS = "doc_ids array<long>, n_words binary, starts binary, stream binary"
WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def stream_of(text: bytes, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a flat text, and the buckets of all its runs of up to `longest` words."""
    words = text.split(b" ") if text else []
    sizes = [max(0, len(words) - n + 1) for n in range(1, longest + 1)]
    out = np.empty(sum(sizes), np.uint32)
    at = 0
    for n, size in enumerate(sizes, 1):
        features = words if n == 1 else (b" ".join(words[i : i + n]) for i in range(size))
        out[at : at + size] = np.fromiter(map(crc32, features), np.uint32, size)
        at += size
    return len(words), (out % np.uint32(buckets)).astype(np.uint16)


def packed(texts: DataFrame, key: str | None, longest: int, buckets: int) -> DataFrame:
    """The streams of a table's texts, about a megabyte of text in a row."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            each = [stream_of(flat(t.as_py() or b""), longest, buckets) for t in b.column("text").cast(pa.binary())]
            starts = np.cumsum([0, *(len(s) for _, s in each[:-1])], dtype=np.int64)
            cols = [[b.column("doc_id").to_pylist()], *([x.tobytes()] for x in (np.array([n for n, _ in each], np.int64), starts, np.concatenate([s for _, s in each])))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.int64()), *[pa.binary()] * 3), strict=True)], names=["doc_ids", "n_words", "starts", "stream"])

    doc_id = F.lit(None).cast("long") if key is None else F.col(key).cast("long")
    return texts.select(doc_id.alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, STREAMS)


def counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in all streams: each is sorted and run-length encoded, a task adds up its runs, and Spark the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in b.column("stream"):
                ordered = np.sort(np.frombuffer(s.as_py(), np.uint16), kind="stable")
                first = np.flatnonzero(np.diff(ordered, prepend=-1 if not len(ordered) else int(ordered[0]) - 1))
                total[ordered[first]] += np.diff(first, append=len(ordered))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    rows = streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket at most
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandfold log ratio of each bucket's share in the target to that in the raw texts, both with one more in every bucket; floors."""
    n, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""
    sent = streams.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                starts, n_words = (np.frombuffer(b.column(c)[row].as_py(), np.int64) for c in ("starts", "n_words"))
                each = sent.value[np.frombuffer(b.column("stream")[row].as_py(), np.uint16)]
                size = np.diff(starts, append=len(each))
                total = np.zeros(len(starts), np.int64)
                some = np.flatnonzero(size)  # reduceat takes an empty run for the one after it
                if len(some):
                    total[some] = np.add.reduceat(each, starts[some])
                yield pa.RecordBatch.from_arrays([pa.array(b.column("doc_ids")[row].values, pa.int64()), pa.array(n_words), pa.array(size), pa.array(total)], names=[c.split()[0] for c in WEIGHTS.split(", ")])

    return streams.mapInArrow(run, WEIGHTS)


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel variable of an id, the same in every run; floor."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank: from 1 among the drawn, else null.

    docs: doc_id, text; target: text; other columns are ignored. Of the rows of at least least_words words the percent of the highest
    scores are drawn (rounded down), ties to the smaller doc_id. Words are runs of a-z, 0-9 and all beyond ASCII, after A-Z are lower-cased.
    Null and empty texts have no words and weight 0. Repeated rows count each for itself and have ranks of their own; a null id
    draws as an empty one does and stands last among ties. An empty target: all target counts are 0; no documents: no rows.
    buckets: 65536 at most. The text of a row is held as a whole, with two bytes a feature.
    """
    streams = materialize(packed(docs, "doc_id", longest, buckets), "streams")
    gain = gains(counts(streams, buckets), counts(packed(target, None, longest, buckets), buckets))
    scored = weights(streams, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("may", F.col("n_words") >= least_words)
    scored = scored.withColumn("row", F.monotonically_increasing_id())  # so that rows of one id and score can be parted
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = materialize(scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "scored")  # bounds drawn once
    drop_table(streams)
    sizes = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.count_if("may").alias("m")).collect())  # a row a partition
    before = np.cumsum([0, *(n for _, n, _ in sizes)]).tolist()
    drawn = percent * sum(m for _, _, m in sizes) // 100
    # only partitions that begin before the cut are numbered at all
    at = [(p, b) for (p, _, _), b in zip(sizes, before) if b < drawn]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(at, "part int, before long"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    names = ("doc_id", "n_features", "weight", "score")
    first = ranged.join(offsets, "part").withColumn("number", number)
    first = first.select(*names, F.when(F.col("number") <= drawn, F.col("number")).alias("rank"))
    return first.unionAll(ranged.join(offsets, "part", "left_anti").select(*names, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample of all documents towards all benchmark texts; nulls, empty texts, ties, repeats and empty tables as there."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
