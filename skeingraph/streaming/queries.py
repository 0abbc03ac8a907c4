"""Streaming forms: file changes into relations, usage counts, latency, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sync import differences
from ..operators.usage import BUCKETS


def hot_symbols(log: DataFrame) -> DataFrame:
    """symbol, hits so far of a streaming log; for complete or update mode."""
    return log.select(F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("hits"))


def latency_histogram(samples: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row of running bucket counts, sum and count."""
    return samples.groupBy().agg(*[F.sum((F.col(seconds) <= b).cast("long")).alias(f"le_{b}") for b in BUCKETS], F.count(seconds).alias("n"), F.sum(seconds).alias("total"))


def changed_files(snapshots: DataFrame) -> DataFrame:
    """path, change of a stream of scans (path, mtime; deleted where mtime is null): new, changed or deleted, against the last state.

    State is one time per path. A scan that shows the same or an earlier time tells nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else None
        news = []
        for f in frames:
            for m in f["mtime"]:
                if pd.isna(m):
                    if was is not None:
                        news.append("deleted")
                    was = None
                elif was is None or m > was:
                    news.append("new" if was is None else "changed")
                    was = float(m)
        if was is None:
            if state.exists:
                state.remove()
        else:
            state.update((was,))
        if news:
            yield pd.DataFrame({"path": [key[0]], "change": [news[-1]]})

    return snapshots.groupBy("path").applyInPandasWithState(step, "path string, change string", "mtime double", "update", GroupStateTimeout.NoTimeout)


def tree_changes(listings: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds"):
    """Starts a query over listings (path, mtime, size; a batch is one whole listing, or scans by number in `scan`, each whole) that hands each one's differences to apply.

    The listing that a batch is compared with is a table of the batch before, below the checkpoint; a batch that comes
    again is compared with the same one. apply gets path, change, was (and scan), and the batch's number.
    """
    spark = listings.sparkSession
    schema = "path string, mtime double, size long"

    def at(n: int) -> str:
        return f"{checkpoint}/listings/{n}"

    def step(df: DataFrame, n: int) -> None:
        before = spark.read.schema(schema).parquet(at(n - 1)) if n else spark.createDataFrame([], schema)
        now = df.select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"))
        if "scan" not in df.columns:
            now.where("path IS NOT NULL").write.mode("overwrite").parquet(at(n))
            apply(differences(before, spark.read.schema(schema).parquet(at(n))), n)
            return
        scans = [r.scan for r in df.select("scan").distinct().orderBy("scan").collect()]  # the few of this batch
        df.select("path", F.col("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"), F.col("scan").cast("long").alias("scan")).write.mode("overwrite").partitionBy("scan").parquet(f"{at(n)}.scans")
        kept = spark.read.schema(f"{schema}, scan long").parquet(f"{at(n)}.scans")
        out = None
        for s in scans:
            here = kept.where((F.col("scan") == s) & F.col("path").isNotNull()).drop("scan")
            part = differences(before, here).withColumn("scan", F.lit(s).cast("long"))
            out, before = part if out is None else out.unionAll(part), here
        before.write.mode("overwrite").parquet(at(n))
        if out is not None:
            apply(out, n)

    writer = listings.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.foreachBatch(step).start()


def sync(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds"):
    """Starts a query that hands each batch's changed paths, once each, to apply; every=None: what there is, then stop.

    apply gets the batch's id, and must do nothing for an id it has done: batches may come again after a failure.
    """
    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.foreachBatch(lambda df, n: apply(df.dropDuplicates(["path"]), n)).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total: tumbling or sliding windows by event time (ts TIMESTAMP); later events are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n: runs of a user's events with no gap that long."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def bound(seconds: float) -> str:
    """The column that counts samples up to so many seconds."""
    return f"le_{seconds}".replace(".", "_")


class Latencies(StatefulProcessor):
    """Of each key the newest samples, up to `most`; one more, and only the newest `keep` stay. Beside them a count for each bound, and the number of all."""

    def __init__(self, most: int, keep: int):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "ts double, seconds double")
        self.counts = handle.getValueState("counts", "n long, kept long, under array<long>")

    def left(self, kept: int, new: int) -> int:
        """How many samples there are after some more have come one by one."""
        if kept + new <= self.most:
            return kept + new
        return self.keep + (kept + new - self.most - 1) % (self.most + 1 - self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, kept, under = self.counts.get() if self.counts.exists() else (0, 0, [0] * len(BUCKETS))
        under, newest, new = np.array(under, np.int64), None, 0
        for f in rows:
            new += len(f)
            under += (f["seconds"].to_numpy()[:, None] <= np.array(BUCKETS)).sum(axis=0)
            # of a batch no more than `most` samples are ever held
            newest = pd.concat([*([] if newest is None else [newest]), f[["ts", "seconds"]]]).sort_values(["ts", "seconds"], kind="stable").tail(self.most)
        after = self.left(kept, new)
        if after == kept + new:
            self.samples.appendList(list(newest.itertuples(index=False, name=None)))
        else:
            old = list(self.samples.get()) if after > len(newest) else []
            self.samples.put([*old, *newest.itertuples(index=False, name=None)][-after:])
        self.counts.update((n + new, after, under.tolist()))
        held = sorted(s for _, s in self.samples.get())
        yield pd.DataFrame({"key": [key[0]], "n": [n + new], "kept": [after], "total": [float(sum(held))], "p50": [held[len(held) // 2]], **{bound(b): [int(c)] for b, c in zip(BUCKETS, under, strict=True)}})


def bounded_latencies(samples: DataFrame, most: int = 10_000, keep: int = 5_000) -> DataFrame:
    """A row for each key of each batch of a stream (key, ts, seconds): n (all samples so far), kept (how many are held), their total and middle one (p50), and how many of all are at most each bound.

    Samples come in order of time within a batch, and batches one after the other. The session must keep state in RocksDB (state_in_rocksdb).
    """
    schema = "key string, n long, kept long, total double, p50 double, " + ", ".join(f"{bound(b)} long" for b in BUCKETS)
    return samples.groupBy("key").transformWithStateInPandas(Latencies(most, keep), schema, "Update", "None")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, as lists and timers ask for; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)
