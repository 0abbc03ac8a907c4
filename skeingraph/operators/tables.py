"""Tables that cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage in the folder that spark.checkpoint.dir names; without one (on a laptop), in memory with disk."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df.persist()
    path = f"{at.rstrip('/')}/skein/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many short rows (names, files) a side of a join is broadcast, whatever the other side's size; beyond, it is shuffled.
FEW = 1_000_000


def few(rows: DataFrame, label: str, most: int = FEW) -> DataFrame:
    """Kept, and with the hint to broadcast if its rows are few enough: a join then does not shuffle its large side.

    Adaptive execution alone comes too late for that: it knows a side's size when both are shuffled.
    """
    kept = materialized(rows, label)
    return F.broadcast(kept) if kept.count() <= most else kept


def ordered_md5(rows: DataFrame, keys: list[str], order: list[str], text: str, between: str = ",") -> DataFrame:
    """keys and md5: of each key's texts in order with `between` between them, nulls left out; keys without any have no row.

    No task holds a key's texts: range partitions join runs of some thousands, and a key's runs go through one digest in order.
    """

    def runs(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """From where to where the rows of a batch have one key."""
        at = [tuple(r.values()) for r in b.select(keys).to_pylist()]
        cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
        return zip(cuts, cuts[1:])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cuts = list(runs(b))
            first = b.select([*keys, *order]).take(pa.array([i for i, _ in cuts]))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array([between.join(b.column(text).slice(i, j - i).to_pylist()) for i, j in cuts], pa.string())], names=[*keys, *order, text])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest = None, hashlib.md5()
        done = lambda: pa.RecordBatch.from_arrays([*row.columns, pa.array([digest.hexdigest()])], names=[*keys, "md5"])
        for b in batches:
            for i, j in runs(b):
                here = b.select(keys).slice(i, 1)
                if row is None or here.to_pylist() != row.to_pylist():
                    if row is not None:
                        yield done()
                    row, digest = pa.RecordBatch.from_pylist(here.to_pylist(), here.schema), hashlib.md5()  # a copy: a slice would hold the batch
                else:
                    digest.update(between.encode())
                for n, t in enumerate(b.column(text).slice(i, j - i)):
                    digest.update((between if n else "").encode() + t.as_py().encode())
        if row is not None:
            yield done()

    texts = rows.select(*keys, *order, text).where(F.col(text).isNotNull())
    by_key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    pieces = texts.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(joined, texts.schema)
    return pieces.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(digested, f"{by_key}, md5 string")


_OWN: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one that goes with the process, on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="skein-scratch"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        at = f"file://{_OWN[0]}"
    return f"{at.rstrip('/')}/skein/{label}-{uuid.uuid4().hex}"
