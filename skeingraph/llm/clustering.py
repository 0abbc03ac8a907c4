"""Centroid clustering with exponion search.

Vectors are integers, so all distances are exact. Each vector keeps an upper bound on the distance to its
centroid and a lower one on that to any other; while they do not meet, nothing is computed. Where they do, only the centroids
inside a ball around its own centroid can be nearest or second: of radius twice the distance, and that to the own centroid's next neighbour.
They are the first ones in the sorted list of distances from the own centroid to all. The radius is inclusive and the bounds
have a margin for rounding, so ties are always looked at, and go to the smaller number.

Vectors and bounds are kept as rows of packed blocks in the shared folder, written once a round; a round reads the last
one's blocks and then drops them. Sums and counts a cluster come out beside the blocks and are added up by Spark. Only centroids and
their sums go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, read, ship

COMPONENTS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Rounding of the bounds, relative and absolute.
MARGIN = 1e-9
#: Components up to here have distances that doubles, and beyond it only longs, hold exactly; a component may be LARGEST at most.
EXACT, LARGEST = 1 << 21, 1 << 27
BLOCKS = "vec_ids array<long>, width int, vectors binary, cluster binary, upper binary, lower binary, sums binary"


@dataclass
class Centroids:
    """values: a row of integers for each; order, apart: for each, all centroids from the nearest on, and how far they are."""

    values: np.ndarray
    moved: np.ndarray | None = None  # how far each went in the last update

    def __post_init__(self) -> None:
        gap = np.sqrt(((self.values[:, None, :] - self.values[None, :, :]).astype(np.float64) ** 2).sum(axis=2))
        np.fill_diagonal(gap, -1.0)  # itself comes first, before its copies
        self.order = np.argsort(gap, axis=1, kind="stable")
        np.fill_diagonal(gap, 0.0)
        self.apart = np.take_along_axis(gap, self.order, axis=1)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c, exact."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def two_nearest(x: np.ndarray, which: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the centroids in which (ascending): the nearest one's number, its distance, and the second distance (infinite, if there is none)."""
    d = squares(x, c.values[which])
    best = d.argmin(axis=1)  # the first of equals, so the smaller number
    low = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)) if len(which) > 1 else np.column_stack([np.sqrt(d[:, 0].astype(np.float64)), np.full(len(x), np.inf)])
    return which[best].astype(np.int32), low[:, 0], low[:, 1]


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's nearest centroid with new bounds, from those of the last round (own < 0: there was none)."""
    own, k = own.copy(), len(c.values)
    if len(own) and own[0] < 0:
        return two_nearest(x, np.arange(k), c)
    most = c.moved.max(initial=0.0)
    other = np.where(c.moved == most, np.partition(c.moved, -2)[-2] if k > 1 else 0.0, most) if (c.moved == most).sum() == 1 else np.full(k, most)
    upper = (upper + c.moved[own]) * (1 + MARGIN) + MARGIN
    lower = (lower - other[own]) - (np.where(np.isfinite(lower), lower, 0.0) + most + 1) * MARGIN
    next_to = c.apart[:, 1] if k > 1 else np.full(k, np.inf)
    safe = np.maximum(lower, next_to[own] / 2 * (1 - MARGIN))
    check = np.flatnonzero(upper >= safe)
    upper[check] = np.sqrt(((x[check].astype(np.int64) - c.values[own[check]]) ** 2).sum(axis=1).astype(np.float64))
    check = check[upper[check] * (1 + MARGIN) >= safe[check]]
    for a in np.unique(own[check]):
        mine = check[own[check] == a]
        radius = (2 * upper[mine] + next_to[a]) * (1 + MARGIN) + MARGIN
        many = np.searchsorted(c.apart[a], radius, side="right")
        level = np.ceil(np.log2(np.maximum(many, 2))).astype(int)
        for b in np.unique(level):  # up to twice the ball's centroids, for as many vectors at a time as have that number
            some = mine[level == b]
            own[some], upper[some], lower[some] = two_nearest(x[some], np.sort(c.order[a][: 1 << b]), c)
    return own, upper, lower


def block_row(ids: list, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> list[pa.Array]:
    """A block as a row: vectors in as few bytes as hold them, and each cluster's count and sums."""
    top = int(np.abs(x).max(initial=0))
    width = 2 if top < 1 << 15 else 4
    sums = np.zeros((k, x.shape[1] + 1), np.int64)
    if len(own) and own[0] >= 0:
        by = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[by], prepend=-1))
        sums[own[by][first]] = np.add.reduceat(np.column_stack([np.ones(len(x), np.int64), x])[by], first, axis=0)
    cols = [[ids], [width], [x.astype(f"i{width}").tobytes()], [own.astype(np.int32).tobytes()], [upper.tobytes()], [lower.tobytes()], [sums.tobytes()]]
    return [pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 5), strict=True)]


def opened(b: pa.RecordBatch, row: int, d: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name, kind: np.frombuffer(b.column(name)[row].as_py(), kind)
    return b.column("vec_ids")[row].values, get("vectors", f"i{b.column('width')[row].as_py()}").astype(np.int64).reshape(-1, d), get("cluster", np.int32), get("upper", np.float64), get("lower", np.float64)


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def blocks_of(vectors: DataFrame, d: int, k: int) -> DataFrame:
    """vec_id, v (array of d longs) as blocks without a cluster yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("v").flatten(), np.int64).reshape(-1, d)
                none = np.full(len(x), -1, np.int32)
                yield pa.RecordBatch.from_arrays(block_row(b.column("vec_id").to_pylist(), x, none, np.zeros(len(x)), np.zeros(len(x)), k), names=_NAMES)

    return vectors.select("vec_id", "v").mapInArrow(run, BLOCKS)


def assigned(blocks: DataFrame, c: Centroids) -> DataFrame:
    """The blocks with every vector in its nearest cluster."""
    sent = blocks.sparkSession.sparkContext.broadcast(c)  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for row in range(b.num_rows):
                ids, x, *bounds = opened(b, row, c.values.shape[1])
                yield pa.RecordBatch.from_arrays(block_row(ids.to_pylist(), x, *assign(x, *bounds, c), len(c.values)), names=_NAMES)

    return blocks.mapInArrow(run, BLOCKS)


def updated(blocks: DataFrame, c: Centroids) -> Centroids:
    """Means of the clusters, rounded down; an empty cluster's centroid stays."""
    k, d = c.values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)
        for b in batches:
            for s in b.column("sums"):
                total += np.frombuffer(s.as_py(), np.int64).reshape(k, d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *(pa.array(total[:, i]) for i in range(d + 1))], names=["cluster", *(f"s{i}" for i in range(d + 1))])

    schema = ", ".join(["cluster int", *(f"s{i} long" for i in range(d + 1))])
    exact = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(d + 1)]
    new = c.values.copy()
    for r in blocks.select("sums").mapInArrow(run, schema).groupBy("cluster").agg(*exact).collect():  # k rows
        n, *sums = (int(x) for x in r[1:])
        if n:
            new[r.cluster] = [s // n for s in sums]
    return Centroids(new, np.sqrt(((new - c.values).astype(np.float64) ** 2).sum(axis=1)))


def usable(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """vec_id, v: vectors of so many components, all finite numbers, each as the integer below its scaled value."""
    e = F.col("embedding")
    good = (F.size(e) == components) & F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    top = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double") * scale)))
    held = F.when(top <= LARGEST, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}: squared distances may not fit into longs")))
    return vectors.where(good).select(F.col("vec_id").cast("long"), held.cast("array<long>").alias("v"))


def digest(values: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, values.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every usable row of vectors (vec_id, embedding).

    The centroids start as the k rows of the least sha256 of `<seed>:<vec_id>` (a null id is written as nothing; rows of one id by
    their values). Each round assigns all vectors to the nearest centroid, ties to the smaller number, and then moves the centroids to their
    clusters' means, rounded down; empty ones stay. With fewer than k rows there are as many centroids. Rows with a null vector,
    another number of components, or a null, NaN or infinite one are left out; repeated rows and null ids are rows like
    others; other columns are ignored. No usable row: no rows. A component beyond 2^27 in its scaled value raises an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = usable(vectors, components, scale)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r.v for r in kept.withColumn("h", h).orderBy("h", "v").limit(k).collect()]
    if not start:
        return kept.selectExpr("vec_id", "CAST(0 AS INT) AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    c = Centroids(np.array(start, np.int64))
    blocks = materialize(blocks_of(kept, components, len(start)), "blocks")
    for r in range(rounds + 1):
        last, blocks = blocks, materialize(assigned(blocks, c), "blocks")
        drop_table(last)
        if r < rounds:
            c = updated(blocks, c)
            if not c.moved.any():  # nothing will change any more
                break
    sent = spark.sparkContext.broadcast(c.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, x, own, *_ = opened(b, row, components)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own), pa.array(((x - sent.value[own]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    rows = materialize(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    drop_table(blocks)
    whole = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # k rows
    total = sum(int(r.n) for r in whole)
    each = spark.createDataFrame([(r.cluster, int(r.n), total, digest(c.values[r.cluster])) for r in whole], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster of all embeddings; unusable vectors, ties, repeats and an empty table as there."""
    return cluster(read(spark, sf_dir, "embeddings"))
