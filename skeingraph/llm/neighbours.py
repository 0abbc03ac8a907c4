"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Every distinct vector is represented by its nearest pivots in
order, and posted under each of them with its place in that order: a pivot's list is sorted by place. A query visits the
lists of its own nearest pivots, of each only the places that are not too far down together with the query's, and adds up what
the places save of Spearman's footrule; weighted by the vector's length, as the order of pivots knows directions alone, that ranks
the vectors met. The best are reranked by the exact inner product in double precision. Equal vectors are one entry that
knows its smallest ids, and equal queries are one search, so copies cost nothing.

The index is dealt by hash into blocks, each a packed row in the shared folder with its vectors and lists, built once. The
query set meets them a bounded part at a time: a part is broadcast, and every block is read where it lies. How many candidates a
query has grows with the number of vectors n, as FACTOR n^POWER; a block gives its share s and 3 sqrt(s) more, which loses less than one in
a hundred of those that are best over all. Where a block's lists meet too few vectors, all of it is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, drop_table, materialize, read, ship

#: Pivots (a bounded sample); places that a vector is posted at; the place that counts as not shared; a list is read as far as its place and the query's make up REACH.
PIVOTS, ORDER, LAST, REACH = 1024, 64, 96, 64
#: Candidates that are reranked for a query among n vectors: FACTOR n^POWER, LEAST at least.
FACTOR, POWER, LEAST = 8.0, 0.6, 64
#: Bytes of the distinct vectors in a block, and of the distinct queries that are broadcast at a time (131,072 and 65,536 at 64 components).
BLOCK, PART = 1 << 26, 1 << 25
EVERY, NEAREST = 20, 20
HIT = "q long, vec_id long, score double, same boolean"
PACKED = "size int, vectors binary, ids binary, id_starts binary, listed binary, saved binary, list_starts binary"


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id, v (doubles): rows with an id and a vector that is not null, empty, zero, nor holds null, NaN or infinite components; length: only those of so many."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    return rows if length is None else rows.where(F.size("v") == length)


def usual_length(vectors: DataFrame) -> int:
    """The number of components that most usable vectors have, the larger one of several."""
    found = usable(vectors).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return found[0]["size"] if found else 0


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """e (a number), v, ids (the `most` smallest, in order) of every distinct vector of usable rows; materialized."""
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    each = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(each.select(F.monotonically_increasing_id().alias("e"), "v", "ids"), "vectors")


def pivots_of(vectors: DataFrame, many: int = PIVOTS) -> np.ndarray:
    """A bounded sample, by a hash of the vectors; unit vectors, each once. vectors: distinct."""
    rows = vectors.orderBy(F.xxhash64("v", F.lit("pivots")), "v").select("v").limit(2 * many).collect()
    if not rows:
        return np.zeros((0, 0))
    p = np.array([r[0] for r in rows])
    p = np.unique(np.round(p / np.linalg.norm(p, axis=1, keepdims=True), 9), axis=0)
    return p[np.random.default_rng(3).permutation(len(p))[:many]]


def orders(v: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Each vector's n nearest pivots, nearest first."""
    near = v @ pivots.T
    part = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(pivots) else np.broadcast_to(np.arange(len(pivots)), near.shape).copy()
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


class Block:
    """Vectors, and under each pivot and place the vectors that are posted there, end to end in that order."""

    def __init__(self, v: np.ndarray, pivots: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.v, self.pivots = v, pivots
        self.n = min(ORDER, len(pivots))
        self.length = np.sqrt((v * v).sum(axis=1))
        self.listed, self.saved, self.starts = lists or self._lists()

    def _lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.concatenate([orders(self.v[i : i + 4096], self.pivots, self.n) for i in range(0, len(self.v), 4096)]).astype(np.int32)
        key = (own * self.n + np.arange(self.n, dtype=np.int32)).ravel()
        order = np.argsort(key, kind="stable")
        key = key[order]
        return (order // self.n).astype(np.int32), (LAST - key % self.n).astype(np.uint8), np.searchsorted(key, np.arange(len(self.pivots) * self.n + 1))

    def candidates(self, wanted: np.ndarray, most: int, k: int) -> np.ndarray:
        """The `most` vectors of least footrule to a query's order of pivots, weighted by length, and all that tie with the last; all, if fewer than k are met.

        A pivot at places a and b adds |a - b|, which saves 2 (LAST - max(a, b)) against not being shared.
        """
        every = np.arange(len(self.v))
        if most >= len(self.v):
            return every
        met, saves = [], []
        for place, p in enumerate(wanted.tolist()):
            a, z = self.starts[p * self.n], self.starts[p * self.n + min(self.n, REACH - place)]
            met.append(self.listed[a:z])
            saves.append(np.minimum(self.saved[a:z], np.uint8(LAST - place)))
        saved = np.bincount(np.concatenate(met), np.concatenate(saves), len(self.v)) * self.length
        last = np.partition(saved, len(saved) - most)[len(saved) - most]
        found = np.flatnonzero(saved >= last) if last > 0 else np.flatnonzero(saved)
        return found if len(found) >= k else every

    def search(self, q: np.ndarray, most: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the candidates (and scores) that can be among its k best entries: ties with the last stay."""
        for i, wanted in enumerate(orders(q, self.pivots, self.n)):
            found = self.candidates(wanted[:REACH], most, k)
            score = (self.v[found] * q[i]).sum(axis=1)
            if len(found) > k:
                last = -np.partition(-score, k - 1)[k - 1]
                found, score = found[score >= last], score[score >= last]
            yield found, score


def budget(n: int, block: int) -> int:
    """Candidates that a block of `block` of n vectors gives for a query."""
    share = max(LEAST, FACTOR * n**POWER) * block / n
    return int(np.ceil(share + 3 * share**0.5))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def index(entries: DataFrame, pivots: np.ndarray, blocks: int) -> DataFrame:
    """entries (e, v, ids) as packed rows, one a block; materialized."""
    sent = entries.sparkSession.sparkContext.broadcast(pivots)

    def run(mine: pa.Table) -> pa.Table:
        own = Block(matrix(mine.column("v")), sent.value)
        ids = mine.column("ids").combine_chunks()
        start = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]).astype(np.int64)
        cols = [own.v, np.asarray(ids.flatten(), np.int64), start, own.listed, own.saved, own.starts.astype(np.int64)]
        return pa.table([pa.array([len(own.v)], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], names=[c.split()[0] for c in PACKED.split(", ")])

    dealt = entries.select(F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int").alias("block"), "v", "ids")
    return materialize(dealt.groupBy("block").applyInArrow(run, PACKED), "index")


def hits_of(packed: DataFrame, part: pa.Table, pivots: np.ndarray, n: int, k: int) -> DataFrame:
    """q, vec_id, score, same: of each query (q, v) of a part what each block finds, its k best and no more."""
    sc = packed.sparkSession.sparkContext
    sent = sc.broadcast((np.asarray(part.column("q"), np.int64), matrix(part.column("v")), pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, q, pivots = sent.value
        for b in batches:
            for row in range(b.num_rows):
                get = lambda name, kind: np.frombuffer(b.column(name)[row].as_py(), kind)  # noqa: B023, E731
                v = get("vectors", np.float64).reshape(b.column("size")[row].as_py(), -1)
                own = Block(v, pivots, (get("listed", np.int32), get("saved", np.uint8), get("list_starts", np.int64)))
                ids, start = get("ids", np.int64), get("id_starts", np.int64)
                out = []
                for i, (found, score) in enumerate(own.search(q, budget(n, len(v)), k)):
                    size = start[found + 1] - start[found]
                    which = np.concatenate([ids[start[g] : start[g + 1]] for g in found])
                    same, score = np.repeat((v[found] == q[i]).all(axis=1), size), np.repeat(score, size)
                    best = np.lexsort((which, -score))[:k]
                    out.append((np.full(len(best), number[i]), which[best], score[best], same[best]))
                    if len(out) == 4096 or i == len(q) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["q", "vec_id", "score", "same"])
                        out = []

    return packed.mapInArrow(run, HIT)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, block: int | None = None, part: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product with each query, its own row aside.

    vectors, queries: vec_id, embedding; other columns are ignored. Ties go to the smaller vec_id. Rows that `usable`
    leaves out, and those of another length than most vectors have, take no part on either side; a query finds every other row if those
    are at most k. A query's own row is one row of its vec_id and vector; another row of that vec_id may be found, and each of several
    query rows of one vec_id has ranks of its own. Either side empty: no rows. block, part: vectors and queries, in the place of BLOCK and PART.
    """
    spark = vectors.sparkSession
    ship(spark)
    length = usual_length(vectors)
    entries = distinct_vectors(usable(vectors, length), k + 1)
    asked = materialize(usable(queries, length), "queries")
    different = asked.groupBy("v").agg(F.count("*").alias("m"))
    different = materialize(different.select(F.monotonically_increasing_id().alias("q"), "v", "m"), "asked")
    n, many = entries.count(), different.count()
    block, part = block or max(1, BLOCK // (8 * max(1, length))), part or max(1, PART // (8 * max(1, length)))
    pivots = pivots_of(entries)
    packed = index(entries, pivots, max(1, -(-n // block)))
    drop_table(entries)
    parts = max(1, -(-many // part))
    found = []
    for i in range(parts):  # a part is a bounded number of queries
        some = different.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i).select("q", "v").toArrow()
        if some.num_rows:
            found.append(materialize(hits_of(packed, some, pivots, n, k + 1), "hits"))
    hits = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], HIT)
    drop_table(packed)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "same"))).alias("found"))
    best = materialize(different.select("q", "v", "m").join(best, "q").select("v", "m", "found"), "found")
    each = attach(asked.withColumnRenamed("vec_id", "query_id"), best, ["v"], "m", asked.count())
    own = F.expr("array_position(transform(found, x -> x.same AND x.vec_id = query_id), true)")
    others = each.withColumn("own", own).select("query_id", F.expr("slice(filter(found, (x, i) -> i + 1 <> own), 1, " + str(k) + ")").alias("found"))
    flat = others.select("query_id", F.posexplode("found").alias("at", "x"))
    return flat.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest of every row whose vec_id is divisible by 20; unusable vectors, ties, repeats and empty tables as there."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
