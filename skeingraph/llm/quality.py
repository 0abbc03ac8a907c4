"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model (Chen and Goodman, 1999) is of order four over UTF-16 units, one for each language, from all
trusted texts. Its counts, continuation counts, three discounts per order and context weights are
aggregations and equi-joins over the counted 4-grams, none of which leaves the cluster.

Scoring is a sharded count join. Documents are cut into blocks; a block's distinct 4-grams, each with
the documents that hold it and how often, are split by the hash of the third character. All that a
4-gram's interpolation and backing off need (every order's entry ends in the same two characters, every
context in the third) lies in the same shard of the model, so a block's share meets the model's
shard in one co-group, and yields a partial sum of log probabilities for each document of the block.
There are as many shards as keep one at about SHARD_ROWS entries, and blocks are dealt into groups, each of which gets
the shard; the more shards, the more documents a group holds, so neither a cell nor the model's copies per document
grow with the corpus. A document's partial sums, one of each shard, make its perplexity. They are joined by the row's
key (id, hash of the text, and a count among equal rows), which a task that runs again gives again, in whatever order its rows come.

A document is kept if its perplexity is at most its language's threshold: a high quantile of the
perplexities of trusted documents that the model has not seen (a fifth of them, by a hash of their ids),
taken from a fine histogram over all of those; where they are too few to reach it, by their mean and spread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U, materialize, read, row_keys, ship, small

#: Fewest and most shards (powers of two), entries of 4-grams that one should hold, documents in a block, and, with the fewest shards, in a group.
LEAST_SHARDS, MOST_SHARDS, SHARD_ROWS, BLOCK_DOCS, BLOCK_CHARS, GROUP_DOCS = 8, 4096, 60_000, 2048, 4_000_000, 49_152
#: Quantile of held-out trusted documents' log perplexities that is the threshold, and the histogram's step.
QUANTILE, STEP = 0.995, 0.002
#: Share of trusted documents kept from training for the thresholds, in fifths.
HELD_FIFTHS = 1
UNKNOWN = "und"
MASKS = {4: -1, 3: (1 << 48) - 1, 2: (1 << 32) - 1, 1: (1 << 16) - 1}
OUT = "k1 long, k2 long, slot long, doc_id long, lang string, log_p double, n long"


def codes(text: str) -> np.ndarray:
    """The 4-grams of a text behind three start marks, each in one number."""
    u = np.frombuffer(b"\1\0\1\0\1\0" + text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    return u[:-3] << U(48) | u[1:-2] << U(32) | u[2:-1] << U(16) | u[3:]


def shards_for(entries: int) -> int:
    """How many shards a model of so many 4-grams is cut into."""
    return min(MOST_SHARDS, max(LEAST_SHARDS, 1 << max(0, -(-entries // SHARD_ROWS) - 1).bit_length()))


def shard_of(unit: np.ndarray, shards: int) -> np.ndarray:
    return ((unit * U(40503)) & U(65535)) // U(65536 // shards)


def _shard(unit: Column, shards: int) -> Column:
    return F.floor((unit * F.lit(40503)).bitwiseAND(F.lit(65535)) / F.lit(65536 // shards)).cast("int")


def count_grams(texts: DataFrame) -> DataFrame:
    """lang, g, c over all texts; texts: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list[np.ndarray]) -> None:
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            if lang in sums:
                both, n = np.concatenate([sums[lang][0], g]), np.concatenate([sums[lang][1], c])
                order = np.argsort(both, kind="stable")
                both, n = both[order], n[order]
                start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                g, c = both[start], np.add.reduceat(n, start)
            sums[lang] = g, c

        def out(lang: str) -> pa.RecordBatch:
            g, c = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "g", "c"])

        for b in batches:
            parts: dict[str, list[np.ndarray]] = {}
            held = 0
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                x = codes(text.as_py())
                parts.setdefault(lang, []).append(x)
                held += len(x)
                if held >= 1 << 20:
                    for k, p in parts.items():
                        add(k, p)
                    parts, held = {}, 0
            for k, p in parts.items():
                add(k, p)
            for k in [k for k, (g, _) in sums.items() if len(g) > 1 << 20]:
                yield out(k)
        for k in list(sums):
            yield out(k)

    return texts.where("text <> ''").select("lang", "text").mapInArrow(run, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _ctx(g: str = "g") -> Column:
    return F.shiftrightunsigned(g, 16)


def _discounted(order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For one order's counts: lang, g, c less its discount over the context's total; and lang, ctx, weight."""
    n = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = "CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5D END"
    steps = [f"CASE WHEN n{i} > 0 AND n{i + 1} > 0 THEN greatest(0.05D, {i} - {i + 1} * ({y}) * n{i + 1} / n{i}) ELSE {i} * 0.5D END AS d{i}" for i in (1, 2, 3)]
    discounts = order.groupBy("lang").agg(*n).selectExpr("lang", *steps)
    languages = materialize(discounts, "discounts")
    d = order.join(small(languages), "lang").withColumn("ctx", _ctx()).withColumn("d", F.expr("CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END"))
    contexts = d.groupBy("lang", "ctx").agg(F.sum("c").alias("t"), F.sum("d").alias("saved")).select("lang", "ctx", "t", (F.col("saved") / F.col("t")).alias("weight"))
    return d.join(contexts, ["lang", "ctx"]).select("lang", "g", "ctx", ((F.col("c") - F.col("d")) / F.col("t")).alias("own"), "weight"), contexts.select("lang", "ctx", "weight")


def model(counts: DataFrame, shards: int = LEAST_SHARDS) -> DataFrame:
    """lang, shard, kind, code, value: kinds 4 to 1 are probabilities, 14 to 12 context weights, 0 the unknown's probability.

    counts: materialized count_grams.
    """
    orders = {4: counts}
    for k in (3, 2, 1):
        orders[k] = materialize(orders[k + 1].select("lang", F.col("g").bitwiseAND(F.lit(MASKS[k])).alias("g")).groupBy("lang", "g").agg(F.count("*").alias("c")), f"order{k}")
    units = orders[1].groupBy("lang").agg((F.lit(1.0) / (F.count("*") + 1)).alias("even"))
    own, weights = _discounted(orders[1])
    lowest = own.join(units, "lang").select("lang", "g", (F.col("own") + F.col("weight") * F.col("even")).alias("p"))
    unknown = weights.join(units, "lang").select("lang", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("code"), (F.col("weight") * F.col("even")).alias("value"))
    lower = materialize(lowest, "p1")
    everywhere = unknown.unionAll(lower.selectExpr("lang", "1 AS kind", "g AS code", "p AS value"))
    parts = everywhere.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("lang", "shard", "kind", "code", "value")
    for k in (2, 3, 4):
        own, weights = _discounted(orders[k])
        below = lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("q"))
        now = own.withColumn("suffix", F.col("g").bitwiseAND(F.lit(MASKS[k - 1]))).join(below, ["lang", "suffix"]).select("lang", "g", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        lower = materialize(now, f"p{k}")
        third = _ctx().bitwiseAND(F.lit(65535))
        parts = parts.unionAll(lower.select("lang", _shard(third, shards).alias("shard"), F.lit(k).alias("kind"), F.col("g").alias("code"), F.col("p").alias("value")))
        parts = parts.unionAll(weights.select("lang", _shard(F.col("ctx").bitwiseAND(F.lit(65535)), shards).alias("shard"), F.lit(10 + k).alias("kind"), F.col("ctx").alias("code"), F.col("weight").alias("value")))
    return parts


class Shard:
    def __init__(self, kind: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.tables = {}
        for k in np.unique(kind):
            mine = np.flatnonzero(kind == k)
            order = mine[np.argsort(code[mine])]
            self.tables[int(k)] = code[order], value[order]

    def get(self, kind: int, code: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
        if kind not in self.tables:
            return np.broadcast_to(missing, code.shape)
        keys, values = self.tables[kind]
        at = np.searchsorted(keys, code)
        at[at == len(keys)] = 0
        return np.where(keys[at] == code, values[at], missing)

    def log_p(self, g: np.ndarray) -> np.ndarray:
        p = self.get(1, g & U(0xFFFF), self.tables[0][1][0])
        for k in (2, 3, 4):
            part = g & U(MASKS[k] % 2**64)
            p = self.get(k, part, self.get(10 + k, part >> U(16), 1.0) * p)
        return np.log(p)


def blocks(docs: DataFrame, groups: int, shards: int) -> DataFrame:
    """lang, shard, cell, blob: each block's distinct 4-grams of one shard with the documents that hold them; docs: k1, k2, doc_id, lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_blocks = TaskContext.get().partitionId() << 40, 0
        seen: Counter = Counter()
        pack = zstandard.ZstdCompressor(level=1).compress
        open_: dict[str, list] = {}  # language: row keys, doc ids, codes, counts, characters

        def close(lang: str) -> pa.RecordBatch:
            nonlocal n_blocks
            rows, ids, gs, cs, _ = open_.pop(lang)
            g = np.concatenate(gs)
            order = np.argsort(g, kind="stable")
            doc = np.repeat(np.arange(len(gs), dtype=np.uint16), [len(x) for x in gs])[order]
            g, c = g[order], np.concatenate(cs)[order]
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
            size = np.diff(np.concatenate([start, [len(g)]])).astype(np.uint16)
            shard = shard_of((g[start] >> U(16)) & U(0xFFFF), shards).astype(np.int64)
            pair_shard = np.repeat(shard, size)
            head = np.array(rows, np.int64).tobytes() + np.array([x is not None for x in ids], np.uint8).tobytes() + np.array([x or 0 for x in ids], np.int64).tobytes()
            blobs = []
            by_u, by_p = np.argsort(shard, kind="stable"), np.argsort(pair_shard, kind="stable")
            at_u, at_p = (np.searchsorted(x, np.arange(shards + 1)) for x in (shard[by_u], pair_shard[by_p]))
            for s in range(shards):
                u, p = by_u[at_u[s] : at_u[s + 1]], by_p[at_p[s] : at_p[s + 1]]
                sizes = np.array([len(rows), len(u), len(p)], np.int64).tobytes()
                blobs.append(pack(sizes + head + g[start][u].tobytes() + size[u].tobytes() + doc[p].tobytes() + c[p].tobytes()))
            cell = (TaskContext.get().partitionId() + n_blocks) % groups
            n_blocks += 1
            return pa.RecordBatch.from_arrays([pa.array([lang] * shards), pa.array(range(shards), pa.int32()), pa.array([cell] * shards, pa.int32()), pa.array(blobs, pa.binary())], names=["lang", "shard", "cell", "blob"])

        for b in batches:
            for k1, k2, lang, doc_id, text in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "lang", "doc_id")), b.column("text"), strict=True):
                g, c = np.unique(codes(text.as_py() or ""), return_counts=True)
                while c.max(initial=0) > 65535:  # split what 16 bits can't hold
                    over = c > 65535
                    g, c = np.concatenate([g, g[over]]), np.concatenate([np.minimum(c, 65535), c[over] - 65535])
                own = open_.setdefault(lang, [[], [], [], [], 0])
                for k, x in enumerate(((k1, k2, base + seen[k1, k2]), doc_id, g, c.astype(np.uint16))):
                    own[k].append(x)
                own[4] += len(g)
                seen[k1, k2] += 1
                if len(own[0]) >= BLOCK_DOCS or own[4] >= BLOCK_CHARS // 4:
                    yield close(lang)
        for lang in list(open_):
            yield close(lang)

    return docs.mapInArrow(run, "lang string, shard int, cell int, blob binary")


def partial_sums(blob: bytes, shard: Shard | None) -> tuple[np.ndarray, ...]:
    """Row keys, whether they have an id, ids, log probabilities and numbers of 4-grams of a block's documents in one shard."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, u, p = np.frombuffer(raw, np.int64, 3)
    at, parts = 24, []
    for kind, many in ((np.int64, 3 * n), (np.uint8, n), (np.int64, n), (np.uint64, u), (np.uint16, u), (np.uint16, p), (np.uint16, p)):
        parts.append(np.frombuffer(raw, kind, many, at))
        at += parts[-1].nbytes
    rows, has, ids, g, size, doc, c = parts
    weight = c.astype(np.float64)
    log_p = np.repeat(shard.log_p(g), size) if shard is not None and len(g) else np.full(len(doc), np.nan)
    return rows.reshape(-1, 3), has, ids, np.bincount(doc, weight * log_p, n).astype(np.float64), np.bincount(doc, weight, n).astype(np.int64)


def score(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, lang, log_p, n for every row of docs (doc_id, lang, text)."""
    many = shards_for(counts.count())
    groups = max(1, -(-docs.count() // (GROUP_DOCS * many // LEAST_SHARDS)))
    shards = model(counts, many).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            shard = Shard(right.column("kind").to_numpy(), right.column("code").to_numpy().view(np.uint64), right.column("value").to_numpy()) if right.num_rows else None
            lang = left.column("lang")[0].as_py()
            for blob in left.column("blob"):
                rows, has, ids, log_p, n = partial_sums(blob.as_py(), shard)
                out.append(pa.table([*(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)), pa.array(ids, mask=has == 0), pa.array([lang] * len(rows), pa.string()), pa.array(log_p), pa.array(n)], names=[x.split()[0] for x in OUT.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({x.split()[0]: pa.array([], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in OUT.split(", ")})

    key = ["lang", "shard", "cell"]
    k1, k2 = row_keys(F.col("doc_id"), F.col("text"))
    sums = blocks(docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "lang", "text"), groups, many).groupBy(*key).cogroup(shards.groupBy(*key)).applyInArrow(run, OUT)
    return sums.groupBy("k1", "k2", "slot", "doc_id", "lang").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))


def thresholds(trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, threshold, low, high (log perplexities): the quantile and the two thirds' bounds; trusted: lang, x. An extra null lang holds all.

    Fewer than 1 / (1 - quantile) documents do not reach as far as the quantile: then it is that of a normal distribution of
    their mean and spread, and their highest at least.
    """
    bins = trusted.where("x IS NOT NULL").withColumn("bin", F.ceil(F.col("x") / STEP)).groupBy(F.col("lang"), "bin").agg(F.count("*").alias("m"))
    bins = bins.unionAll(bins.groupBy("bin").agg(F.sum("m").alias("m")).select(F.lit(None).cast("string").alias("lang"), "bin", "m"))
    order = Window.partitionBy("lang").orderBy("bin")
    share = bins.withColumn("share", F.sum("m").over(order) / F.sum("m").over(Window.partitionBy("lang")))
    at = lambda q, name: F.min(F.when(F.col("share") >= q - 1e-12, F.col("bin") * STEP)).alias(name)
    mean = F.sum(F.col("m") * F.col("bin")) / F.sum("m")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("m") * F.col("bin") ** 2) / F.sum("m") - mean**2))
    normal = (mean + NormalDist().inv_cdf(quantile) * spread) * STEP
    found = share.groupBy("lang").agg(at(quantile, "reached"), F.sum("m").alias("n"), normal.alias("normal"), at(1 / 3, "low"), at(2 / 3, "high"))
    threshold = F.when(F.col("n") * (1 - quantile) < 1 - 1e-9, F.greatest("reached", "normal")).otherwise(F.col("reached"))
    return found.select("lang", threshold.alias("threshold"), "low", "high")


def classify(docs: DataFrame, trusted_ids: DataFrame, few: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, keep, bucket for every row.

    docs: doc_id, text, lang; trusted_ids: doc_id. Null languages are `und`. A null or empty text has no perplexity, is
    not kept and is in no bucket. A language without trusted text is measured by the threshold over all
    trusted documents and gets no perplexity, so nothing of it is dropped for it. Repeated rows each get their
    row; a null doc_id is trusted by nothing. Without any trusted text every text is kept. No rows: no rows.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = materialize(trusted_ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), "trusted")
    held = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(5)) < HELD_FIFTHS
    grams = count_grams(d.join(small(ids.where(~held), few), "doc_id", "left_semi"))
    counts = materialize(grams, "grams")
    scored = materialize(score(d, counts).withColumn("x", F.when((F.col("n") > 0) & ~F.isnan("log_p"), -F.col("log_p") / F.col("n"))), "scores")
    limits = materialize(thresholds(scored.join(small(ids.where(held), few), "doc_id", "left_semi").select("lang", "x")), "thresholds")
    per_lang = limits.where("lang IS NOT NULL")
    all_ = limits.where("lang IS NULL").first() or (None, None, None, None)
    out = scored.join(small(per_lang), "lang", "left")
    t = F.coalesce("threshold", F.lit(all_[1]).cast("double"))
    keep = (F.col("n") > 0) & (F.col("x").isNull() | t.isNull() | (F.col("x") <= t))
    bucket = F.expr("CASE WHEN x IS NULL THEN NULL WHEN x <= low THEN 'head' WHEN x <= high THEN 'middle' ELSE 'tail' END")
    return out.select("doc_id", "lang", F.col("n").alias("n_chars"), F.round(F.exp("x"), 6).alias("perplexity"), F.round(F.exp(t), 6).alias("threshold"), keep.alias("keep"), bucket.alias("bucket"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classify all documents by those labelled good; nulls, empty texts, repeats and empty tables as there."""
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return classify(read(spark, sf_dir, "documents"), trusted)
