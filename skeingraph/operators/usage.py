"""What was asked for, and how fast: usage and latency over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import numbered
from .tables import materialized

#: Upper bounds of the latency buckets, in seconds.
BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def hot_symbols(log: DataFrame, limit: int = 20, first: int | None = None) -> DataFrame:
    """symbol, hits: the most named ones; ties in order of first mention. first: look at so many of the oldest entries only."""
    rows = log if first is None else log.orderBy("ts").limit(first)
    named = rows.select("ts", F.posexplode("symbols").alias("pos", "symbol"))
    counts = named.groupBy("symbol").agg(F.count("*").alias("hits"), F.min(F.struct("ts", "pos")).alias("_first"))
    return counts.orderBy(F.desc("hits"), "_first", "symbol").limit(limit).drop("_first")


def latency_histogram(samples: DataFrame, seconds: str = "seconds") -> DataFrame:
    """le, n: how many samples are at most each bound (each bound counted once), +Inf last; and sum and count rows."""
    counts = samples.agg(*[F.count_if(F.col(seconds) <= b).alias(str(b)) for b in BUCKETS], F.count(seconds).alias("+Inf"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"`{b}`").alias("n")) for b in [*BUCKETS, "+Inf"]])).alias("x")).select("x.le", "x.n")


def percentile_ranks(samples: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the sample at index int(n * share) of the sorted ones (share 0.5: n // 2), not interpolated."""
    rows = materialized(numbered(samples.select(*keys, value), [*keys, value], "_i"), "ranks")  # sorted over all tasks: a key's samples follow each other
    per = rows.groupBy(*keys).agg(F.min("_i").alias("_first"), F.count("*").alias("n"))
    picks = F.array(*[F.struct(F.lit(name).alias("name"), (F.col("_first") + F.floor(F.col("n") * s)).alias("_i")) for name, s in shares.items()])
    wanted = per.select(F.col("n"), F.explode(picks).alias("p")).select("n", "p.name", "p._i")
    found = rows.join(wanted, "_i").groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in shares])
    return found


def hit_rate(log: DataFrame, hit: str = "hit") -> DataFrame:
    """hits / lookups, 0 without any."""
    return log.agg(F.coalesce(F.try_divide(F.count_if(hit), F.count("*")), F.lit(0.0)).alias("hit_rate"))


def request_counts(log: DataFrame, tool: str = "tool") -> DataFrame:
    """tool, requests, per_minute: how often each was asked for, and over the time from the first to the last entry (at least a minute)."""
    span = log.agg(F.greatest(F.lit(1.0), (F.max("ts") - F.min("ts")) / 60).alias("_minutes"))
    rows = log.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("requests")).crossJoin(span)  # one row
    return rows.select("tool", "requests", F.round(F.col("requests") / F.col("_minutes"), 2).alias("per_minute"))


def index_rate(files: DataFrame) -> DataFrame:
    """files, per_minute: files indexed over the time from the first to the last of them (at least a minute)."""
    minutes = F.greatest(F.lit(1.0), (F.unix_micros(F.max("last_indexed")) - F.unix_micros(F.min("last_indexed"))) / 60e6)
    return files.agg(F.count("*").alias("files"), F.round(F.count("*") / F.coalesce(minutes, F.lit(1.0)), 2).alias("per_minute"))


def prometheus(counters: dict[str, int], samples: DataFrame, seconds: str = "seconds", gauges: dict[str, float] | None = None) -> DataFrame:
    """Lines of the text exposition format: counters, gauges, then the latency histogram with sum and count."""
    spark = samples.sparkSession
    simple = [(k, v, kind) for kind, values in (("counter", counters), ("gauge", gauges or {})) for k, v in values.items()]
    lines = [(0, 2 * i + j, x) for i, (k, v, kind) in enumerate(simple) for j, x in enumerate((f"# TYPE {k} {kind}", f"{k} {v}"))]
    h = latency_histogram(samples, seconds)
    order = F.when(F.col("le") == "+Inf", 1e9).otherwise(F.expr("try_cast(le AS double)"))
    buckets = h.select(F.lit(1).alias("part"), (order * 10_000).cast("bigint").alias("i"), F.format_string('request_latency_seconds_bucket{le="%s"} %d', "le", "n").alias("line"))
    tail = samples.agg(F.sum(seconds).alias("s"), F.count(seconds).alias("c")).select(F.explode(F.array(F.format_string("request_latency_seconds_sum %.6f", F.coalesce("s", F.lit(0.0))), F.format_string("request_latency_seconds_count %d", "c"))).alias("line")).select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("i"), "line")
    head = spark.createDataFrame(lines or [(0, 0, "")], "part int, i bigint, line string").where("line <> ''")
    return head.unionAll(buckets).unionAll(tail).orderBy("part", "i", "line")


def rolling_latency(samples: DataFrame, order: str = "ts", seconds: str = "seconds", keep: int = 5000) -> DataFrame:
    """The newest samples only, as a bounded metrics window keeps them."""
    return samples.orderBy(F.desc(order)).limit(keep).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max"))
