"""Queries: a tree's scans as a stream, the change feed of a log, bounded latency state, and segments of two schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import segments
from ..engine import Engine
from ..operators import sync
from ..operators.tables import scratch
from ..operators.usage import BUCKETS
from ..sources import star
from ..streaming import queries as streams
from . import stored
from .registering import registrar
from .stored import _E, _S, BACK, CHANGED, DELETED

QUERIES, ORACLES, query = registrar()

# ---------------------------------------------------------------- scans of a tree

_PATH = "concat(CASE WHEN o_orderkey % 13 = 5 AND {s} > 0 THEN 'moved' ELSE 'src' END, '/o_', CAST(o_orderkey AS STRING), '.py')"
#: Three scans: files that come, go, come back, move, change in size, or get an older time.
_SCANS = [
    f"SELECT {_PATH.format(s=s)} AS path, CAST(1000000 + o_orderkey % 500 - CASE WHEN o_orderkey % 11 = 3 AND {s} > 0 THEN 1000 ELSE 0 END AS DOUBLE) AS mtime, CAST(o_custkey % 10 + CASE WHEN o_orderkey % 17 = 1 AND {s} > 1 THEN 1 ELSE 0 END AS BIGINT) AS size FROM orders WHERE o_orderkey % {m} <> {r}"
    for s, m, r in ((0, 5, 4), (1, 7, 0), (2, 3, 1))
]


def _differences(before: str, now: str) -> str:
    """Moves are found by numbering what went and what came of one time and size."""
    return f"""SELECT coalesce(c.path, g.path) AS path, CASE WHEN g.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' ELSE 'moved' END AS change, CASE WHEN c.path IS NOT NULL THEN g.path END AS was
      FROM (SELECT *, row_number() OVER (PARTITION BY mtime, size ORDER BY path) AS k FROM {before} WHERE path NOT IN (SELECT path FROM {now})) g
      FULL JOIN (SELECT *, row_number() OVER (PARTITION BY mtime, size ORDER BY path) AS k FROM {now} WHERE path NOT IN (SELECT path FROM {before})) c USING (mtime, size, k)
      UNION ALL SELECT path, 'changed', NULL FROM {before} b JOIN {now} n USING (path) WHERE b.mtime <> n.mtime OR b.size <> n.size"""


_TABLES = ", ".join(f"s{i} AS MATERIALIZED ({t.replace('AS STRING)', 'AS VARCHAR)')})" for i, t in enumerate(_SCANS)) + ", none AS (SELECT * FROM s0 WHERE false)"


def _scan(spark: SparkSession, d: str, n: int) -> DataFrame:
    return star._run(spark, d, _SCANS[n], ("orders",))


@query(f"WITH {_TABLES} {_differences('s0', 's1')}")
def tree_differences(spark, d):
    """What changed between two scans: an older time counts, and moves are told from deletions."""
    return sync.differences(_scan(spark, d, 0), _scan(spark, d, 1))


@query(f"WITH {_TABLES} SELECT 0 AS scan, * FROM ({_differences('none', 's0')}) UNION ALL SELECT 1, * FROM ({_differences('s0', 's1')}) UNION ALL SELECT 2, * FROM ({_differences('s1', 's2')})")
def streamed_tree(spark, d):
    """The same over all scans as they arrive: one in a first run of the stream, two more in a second."""
    at, out = scratch(spark, "tree"), scratch(spark, "tree-changes")
    for scans in ((0,), (1, 2)):
        for s in scans:
            _scan(spark, d, s).withColumn("scan", F.lit(s).cast("long")).write.mode("append").parquet(f"{at}/scans")
        rows = spark.readStream.schema("path string, mtime double, size long, scan long").parquet(f"{at}/scans")
        streams.tree_changes(rows, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{at}/checkpoint", every=None).awaitTermination()
    return spark.read.parquet(out).select("scan", "path", "change", "was")


# ---------------------------------------------------------------- change feed

_V2 = f"SELECT id, file_path, qualified_name, kind, CASE WHEN file_path LIKE '{CHANGED}' THEN signature || ' again' ELSE signature END AS signature FROM v1 UNION ALL SELECT 5000000000 + n_nationkey, 'src/added/nations.py', 'added_' || n_nationkey, 'function', NULL FROM nation"
_STATES = f"v0 AS (SELECT * FROM v1 WHERE false), v1 AS MATERIALIZED (SELECT id, file_path, qualified_name, kind, signature FROM ({_S})), v2 AS MATERIALIZED ({_V2}), v3 AS MATERIALIZED (SELECT * FROM v2 WHERE file_path NOT IN ('{DELETED}', '{BACK}')), v4 AS MATERIALIZED (SELECT * FROM v3 UNION ALL SELECT * FROM v1 WHERE file_path = '{BACK}' AND id % 2 = 0)"
_STEP = "SELECT {n} AS step, coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.qualified_name, b.qualified_name) AS entity, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM v{m} a FULL JOIN v{n} b ON a.file_path = b.file_path AND a.qualified_name = b.qualified_name WHERE a.id IS NULL OR b.id IS NULL OR a.signature IS DISTINCT FROM b.signature"


@query(f"WITH {_STATES.replace('v0 AS (SELECT * FROM v1 WHERE false), ', '')}, v0 AS (SELECT * FROM v1 WHERE false) " + " UNION ALL ".join(_STEP.format(m=n - 1, n=n) for n in (1, 2, 3, 4)))
def change_feed(spark, d):
    """Symbols that differ from version to version, as a subscriber's stream over the log of versions says."""
    e = Engine(spark, scratch(spark, "feed"))
    e.init()
    first = e._version()[0]
    at, out = scratch(spark, "subscriber"), scratch(spark, "feed-changes")
    for i, (new, gone) in enumerate(stored.batches(spark, d, edges=False)):
        e._extend(new, gone, ("symbols",))  # a feed compares files and symbols alone
        if i % 2:  # two versions at a time
            e.feed(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), at, every=None).awaitTermination()
    rows = spark.read.parquet(out).where("relation = 'symbols'")
    return rows.select((F.col("version") - first).cast("int").alias("step"), "file_path", "entity", "change")


# ---------------------------------------------------------------- latency

_MOST, _KEEP = 1000, 500


@query(
    f"""WITH e AS (SELECT event_type AS key, epoch_us(ts) / 1e6 AS ts, value / 100 AS seconds FROM events), c AS (SELECT key, count(*) AS n, CASE WHEN count(*) <= {_MOST} THEN count(*) ELSE {_KEEP} + (count(*) - {_MOST} - 1) % ({_MOST} + 1 - {_KEEP}) END AS kept, {', '.join(f'count(*) FILTER (seconds <= {b}) AS {streams.bound(b)}' for b in BUCKETS)} FROM e GROUP BY key),
    h AS (SELECT key, seconds FROM (SELECT key, seconds, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seconds DESC) AS back FROM e) JOIN c USING (key) WHERE back <= kept),
    p AS (SELECT key, round(sum(seconds), 6) AS total, list_sort(list(seconds)) AS held FROM h GROUP BY key)
    SELECT key, n, kept, total, held[kept // 2 + 1] AS p50, {', '.join(map(streams.bound, BUCKETS))} FROM c JOIN p USING (key)"""
)
def bounded_latency(spark, d):
    """Of each kind of event the newest samples, in three runs of a stream."""
    at, out = scratch(spark, "latency"), scratch(spark, "latency-rows")
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("value") / 100).alias("seconds"), F.least(F.floor(F.dayofmonth("ts") / 11), F.lit(2)).alias("run"))
    for run in range(3):
        events.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{at}/samples")
        rows = spark.readStream.schema("key string, ts double, seconds double").parquet(f"{at}/samples")
        with streams.state_in_rocksdb(spark):
            writer = streams.bounded_latencies(rows, _MOST, _KEEP).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
            writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("key", "batch")]), "n").alias("x")).select("key", "x.*")
    return last.withColumn("total", F.round("total", 6))


# ---------------------------------------------------------------- schemas

#: Files as an older schema had them, and the two steps since.
_OLD = {"files": "path STRING, lang STRING, file_hash STRING, symbol_count INT"}
_MID = {"files": "path STRING, language STRING, file_hash STRING, symbol_count BIGINT"}
_NEW = {"files": "path STRING, language STRING, file_hash STRING, symbol_count BIGINT, edge_count BIGINT, error_count INT"}
_STEPS = ({"files": segments.Migration(renamed={"lang": "language"}, widened={"symbol_count": ("INT", "BIGINT")})}, {"files": segments.Migration(added={"edge_count": ("BIGINT", "-1"), "error_count": ("INT", "symbol_count - symbol_count")})})


@query(star.oracle("SELECT path, language, CASE WHEN path LIKE 'src/models/%' THEN upper(file_hash) ELSE file_hash END AS file_hash, symbol_count, CASE WHEN path LIKE 'src/models/%' THEN edge_count ELSE -1 END AS edge_count, CASE WHEN path LIKE 'src/models/%' OR path LIKE 'src/orders/%' THEN 3 ELSE 0 END AS error_count FROM files WHERE path NOT LIKE 'src/orders/%'"))
def migrated_files(spark, d):
    """Segments of three schemas read as one: renamed, widened and new columns, and replaced and deleted files across them."""
    home = scratch(spark, "schemas")
    none = {n: spark.createDataFrame([], segments.RELATIONS[n]) for n in ("symbols", "edges")}
    files = star.files(spark, d)
    models = files.where("path LIKE 'src/models/%'")
    gone = lambda rows, deleted: rows.select("path", F.lit(deleted).alias("deleted"))
    first = segments.Segments(spark, home, _OLD, ()).write({"files": files.withColumnRenamed("language", "lang"), **none}, gone(files.limit(0), False))
    second = segments.Segments(spark, home, _MID, _STEPS[:1]).write({"files": models, **none}, gone(models.unionByName(files.where("path LIKE 'src/orders/%'")), True))
    now = segments.Segments(spark, home, _NEW, _STEPS)
    third = now.write({"files": models.withColumns({"file_hash": F.upper("file_hash"), "error_count": F.lit(3)}), **none}, gone(models, False))
    return now.live("files", [first, second, third]).select("path", "language", "file_hash", "symbol_count", "edge_count", "error_count")
