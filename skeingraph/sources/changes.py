"""What changed: paths in diffs, entries of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUERY_LOG


def changed_paths(diffs: DataFrame) -> DataFrame:
    """path of every file that a diff (column diff) names in its `+++ b/` and `--- a/` headers, once."""
    lines = diffs.select(F.explode(F.split("diff", "\n")).alias("line"))
    head = F.startswith("line", F.lit("+++ b/")) | F.startswith("line", F.lit("--- a/"))
    return lines.where(head).select(F.rtrim(F.substring("line", 7, 1 << 30)).alias("path")).where("path <> ''").distinct()


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", QUERY_LOG).alias("r"))
    return rows.select("r.*").where("ts IS NOT NULL OR tool IS NOT NULL OR symbols IS NOT NULL")


def log_entry(rows: DataFrame) -> DataFrame:
    """Entries as they are logged: queries cut to 200 characters, symbols to 20."""
    return rows.select("ts", "tool", F.substring("query", 1, 200).alias("query"), F.slice("symbols", 1, 20).alias("symbols"))


def known_paths(paths: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """path of the known files (path) that paths name: as they are, below root, or by the longest known path that an absolute one ends in."""
    p = F.regexp_replace("path", r"^\./", "")
    if root is not None:
        inside = root.rstrip("/") + "/"
        p = F.when(F.startswith(p, F.lit(inside)), F.substring(p, len(inside) + 1, 1 << 30)).otherwise(p)
    asked = paths.where("path <> ''").select(p.alias("asked")).distinct()
    known = files.select("path")
    exact = asked.join(known, asked["asked"] == known["path"]).select("path")
    parts = F.split("asked", "/")  # an absolute path's ends, each a candidate
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, 1 << 30), "/"))
    tails = asked.where(F.startswith("asked", F.lit("/"))).select("asked", F.explode(ends).alias("path"))
    found = tails.join(known, "path").groupBy("asked").agg(F.max_by("path", F.length("path")).alias("path"))
    return exact.unionAll(found.select("path")).distinct()
