"""Keeping relations in step with files: classifying changes, replacing a file's rows, deleting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status: new, changed, unchanged or deleted; disk: path, content_hash; stored: path, file_hash."""
    both = disk.select("path", F.col("content_hash").alias("_new")).join(stored.select("path", F.col("file_hash").alias("_old")), "path", "full_outer")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def freshness(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """status, n."""
    return classify(disk, stored).groupBy("status").agg(F.count("*").alias("n"))


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """old without the rows of changed (path), and new's rows for them: the relation after an upsert."""
    paths = changed.select(F.col("path").alias(key)).distinct()
    return old.join(paths, key, "left_anti").select(old.columns).unionByName(new.join(paths, key, "left_semi").select(old.columns))


def upsert(state: dict[str, DataFrame], parsed: dict[str, DataFrame], force: bool = False, drop_deleted: bool = False) -> dict[str, DataFrame]:
    """files, symbols, edges after an ingest; unchanged hashes are skipped unless forced, fatal files bring nothing.

    parsed holds files (path, language, file_hash, ..., fatal_error), symbols and edges of the files read.
    """
    read = parsed["files"].where("fatal_error IS NULL")
    status = classify(read.select("path", F.col("file_hash").alias("content_hash")), state["files"])
    wanted = status.where("status IN ('new', 'changed')" + (" OR status = 'unchanged'" if force else ""))
    out = {name: replace_files(state[name], parsed[name] if name != "files" else read, wanted, key) for name, key in (("files", "path"), ("symbols", "file_path"), ("edges", "source_file"))}
    if drop_deleted:
        gone = classify(parsed["files"].select("path", F.col("file_hash").alias("content_hash")), state["files"]).where("status = 'deleted'")
        out = delete_files(out, gone)
    return out


def delete_files(state: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Without the files (path), their symbols, and the edges from or into them."""
    paths = gone.select("path").distinct()
    anti = lambda t, key: t.join(paths.withColumnRenamed("path", key), key, "left_anti").select(t.columns)
    return {"files": anti(state["files"], "path"), "symbols": anti(state["symbols"], "file_path"), "edges": anti(anti(state["edges"], "source_file"), "target_file")}


def deleted_since(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.join(now, "path", "left_anti").select("path")


def newer(before: DataFrame, now: DataFrame) -> DataFrame:
    """path of files (path, mtime) that are new or have a later time."""
    b = before.select("path", F.col("mtime").alias("_was"))
    return now.join(b, "path", "left").where("_was IS NULL OR mtime > _was").select("path")


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, change (new, changed, deleted or moved), was (a moved file's old path) between two listings (path, mtime, size).

    A file is changed if its time or size differs in any way. A deleted and a new one of one time and size are one that was
    moved; of several such, the first paths of both sides belong together, then the second ones.
    """
    old = before.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    both = old.join(now.select("path", "mtime", "size"), "path", "full_outer")
    change = F.when(F.col("_m").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when((F.col("_m") != F.col("mtime")) | (F.col("_s") != F.col("size")), "changed")
    rows = both.select("path", change.alias("change"), F.coalesce("mtime", "_m").alias("mtime"), F.coalesce("size", "_s").alias("size")).where("change IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("change", "mtime", "size").orderBy("path"))
    ends = rows.where("change IN ('new', 'deleted')").withColumn("n", place)
    pair = ends.groupBy("mtime", "size", "n").agg(F.max(F.when(F.col("change") == "new", F.col("path"))).alias("to"), F.max(F.when(F.col("change") == "deleted", F.col("path"))).alias("was"))
    moved = F.col("to").isNotNull() & F.col("was").isNotNull()
    one = pair.select(F.coalesce("to", "was").alias("path"), F.when(moved, "moved").when(F.col("was").isNull(), "new").otherwise("deleted").alias("change"), F.when(moved, F.col("was")).alias("was"))
    return one.unionAll(rows.where("change = 'changed'").select("path", "change", F.lit(None).cast("string").alias("was")))
