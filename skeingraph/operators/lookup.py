"""Point lookups, listings and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import kind_rank
from .tables import materialized


def file_hash(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("file_hash")


def list_files(files: DataFrame) -> DataFrame:
    return files.select("path", "language", "file_hash", "symbol_count", "edge_count", "error_count").orderBy("path")


def symbols_for_file(symbols: DataFrame, path: str) -> DataFrame:
    """By kind, then id."""
    return symbols.where(F.col("file_path") == path).orderBy(kind_rank(F.col("kind")), "id")


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; one pass with partial aggregation, no sort of groups."""
    packed = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])).alias("_row"))
    return packed.select("_row.*")


def named(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """All symbols whose qualified name is among names (qualified_name)."""
    return symbols.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select(symbols.columns)


def nodes(symbols: DataFrame, names: DataFrame, file_path: str | None = None) -> DataFrame:
    """For each of names (qualified_name) its symbol: of several the first kind in lookup order, then the least id."""
    rows = symbols if file_path is None else symbols.where(F.col("file_path") == file_path)
    return first_per_key(rows.join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select(symbols.columns), ["qualified_name"], [kind_rank(F.col("kind")), "id"])


def node(symbols: DataFrame, name: str, file_path: str | None = None) -> DataFrame:
    """One row, or none."""
    rows = symbols.where(F.col("qualified_name") == name)
    rows = rows if file_path is None else rows.where(F.col("file_path") == file_path)
    return rows.orderBy(kind_rank(F.col("kind")), "id").limit(1)


def all_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "kind")


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """files, symbols, edges, last_indexed ('never' if there is none), has_embeddings: one row."""
    counted = files.agg(F.count("*").alias("files"), F.coalesce(F.max("last_indexed").cast("string"), F.lit("never")).alias("last_indexed"))
    for name, table in (("symbols", symbols), ("edges", edges)):
        counted = counted.crossJoin(table.agg(F.count("*").alias(name)))  # one row each
    some = F.lit(False) if embeddings is None else None
    if some is not None:
        return counted.withColumn("has_embeddings", some)
    return counted.crossJoin(embeddings.agg((F.count("*") > 0).alias("has_embeddings")))


def health(stats_: DataFrame) -> DataFrame:
    """The counts, and status: healthy, or degraded if no file is indexed."""
    return stats_.withColumn("status", F.when(F.col("files") > 0, "healthy").otherwise("degraded"))


def counts_per_file(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """path, symbol_count, edge_count of every file."""
    s = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbol_count"))
    e = edges.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("edge_count"))
    joined = files.select("path").join(s, "path", "left").join(e, "path", "left")
    return joined.select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("symbol_count", "edge_count")))


def caller_callee_counts(edges: DataFrame) -> DataFrame:
    """name, callers, callees: how many different sources call a name, and targets it calls."""
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    up = calls.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("callers"))
    down = calls.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("callees"))
    return up.join(down, "name", "full_outer").select("name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "callees")))


def caller_callee_lists(edges: DataFrame) -> DataFrame:
    """name, callers, callees as sorted arrays."""
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    up = calls.groupBy(F.col("target").alias("name")).agg(F.sort_array(F.collect_list("source")).alias("callers"))
    down = calls.groupBy(F.col("source").alias("name")).agg(F.sort_array(F.collect_list("target")).alias("callees"))
    empty = F.array().cast("array<string>")
    return up.join(down, "name", "full_outer").select("name", *(F.coalesce(c, empty).alias(c) for c in ("callers", "callees")))


def with_start_lines(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """results (kind, qualified_name) with the start_line of the last symbol of that kind and name."""
    asked = results.select("kind", "qualified_name").distinct()  # of a few results, a small side: the symbols are then not shuffled
    lines = symbols.join(asked, ["kind", "qualified_name"], "left_semi").groupBy("kind", "qualified_name").agg(F.max_by("start_line", "id").alias("start_line"))
    return results.join(lines, ["kind", "qualified_name"], "left")


def numbered(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """A running number from 1 over the whole order; counts per range partition first, so no single task sorts everything.

    The partitions are drawn once and kept, each sorted, with every row's partition and place in one number: drawn again, their bounds may differ.
    """
    ranged = materialized(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33).alias("_p")
    before = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = before.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_p"))
    return placed.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_at", "_p", "_before")
