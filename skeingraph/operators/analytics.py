"""Roles, smells, complexity and design patterns of symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import complexity_rank, last_segment, role
from .lookup import caller_callee_counts

#: Limits that make a smell.
GOD_METHODS, LONG_LINES, MANY_PARAMETERS, DEEP, MANY_CALLERS = 20, 50, 5, 4, 10

ODOR = "rule string, symbol string, severity string, count int, lines int, depth int, caller_count int, external int, internal int"


def roles(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """qualified_name, role, from the last segment of the name and direct caller and callee counts."""
    counts = caller_callee_counts(edges)
    joined = symbols.select("qualified_name").distinct().join(counts, F.col("qualified_name") == counts["name"], "left")
    return joined.select("qualified_name", role(F.col("qualified_name"), F.col("callers"), F.col("callees")).alias("role"))


def _odor(rows: DataFrame, rule: str, severity: str, **measures: Column | str) -> DataFrame:
    names = [x.split()[0] for x in ODOR.split(", ")][3:]
    cols = [(F.col(measures[c]) if isinstance(measures.get(c), str) else measures.get(c, F.lit(None))).cast("int").alias(c) for c in names]
    return rows.select(F.lit(rule).alias("rule"), F.col("symbol"), F.lit(severity).alias("severity"), *cols)


def node_smells(shapes: DataFrame) -> DataFrame:
    """Smells of the syntax alone.

    shapes: symbol, node (class or function), methods, lines, parameters, nesting, as the source extractor gives them.
    """
    classes, functions = shapes.where("node = 'class'"), shapes.where("node = 'function'")
    return (
        _odor(classes.where(F.col("methods") > GOD_METHODS), "god_class", "warning", count="methods")
        .unionAll(_odor(functions.where(F.col("lines") > LONG_LINES), "long_method", "info", lines="lines"))
        .unionAll(_odor(functions.where(F.col("parameters") > MANY_PARAMETERS), "long_parameter_list", "info", count="parameters"))
        .unionAll(_odor(functions.where(F.col("nesting") > DEEP), "deep_nesting", "warning", depth="nesting"))
    )


def dead_code(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions (symbol) with a leading underscore that nothing calls."""
    called = edges.where("kind = 'calls'").select(F.col("target").alias("symbol")).distinct()
    private = functions.where(F.startswith(last_segment(F.col("symbol")), F.lit("_")))
    return _odor(private.join(called, "symbol", "left_anti"), "dead_code", "info")


def shotgun_surgery(edges: DataFrame) -> DataFrame:
    counts = caller_callee_counts(edges).where(F.col("callers") > MANY_CALLERS).withColumnRenamed("name", "symbol")
    return _odor(counts, "shotgun_surgery", "warning", caller_count="callers")


def feature_envy(edges: DataFrame) -> DataFrame:
    """Called symbols that call more names that do not begin with their own than names that do; counted, never listed."""
    calls = edges.where("kind = 'calls'").select("source", "target").distinct()
    inside = F.count_if(F.startswith("target", "source"))
    counts = calls.groupBy(F.col("source").alias("symbol")).agg(inside.alias("_in"), F.count("*").alias("_all")).withColumn("_out", F.col("_all") - F.col("_in"))
    called = edges.where("kind = 'calls'").select(F.col("target").alias("symbol"))
    return _odor(counts.where("_out > _in").join(called, "symbol", "left_semi"), "feature_envy", "warning", external="_out", internal="_in")


def smells(shapes: DataFrame, edges: DataFrame) -> DataFrame:
    functions = shapes.where("node = 'function'").select("symbol")
    parts = [node_smells(shapes), dead_code(functions, edges), shotgun_surgery(edges), feature_envy(edges)]
    return reduce(DataFrame.unionAll, parts)


def filter_smells(odors: DataFrame, file_path: str | None = None, severity: str | None = None) -> DataFrame:
    rows = odors if file_path is None else odors.where(F.col("file") == file_path)
    return rows if severity is None else rows.where(F.col("severity") == severity)


def rank_distribution(complexity: DataFrame) -> DataFrame:
    """rank, n; complexity: a table with a complexity column."""
    return complexity.groupBy(complexity_rank(F.col("complexity")).alias("rank")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- patterns


def _found(rows: DataFrame, pattern: str, confidence: str, evidence: Column | str, symbol: str = "qualified_name") -> DataFrame:
    text = F.lit(evidence) if isinstance(evidence, str) else evidence
    return rows.select(F.lit(pattern).alias("pattern"), F.col(symbol).alias("symbol"), F.lit(confidence).alias("confidence"), text.alias("evidence"))


def _named(rows: DataFrame, *parts: str) -> DataFrame:
    name = F.lower(F.col("name"))
    return rows.where(reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts]))


def singletons(symbols: DataFrame) -> DataFrame:
    classes = symbols.where("kind = 'class'")
    signed = classes.where("contains(signature, 'get_instance') OR contains(signature, 'getInstance')")
    return _found(_named(classes, "_instance", "singleton"), "Singleton", "medium", "Class name suggests singleton pattern").unionAll(_found(signed, "Singleton", "high", "Has get_instance/getInstance method"))


def factories(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """By name; and functions whose return annotation is part of the name of something they call."""
    named = _found(_named(symbols, "factory", "builder"), "Factory", "medium", "Name contains Factory/Builder")
    returns = F.rtrim(F.trim(F.substring_index("signature", "->", -1)), F.lit(":"))
    made = symbols.where("kind IN ('function', 'method') AND contains(signature, '->')").select("qualified_name", returns.alias("type")).where("type NOT IN ('', 'None')")
    calls = edges.where("kind = 'calls'").select(F.col("source").alias("qualified_name"), "target")
    low = made.join(calls, "qualified_name").where(F.contains("target", "type")).select("qualified_name", "type").distinct()
    return named.unionAll(_found(low, "Factory", "low", F.concat(F.lit("Returns "), "type", F.lit(" objects"))))


def observers(symbols: DataFrame) -> DataFrame:
    takes = _named(symbols, "subscribe", "add_listener", "on_", "register", "attach")
    tells = _named(symbols, "notify", "emit", "trigger", "dispatch", "fire")
    return _found(takes, "Observer", "low", "Has subscription/registration method").unionAll(_found(tells, "Observer", "medium", "Has notification/event method"))


def strategies(symbols: DataFrame, listed: int = 3) -> DataFrame:
    """Parents of two classes and more; the first few are named, in the order of their ids."""
    classes = symbols.where("kind = 'class' AND parent_symbol <> ''")
    # the first few by id only, so that a parent of very many classes stays a small row
    few = F.slice(F.sort_array(F.collect_list(F.struct("id", "qualified_name"))), 1, listed)
    from pyspark.sql import Window

    order = Window.partitionBy("parent_symbol").orderBy("id")
    counts = classes.groupBy("parent_symbol").agg(F.count("*").alias("n")).where("n >= 2")
    first = classes.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= listed).groupBy("parent_symbol").agg(few.alias("few"))
    text = F.concat(F.lit("Abstract base with "), F.col("n").cast("string"), F.lit(" implementations: "), F.array_join("few.qualified_name", ", "))
    return _found(counts.join(first, "parent_symbol"), "Strategy", "medium", text, "parent_symbol")


def decorators(symbols: DataFrame) -> DataFrame:
    classes = symbols.where("kind = 'class'")
    sig = F.lower(F.col("signature"))
    keyword = F.coalesce(*[F.when(F.contains(sig, F.lit(k)), k) for k in ("component", "wrapped", "wrappee", "delegate")])
    takes = classes.where("contains(signature, 'self')").withColumn("_k", keyword).where("_k IS NOT NULL")
    low = _found(takes, "Decorator", "low", F.concat(F.lit("Constructor takes "), "_k", F.lit(" parameter")))
    return _found(_named(classes, "decorator", "wrapper"), "Decorator", "medium", "Name contains Decorator/Wrapper").unionAll(low)


def repositories(symbols: DataFrame) -> DataFrame:
    return _found(_named(symbols.where("kind = 'class'"), "repository", "store", "dao", "repo"), "Repository", "high", "Name contains Repository/Store/DAO")


def patterns(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """pattern, symbol, confidence, evidence of all six detectors; listings sort by confidence as a word, falling."""
    parts = [singletons(symbols), factories(symbols, edges), observers(symbols), strategies(symbols), decorators(symbols), repositories(symbols)]
    return reduce(DataFrame.unionAll, parts)
