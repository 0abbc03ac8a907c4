"""Semantic documents: merging, annotations, unknowns, insights, coverage, and what a task's context shows.

Documents arrive as versions with an ingest_seq; everything that the order of arrival decides is decided by
it, explicitly, inside each file's group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import last_segment
from .lookup import caller_callee_counts
from .tables import few, materialized, ordered_md5

#: Up to so many files' summaries are broadcast to the results they belong to.
SUMMARIES = 100_000
#: For more results than so many, bounded lists are made for all names that edges have, and not for each result.
ASKED = 1_000
_SIDES = ("callers", "callees")


def _exploded(docs: DataFrame, field: str) -> DataFrame:
    return docs.select("file", "ingest_seq", F.posexplode(field).alias("pos", "item"))


def annotations_of(docs: DataFrame) -> DataFrame:
    """file, symbol, kind, summary, design_intent, pitfalls, place: the last version of each symbol's annotation at its first place."""
    rows = _exploded(docs, "annotations").withColumn("at", F.struct("ingest_seq", "pos"))
    merged = rows.groupBy("file", "item.symbol").agg(F.max_by("item", "at").alias("item"), F.min("at").alias("place"))
    return merged.select("file", "item.*", "place")


def unknowns_of(docs: DataFrame) -> DataFrame:
    """file, symbol, question, context, place: the first version of each question about a symbol."""
    rows = _exploded(docs, "unknowns").withColumn("at", F.struct("ingest_seq", "pos"))
    merged = rows.groupBy("file", "item.symbol", "item.question").agg(F.min_by("item", "at").alias("item"), F.min("at").alias("place"))
    return merged.select("file", "item.*", "place")


def insights_of(docs: DataFrame) -> DataFrame:
    """file, insight, related_symbols, place: every one ever added."""
    return _exploded(docs, "insights").select("file", "item.*", F.struct("ingest_seq", "pos").alias("place"))


def odors_of(docs: DataFrame) -> DataFrame:
    """file and an odor's fields of every odor in any version: they add up."""
    return docs.select("file", F.explode("odors").alias("item")).select("file", "item.*")


def _roles(docs: DataFrame) -> DataFrame:
    """file, k, v: the last value of each role."""
    rows = docs.select("file", "ingest_seq", F.explode("module_roles").alias("k", "v"))
    return rows.groupBy("file", "k").agg(F.max_by("v", F.struct("ingest_seq")).alias("v"))


def roles_of(docs: DataFrame) -> DataFrame:
    """file, module_roles, metrics: the last value of each role and the last metrics, without anything else that versions say."""
    roles = _roles(docs).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("module_roles"))
    last = lambda c: F.max_by(F.when(F.col(f"metrics.{c}").isNotNull(), F.col(f"metrics.{c}")), F.when(F.col(f"metrics.{c}").isNotNull(), F.struct("ingest_seq"))).alias(c)
    metrics = docs.groupBy("file").agg(last("complexity"), last("raw")).select("file", F.struct("complexity", "raw").alias("metrics"))
    return metrics.join(roles, "file", "left").withColumn("module_roles", F.coalesce("module_roles", F.create_map().cast("map<string, string>")))


def _items(docs: DataFrame) -> DataFrame:
    """file, kind, k1, k2, at, v: each version as rows of what it says; v has one field for each kind (d: the version itself), of which one is set."""
    of = {c[0]: docs.schema[c].dataType.elementType for c in ("annotations", "unknowns", "insights", "odors")} | {"r": docs.schema["module_roles"].dataType.valueType}
    whole = F.struct("file_hash", "ingested_at", "source", "module_summary", F.col("metrics.complexity").alias("complexity"), F.col("metrics.raw").alias("raw"))
    shape = docs.select(whole.alias("d")).schema["d"].dataType
    text, none = F.lit(None).cast("string"), F.lit(None)

    def item(kind: str, value: Column, k1: Column = text, k2: Column = text, pos: Column | None = None) -> Column:
        fields = [(value if k == kind else none.cast(t)).alias(k) for k, t in ({"d": shape} | of).items()]
        return F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2"), (F.lit(0) if pos is None else pos).alias("pos"), F.struct(*fields).alias("v"))

    def each(name: str, make) -> Column:
        return F.coalesce(F.transform(name, make), F.array().cast(f"array<{one.simpleString()}>"))

    one = docs.select(item("d", whole).alias("x")).schema["x"].dataType
    roles = F.coalesce(F.transform(F.map_entries("module_roles"), lambda e: item("r", e["value"], e["key"])), F.array().cast(f"array<{one.simpleString()}>"))
    said = F.concat(
        F.array(item("d", whole)), each("annotations", lambda x, i: item("a", x, x["symbol"], pos=i)), each("unknowns", lambda x, i: item("u", x, x["symbol"], x["question"], i)),
        each("insights", lambda x, i: item("i", x, pos=i)), each("odors", lambda x, i: item("o", x, pos=i)), roles,
    )
    rows = docs.select("file", "ingest_seq", F.explode(said).alias("x"))
    return rows.select("file", "x.kind", "x.k1", "x.k2", F.struct("ingest_seq", "x.pos").alias("at"), "x.v")


def merge_documents(docs: DataFrame) -> DataFrame:
    """One document per file out of all its versions.

    Summary: the last that is not empty. Annotations: by symbol, the last version at the first place. Unknowns: by
    symbol and question, the first. Insights and odors: all, in order. Metrics, roles: the last value of each key.
    All come from one look at the versions: what is said is aggregated by its key, and then by file.
    """
    d = lambda c: F.col(f"v.d.{c}")
    last = lambda c, ok: F.max_by(F.when(ok, d(c)), F.when(ok, F.col("at")))
    keyed = _items(docs).groupBy("file", "kind", "k1", "k2").agg(
        F.max_by("v", "at").alias("last"), F.min_by("v", "at").alias("first"), F.min("at").alias("place"), F.collect_list(F.when(F.col("kind").isin("i", "o"), F.struct("at", "v"))).alias("every"),
        F.struct(
            *[F.max_by(d(c), "at").alias(c) for c in ("file_hash", "ingested_at", "source")], last("module_summary", F.coalesce(d("module_summary"), F.lit("")) != "").alias("module_summary"),
            last("complexity", d("complexity").isNotNull()).alias("complexity"), last("raw", d("raw").isNotNull()).alias("raw"),
        ).alias("whole"),
    )
    kind = lambda k: F.col("kind") == k
    one = lambda k, side: F.transform(F.sort_array(F.collect_list(F.when(kind(k), F.struct("place", F.col(f"{side}.{k}").alias("v"))))), lambda x: x["v"])
    every = lambda k: F.transform(F.sort_array(F.flatten(F.collect_list(F.when(kind(k), F.transform("every", lambda x: F.struct(x["at"].alias("at"), x["v"][k].alias("v"))))))), lambda x: x["v"])
    merged = keyed.groupBy("file").agg(
        F.any_value(F.when(kind("d"), F.col("whole")), True).alias("d"), one("a", "last").alias("annotations"), one("u", "first").alias("unknowns"), every("i").alias("insights"), every("o").alias("odors"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(kind("r"), F.struct("k1", F.col("last.r").alias("v")))))).alias("module_roles"),
    )
    names = ("file_hash", "ingested_at", "source")
    return merged.select(
        "file", *[F.col(f"d.{c}").alias(c) for c in names], F.coalesce("d.module_summary", F.lit("")).alias("module_summary"), "annotations", "unknowns", "insights", "odors", "module_roles",
        F.struct(F.col("d.complexity").alias("complexity"), F.col("d.raw").alias("raw")).alias("metrics"),
    )


def merged_digests(docs: DataFrame) -> DataFrame:
    """file, ingested_at, module_summary, annotations, unknowns, insights, roles: what merge_documents would hold, each list as the md5 of its texts in order.

    Lists are never made: a file may have any number of versions, and what they say need not fit a row.
    """
    texts = {
        "annotations": (annotations_of(docs), F.concat("symbol", "summary")), "unknowns": (unknowns_of(docs), F.concat("symbol", "question", "context")),
        "insights": (insights_of(docs), F.concat("insight", F.col("related_symbols")[0])),
    }
    rows = [t.select("file", F.lit(part).alias("part"), F.col("place.ingest_seq").cast("long").alias("seq"), F.col("place.pos").alias("pos"), F.lit("").alias("k"), said.alias("text")) for part, (t, said) in texts.items()]
    rows.append(_roles(docs).select("file", F.lit("roles").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("pos"), "k", F.concat("k", "v").alias("text")))
    said = ordered_md5(reduce(DataFrame.unionAll, rows), ["file", "part"], ["seq", "pos", "k"], "text")
    parts = (*texts, "roles")
    lists = said.groupBy("file").agg(*[F.max(F.when(F.col("part") == p, F.col("md5"))).alias(p) for p in parts])
    last = F.coalesce(F.max_by("module_summary", F.when(F.coalesce("module_summary", F.lit("")) != "", F.struct("ingest_seq"))), F.lit(""))
    whole = docs.groupBy("file").agg(F.max_by("ingested_at", "ingest_seq").alias("ingested_at"), last.alias("module_summary"))
    return whole.join(lists, "file", "left").withColumns({p: F.coalesce(p, F.md5(F.lit(""))) for p in parts})


def from_relations(annotations: DataFrame, unknowns: DataFrame, insights: DataFrame, modules: DataFrame) -> DataFrame:
    """Documents out of the four flat tables: a file in any of them is one."""
    pack = lambda t, name, fields, order: t.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias(name))
    a = pack(annotations, "annotations", ["symbol", "kind", "summary", "design_intent", "pitfalls"], ["symbol"])
    u = pack(unknowns, "unknowns", ["symbol", "question", "context"], ["symbol", "question"])
    i = pack(insights, "insights", ["insight", "related_symbols"], ["insight"])
    return modules.join(a, "file", "full_outer").join(u, "file", "full_outer").join(i, "file", "full_outer")


def upsert_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def insert_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Later writes of a key do nothing."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def delete_annotation(annotations: DataFrame, file: str, symbol: str, index: int | None = None) -> DataFrame:
    """Without the annotation of that key; with index, only the index-th (from 0) of several."""
    hit = (F.col("file") == file) & (F.col("symbol") == symbol)
    if index is None:
        return annotations.where(~hit)
    n = F.row_number().over(Window.partitionBy("file", "symbol").orderBy("place")) - 1
    left = annotations.where(hit).withColumn("_n", n).where(F.col("_n") != index).drop("_n")  # only that key's entries are numbered
    return annotations.where(~F.coalesce(hit, F.lit(False))).unionByName(left)


def without_files(rows: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    return rows.join(files.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(rows.columns)


def filter_annotations(annotations: DataFrame, file: str | None = None, symbol: str | None = None) -> DataFrame:
    rows = annotations if file is None else annotations.where(F.col("file") == file)
    return rows if symbol is None else rows.where(F.col("symbol") == symbol)


def annotated_symbols(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count_distinct("file", "symbol").alias("annotated"))


def documented_files(docs: DataFrame) -> DataFrame:
    """Files with a summary or an annotation; of documents or of their versions, which merging does not change."""
    return docs.where("coalesce(module_summary, '') <> '' OR size(annotations) > 0").select("file").distinct()


def coverage(docs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: percentages of documented files and annotated symbols, to one place, and as a text; docs: documents or their versions."""
    pct = lambda x, y: F.when(F.col(y) > 0, F.round(100.0 * F.col(x) / F.nullif(F.col(y), F.lit(0)), 1)).otherwise(0.0)
    one = documented_files(docs).agg(F.count("*").alias("documented")).crossJoin(annotated_symbols(annotations_of(docs)))
    one = one.crossJoin(files.agg(F.count("*").alias("files"))).crossJoin(symbols.agg(F.count("*").alias("symbols")))
    rows = one.select("documented", "annotated", "files", "symbols", pct("documented", "files").alias("file_percent"), pct("annotated", "symbols").alias("symbol_percent"))
    none = (F.col("files") == 0) & (F.col("symbols") == 0)
    return rows.withColumn("coverage", F.when(none, "0% files, 0% symbols").otherwise(F.format_string("%.1f%% files, %.1f%% symbols", "file_percent", "symbol_percent")))


def summaries(docs: DataFrame) -> DataFrame:
    return docs.select("file", "module_summary", *(F.size(c).alias(f"{c[:-1]}_count") for c in ("annotations", "unknowns", "insights")))


def summaries_of(docs: DataFrame) -> DataFrame:
    """summaries of the merged documents, counted in their versions without making any list."""
    last = F.coalesce(F.max_by("module_summary", F.when(F.coalesce("module_summary", F.lit("")) != "", F.struct("ingest_seq"))), F.lit(""))
    out = docs.groupBy("file").agg(last.alias("module_summary"), F.coalesce(F.sum(F.size(F.coalesce("insights", F.array().cast(docs.schema["insights"].dataType)))), F.lit(0)).cast("int").alias("insight_count"))
    for name, keys in (("annotation", ("symbol",)), ("unknown", ("symbol", "question"))):
        rows = docs.select("file", F.explode(f"{name}s").alias("x")).select("file", *[f"x.{k}" for k in keys]).distinct()
        out = out.join(rows.groupBy("file").agg(F.count("*").cast("int").alias(f"{name}_count")), "file", "left")
    return out.select("file", "module_summary", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("annotation_count", "unknown_count", "insight_count")))


def unknowns_ranked(unknowns: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """By how often their symbol is called or calls, most first."""
    counts = caller_callee_counts(edges)
    rows = unknowns.join(counts, unknowns["symbol"] == counts["name"], "left").withColumn("reference_count", F.coalesce(F.col("callers") + F.col("callees"), F.lit(0)))
    return rows.select("file", "symbol", "question", "reference_count").orderBy(F.desc("reference_count"), "file", "symbol", "question").limit(limit)


def first_insights(insights: DataFrame, limit: int = 20) -> DataFrame:
    return insights.orderBy("file", "place").select("file", "insight", "related_symbols").limit(limit)


def complexity_rows(docs: DataFrame, file: str | None = None) -> DataFrame:
    rows = docs if file is None else docs.where(F.col("file") == file)
    return rows.select("file", F.explode("metrics.complexity").alias("c")).select("file", "c.*")


def node_details(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Symbols with the role that their file's document gives their qualified name and the complexity of their bare name."""
    roles = docs.select(F.col("file").alias("file_path"), F.explode("module_roles").alias("qualified_name", "role"))
    ranks = complexity_rows(docs).groupBy(F.col("file").alias("file_path"), "name").agg(F.max("complexity").alias("complexity"))
    return symbols.join(roles, ["file_path", "qualified_name"], "left").join(ranks, ["file_path", "name"], "left")


def _nearest(ends: DataFrame, most: int) -> DataFrame:
    """name, callers, n_callers, callees, n_callees of ends (name, side, other): the first names a list, and how many there are.

    The ends are shuffled once, in ranges, so those of a name that everything calls lie in many tasks; equal ones lie in one.
    A task sends on what it found of a name: one row for each batch that holds some of it.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            differs = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in b.columns]
            new = np.concatenate([[last is None or b.slice(0, 1).to_pylist() != last], np.logical_or.reduce(differs)])
            last = b.slice(b.num_rows - 1).to_pylist()
            b = b.filter(pa.array(new))
            if not b.num_rows:
                continue
            starts = np.concatenate([[True], np.logical_or(*[pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in b.columns[:2]])]).nonzero()[0]
            n = np.diff(starts, append=b.num_rows)
            first = b.column(2).filter(pa.array(np.arange(b.num_rows) - np.repeat(starts, n) < most))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, most))]), pa.int32()), first)
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), lists, pa.array(n, pa.int64())], names=["name", "side", "first", "n"])

    order = ("name", "side", "other")
    found = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "name string, side int, first array<string>, n bigint")
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    said = [x for i, c in enumerate(_SIDES) for x in (F.slice(F.sort_array(F.flatten(F.collect_list(of(i, "first")))), 1, most).alias(c), F.coalesce(F.sum(of(i, "n")), F.lit(0)).alias(f"n_{c}"))]
    return found.groupBy("name").agg(*said)


def _with_nearest(rows: DataFrame, calls: DataFrame, most: int) -> DataFrame:
    """Many rows (qualified_name, ...) with the first callers and callees of their qualified and bare names, and how many there are.

    Lists are made for each name that edges have, then looked up by either name: of two names the counts are added less what both have.
    """

    def ends_of(pairs: DataFrame) -> DataFrame:
        both = F.explode(F.array(*[F.struct(F.col(a).alias("name"), F.lit(i).alias("side"), F.col(b).alias("other")) for i, (a, b) in enumerate((("target", "source"), ("source", "target")))]))
        return pairs.where("source IS NOT NULL AND target IS NOT NULL").select(both.alias("e")).select("e.*")

    ends = ends_of(calls)
    found = _nearest(ends, most)
    bare = last_segment(F.col("name"))
    dotted = few(ends_of(calls.where("contains(source, '.') OR contains(target, '.')")).where(bare != F.col("name")).distinct(), "dotted")
    shared = [F.lit(0).alias(f"s_{c}") for c in _SIDES]
    if not dotted.isEmpty():
        again = ends.join(dotted.select(F.col("name").alias("whole"), bare.alias("name"), "side", "other"), ["name", "side", "other"]).select("whole", "side", "other").distinct()
        counts = again.groupBy("whole").agg(*[F.count(F.when(F.col("side") == i, 1)).alias(f"s_{c}") for i, c in enumerate(_SIDES)])
        found = found.join(counts, F.col("name") == F.col("whole"), "left")
        shared = [F.coalesce(f"s_{c}", F.lit(0)).alias(f"s_{c}") for c in _SIDES]
    lists = [x for c in _SIDES for x in (c, f"n_{c}")]
    whole = found.select(F.col("name").alias("_whole"), *lists, *shared)
    ends_in = found.select(F.col("name").alias("_bare"), *[F.col(c).alias(f"b_{c}") for c in lists])
    last = last_segment(F.col("qualified_name"))
    out = rows.join(whole, rows["qualified_name"] == whole["_whole"], "left")
    out = out.join(ends_in, (last == F.col("_bare")) & (last != F.col("qualified_name")), "left")
    empty = F.array().cast("array<string>")
    merged = {}
    for c in _SIDES:
        merged[c] = F.slice(F.sort_array(F.array_distinct(F.concat(F.coalesce(c, empty), F.coalesce(f"b_{c}", empty)))), 1, most)
        merged[f"n_{c}"] = F.coalesce(f"n_{c}", F.lit(0)) + F.coalesce(f"b_n_{c}", F.lit(0)) - F.when(F.col("_bare").isNotNull(), F.coalesce(f"s_{c}", F.lit(0))).otherwise(0)
    return out.select(*rows.columns, *[x.alias(c) for c, x in merged.items()])


def context(results: DataFrame, edges: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """Search results (qualified_name, file_path, ...) with their direct callers and callees in order, n_callers, n_callees, and the file's summary.

    Names in edges may be bare or qualified: both count. most: so many names a list; those that come first are picked before
    any list is made, so that a name that everything calls costs no more than others.
    """
    names = results.select("qualified_name", F.explode(F.array_distinct(F.array("qualified_name", last_segment(F.col("qualified_name"))))).alias("name")).distinct()
    calls = edges.where("kind = 'calls'").select("source", "target")  # only edges that touch a result go on
    # the summaries come before the lists: rows with their lists are shuffled no more
    out = results.join(few(docs.select(F.col("file").alias("file_path"), "module_summary"), "summaries", SUMMARIES), "file_path", "left")
    sides = (("target", "source", "callers"), ("source", "target", "callees"))
    if most is not None and materialized(results.select("qualified_name").limit(ASKED + 1), "asked").count() > ASKED:
        out, sides = _with_nearest(out, calls, most), ()
    for side, other, as_ in sides:
        near = calls.join(names, calls[side] == names["name"]).select("qualified_name", F.col(other).alias("other"))
        if most is None:
            lists = near.groupBy("qualified_name").agg(F.sort_array(F.collect_set("other")).alias(as_)).withColumn(f"n_{as_}", F.size(as_).cast("long"))
        else:
            near = near.where("other IS NOT NULL").distinct()
            place = F.row_number().over(Window.partitionBy("qualified_name").orderBy("other"))
            first = near.withColumn("_n", place).where(F.col("_n") <= most)
            lists = first.groupBy("qualified_name").agg(F.sort_array(F.collect_list("other")).alias(as_))
            lists = lists.join(near.groupBy("qualified_name").agg(F.count("*").alias(f"n_{as_}")), "qualified_name")
        out = out.join(lists, "qualified_name", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("callers", "callees")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_callers", "n_callees")})
    rest = [c for c in results.columns if c not in ("file_path", "qualified_name")]
    return out.select("file_path", "qualified_name", *rest, "callers", "n_callers", "callees", "n_callees", "module_summary")
