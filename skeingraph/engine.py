"""One object over a session and a folder of relations: every operator as a method that returns a DataFrame."""

from __future__ import annotations

import json
import os
import tarfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas, segments
from .operators import analytics, documents, export, graph, lookup, search, stemmed, sync, usage
from .sources import changes, conversations, project, stores, watch
from .sources.languages import Registry, builtin
from .streaming import queries as streams


class Engine:
    """Relations live as Parquet under `home` (one folder per project), each write in folders of its own.

    A version is a small file that lists every relation's folders. It is created, never overwritten, after its folders are
    complete: readers and a failed ingest never see half of one, and of two writers at once the second fails.
    Files, symbols, edges, postings and adjacency are a log of segments: an ingest writes the changed files' rows alone.
    Documents and the query log grow by appended folders; `compact` makes one of all and removes old versions.
    """

    #: What grows by whole folders; all that comes from source files is in segments.
    NAMES = {"documents": schemas.DOCUMENTS + ", ingest_seq BIGINT", "query_log": schemas.QUERY_LOG, "embeddings": schemas.EMBEDDINGS}
    #: Results of searches that are kept in memory, the oldest giving way.
    KEPT = 256

    def __init__(self, spark: SparkSession, home: str, registry: Registry | None = None, encoder: Callable[[Column, int], Column] | None = search.hashed_embedding, log_every: int = 1):
        """encoder: a text column and a number of dimensions to a column of vectors; None: nothing is embedded, and searches go by text alone. log_every: how many searches are logged in one write."""
        self.spark, self.home, self.encoder = spark, home, encoder
        self.registry = registry or builtin()
        self.log = segments.Segments(spark, home)
        self._searches: dict[tuple, list] = {}
        self.log_every = log_every
        self._unlogged: list[tuple] = []

    # ------------------------------------------------------------ storage

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        """Numbers of the versions there are, newest first."""
        fs, p = self._fs(f"{self.home}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def _version(self) -> tuple[int, dict[str, list[str]]]:
        """The newest version that is whole."""
        for n in self._numbers():
            try:
                return n, json.loads("".join(r[0] for r in self.spark.read.text(f"{self.home}/versions/{n}.json", wholetext=True).collect()))
            except ValueError:  # its writer died
                continue
        return 0, {}

    def _segments(self) -> list[segments.Segment]:
        return segments.from_log(self._version()[1].get("segments", []))

    def table(self, name: str) -> DataFrame:
        if name in segments.RELATIONS:
            return self.log.live(name, self._segments())
        if name == "query_log":
            self.flush_log()
        at = self._version()[1].get(name)
        if not at:
            return self.spark.createDataFrame([], self.NAMES[name])
        return self.spark.read.schema(self.NAMES[name]).parquet(*(f"{self.home}/{a}" for a in at))

    def _store(self, name: str, df: DataFrame) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.NAMES[name]).schema]
        df.select(*columns).write.parquet(f"{self.home}/{at}")
        return at

    def _commit(self, seen: int, tables: dict[str, list[str]]) -> None:
        fs, p = self._fs(f"{self.home}/versions/{max([seen, *self._numbers()[:1]]) + 1}.json")
        if self._version()[0] != seen or fs.exists(p):
            raise RuntimeError("another writer was first: read again and write again")
        stream = fs.create(p, False)  # fails if it is there by now
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()

    def write(self, tables: dict[str, DataFrame]) -> None:
        """All of them or none, in the place of what they held."""
        seen, now = self._version()
        with ThreadPoolExecutor(4) as pool:  # relations are written side by side
            stored = list(pool.map(lambda item: self._store(*item), tables.items()))
        self._commit(seen, now | {name: [at] for name, at in zip(tables, stored, strict=True)})

    def append(self, name: str, rows: DataFrame) -> None:
        """Writes the new rows alone."""
        seen, now = self._version()
        self._commit(seen, now | {name: [*now.get(name, []), self._store(name, rows)]})

    def compact(self, keep: int = 1) -> None:
        """Documents and log in one folder each, all segments in one; versions but the newest `keep`, and folders that none of those lists, are removed."""
        self.write({n: self.table(n) for n in ("documents", "query_log")})
        seen, now = self._version()
        if len(now.get("segments", [])) > 1:
            whole = self.log.merge(self._segments(), len(now["segments"]))
            self._commit(seen, now | {"segments": segments.as_log(whole)})
        fs, home = self._fs(self.home)
        numbers = self._numbers()
        used = set()
        for n in numbers[:keep]:
            tables = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.home}/versions/{n}.json", wholetext=True).collect()))
            used |= {a for name, at in tables.items() if name != "segments" for a in at} | {a for x in tables.get("segments", []) for a in x["folders"].values()}
        for n in numbers[keep:]:
            fs.delete(self._fs(f"{self.home}/versions/{n}.json")[1], False)
        for x in fs.listStatus(home):
            if x.getPath().getName().rsplit("-", 1)[0] in {*self.NAMES, *segments.RELATIONS, "gone"} and x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)

    def init(self) -> None:
        self.write({n: self.spark.createDataFrame([], s) for n, s in self.NAMES.items() if n not in self._version()[1]})

    def uninit(self) -> None:
        fs, p = self._fs(self.home)
        fs.delete(p, True)

    def backup(self, to: str) -> None:
        """A local home as a compressed archive."""
        with tarfile.open(to, "w:gz") as t:
            t.add(self.home, arcname=".")

    def restore(self, archive: str) -> None:
        if os.path.exists(self.home):
            raise FileExistsError(self.home)
        with tarfile.open(archive) as t:
            t.extractall(self.home, filter="data")

    # ------------------------------------------------------------ ingest

    def index(self, root: str, analyze: bool = False, force: bool = False, drop_deleted: bool = True) -> DataFrame:
        """Scans and parses a tree (a local folder, or an address of any store that Spark reads), and stores what changed; returns path, status."""
        parsed = project.parse(self._sources(root), self.registry)
        parsed = graph.materialized(parsed, "parsed")
        return self.ingest(parsed, analyze, force, drop_deleted)

    def _sources(self, root: str) -> DataFrame:
        if "://" in root or root.startswith("file:/"):
            return project.stored(self.spark, root, self.registry).select("path", "content")
        return project.contents(project.scan(self.spark, root, self.registry), root)

    def ingest(self, parsed: DataFrame, analyze: bool = False, force: bool = False, drop_deleted: bool = False) -> DataFrame:
        """Writes a segment of what is new or changed, and marks what it replaces; then merges that are due."""
        rel = project.relations(parsed)
        state = self.table("files").select("path", "file_hash")
        read = rel["files"].where("fatal_error IS NULL")
        status = graph.materialized(sync.classify(read.select("path", F.col("file_hash").alias("content_hash")), state), "status")
        gone = sync.classify(rel["files"].select("path", F.col("file_hash").alias("content_hash")), state).where("status = 'deleted'") if drop_deleted else status.limit(0)
        new, out = segments.batch(state, rel | {"files": read}, status.where("status <> 'deleted'").unionAll(gone), force)
        self._extend(new, out)
        if analyze:
            self.save_documents(project.analysis_documents(rel, parsed))
        return status if drop_deleted else status.where("status <> 'deleted'")

    def _extend(self, new: dict[str, DataFrame], gone: DataFrame, forms: tuple[str, ...] | None = None) -> None:
        """forms: the relations that will be read of the log, where it is not all."""
        seen, now = self._version()
        added = self.log.write(new, gone, forms)
        if added.files + added.gone == 0:
            return
        self._commit(seen, now | {"segments": now.get("segments", []) + segments.as_log([added])})
        seen, now = self._version()
        settled = self.log.settled(before := segments.from_log(now["segments"]), forms)
        if settled != before:
            self._commit(seen, now | {"segments": segments.as_log(settled)})

    sync = index

    def ingest_paths(self, paths: DataFrame, root: str, analyze: bool = False) -> DataFrame:
        """Parses and stores only these files (path) of a tree; returns path, status."""
        parsed = graph.materialized(project.parse(project.contents(paths.select("path").distinct(), root), self.registry), "parsed")
        return self.ingest(parsed, analyze).join(paths.select("path").distinct(), "path", "left_semi")

    def watch(self, root: str, checkpoint: str, every: str | None = "2 seconds", analyze: bool = False):
        """Keeps the relations in step with a tree: each batch's new and changed files are ingested, deleted and moved ones leave. Stop it by the query's stop()."""
        listings = watch.tree(self.spark, root, sorted(self.registry.by_extension))
        return streams.tree_changes(listings, lambda df, _: self.follow(df, root, analyze), checkpoint, every)

    def follow(self, changes_: DataFrame, root: str, analyze: bool = False) -> None:
        """A batch of a tree's changes (path, change, was) into the relations; it may come again."""
        batch = graph.materialized(changes_, "batch")
        gone = batch.where("change = 'deleted'").select("path").unionAll(batch.where("change = 'moved'").select(F.col("was").alias("path")))
        if not gone.isEmpty():
            self._drop(gone)
        here = batch.where("change <> 'deleted'").select("path")
        if not here.isEmpty():
            self.ingest_paths(here, root, analyze)

    def feed(self, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second"):
        """A subscription to what changes: hands each new version's changes (version, relation, file_path, entity, kind, change) to apply, with the batch's number.

        Versions are files that are created once, so they are the source; where a subscriber is, its checkpoint says. Versions
        that were compacted away before a subscriber came to them are seen as one step. A batch may come again after a failure.
        """
        arrived = self.spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.home}/versions")
        names = arrived.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long").alias("version"))

        def step(df: DataFrame, n: int) -> None:
            out = None
            for v in sorted(r.version for r in df.distinct().collect()):  # the few of this batch
                older = [x for x in self._numbers() if x < v]
                before = next((s for s in map(self._segments_of, older) if s is not None), [])
                after = self._segments_of(v)
                if after is not None and segments.added(before, after):
                    part = self.log.changes(before, after).select(F.lit(v).alias("version"), "*")
                    out = part if out is None else out.unionAll(part)
            if out is not None:
                apply(out, n)

        writer = names.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()

    def _segments_of(self, version: int) -> list[segments.Segment] | None:
        """A version's segments; None: its writer died, or it is not there any more."""
        fs, p = self._fs(f"{self.home}/versions/{version}.json")
        for _ in range(20):
            if not fs.exists(p):
                return None
            try:
                return segments.from_log(json.loads("".join(r[0] for r in self.spark.read.text(p.toString(), wholetext=True).collect())).get("segments", []))
            except ValueError:  # still being written, or never to be whole
                if self._numbers()[0] > version:
                    return None
                time.sleep(0.1)
        return None

    def delete_files(self, paths: list[str]) -> None:
        self._drop(self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def _drop(self, paths: DataFrame) -> None:
        """A segment that holds nothing and takes these files out."""
        none = {n: self.spark.createDataFrame([], segments.RELATIONS[n]) for n in ("files", "symbols", "edges")}
        self._extend(none, paths.join(self.table("files").select("path"), "path", "left_semi").withColumn("deleted", F.lit(True)))

    # ------------------------------------------------------------ lookups, walks, search

    def files(self) -> DataFrame:
        return lookup.list_files(self.table("files"))

    def node(self, name: str, file_path: str | None = None) -> DataFrame:
        return lookup.node(self.table("symbols"), name, file_path)

    def symbols_for_file(self, path: str) -> DataFrame:
        return lookup.symbols_for_file(self.table("symbols"), path)

    def status(self) -> DataFrame:
        return lookup.stats(self.table("files"), self.table("symbols"), self.table("edges"), self.table("embeddings"))

    def callers(self, name: str, depth: int = 1, file_path: str | None = None) -> DataFrame:
        return graph.callers(self._calls(), name, depth, file_path)

    def callees(self, name: str, depth: int = 1, file_path: str | None = None) -> DataFrame:
        return graph.callees(self._calls(), name, depth, file_path)

    def impact(self, name: str, max_depth: int = 5) -> DataFrame:
        return graph.impact(self._calls(), name, max_depth)

    def diff(self, text: str, depth: int = 3) -> DataFrame:
        return self.affected(changes.changed_paths(self.spark.createDataFrame([(text,)], "diff string")), depth)

    def affected(self, changed: DataFrame | None = None, depth: int = 5, symbols_per_file: int | None = None, targets_per_symbol: int | None = None, paths: list[str] = (), root: str | None = None) -> DataFrame:
        """What changed files (path) and named paths lead to; absolute paths count from root, or by the known path they end in."""
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        all_ = named if changed is None else changed.select("path").unionAll(named)
        known = changes.known_paths(all_, self.table("files"), root)
        return graph.impact_of_files(self.table("symbols"), self._calls(), known, depth, symbols_per_file, targets_per_symbol)

    def neighbourhood(self, root: str, depth: int = 2, cap: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.neighbourhood_graph(self.table("symbols"), self._calls(), root, depth, cap)

    def discovery(self, root: str, depth: int = 2, cap: int = 500, branches: int = 20) -> dict[str, DataFrame]:
        """nodes, edges, branches and totals of a breadth-first walk that stops at cap symbols."""
        return graph.discovery(self.table("symbols"), self._calls(), root, depth, cap, branches)

    def shortest_path(self, source: str, target: str, max_rounds: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
        return graph.shortest_path(self._calls(), source, target, max_rounds, kinds)

    def full_graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.full_graph(self.table("symbols"), self.table("edges"))

    def layers(self) -> DataFrame:
        return graph.layers(self.table("symbols"))

    def _calls(self) -> graph.Adjacency:
        return graph.Adjacency(self.table("edges_out"), self.table("edges_in"), self.table("degrees"))

    def _index(self) -> search.Index:
        """The stored index; a search reads only the buckets of its terms."""
        return search.Index(self.table("search_docs"), self.table("postings"))

    def search(self, query: str, limit: int = 20, file_path: str | None = None, log: bool = False) -> DataFrame:
        """Ranked results with start lines. A search repeated over the same index is answered from memory; log: note what was found."""
        # as long as nothing is indexed anew
        key = (*(s.folders[n] for s in self._segments() for n in ("postings", "gone") if n in s.folders), query, limit, file_path)
        if key not in self._searches:
            found = lookup.with_start_lines(search.search(self._index(), query, limit, file_path), self.table("symbols")).orderBy("score", "rank", "id")
            schema = found.schema
            while len(self._searches) >= self.KEPT:
                self._searches.pop(next(iter(self._searches)))
            self._searches[key] = [schema, found.collect()]  # at most limit rows
        schema, rows = self._searches[key]
        if log:
            self.log_query("search", query, [r.qualified_name for r in rows])
        return self.spark.createDataFrame(rows, schema)

    def search_task(self, task: str, limit: int = 10, file_path: str | None = None) -> DataFrame:
        return search.search_words(self._index(), task, limit, file_path)

    def search_plain(self, query: str, limit: int = 20, file_path: str | None = None) -> DataFrame:
        """Symbols that have all words in any form in name or signature, the best first."""
        return stemmed.search_plain(self._index(), self.table("stems"), query, limit, file_path)

    def embed(self, dim: int = 384) -> None:
        """Stores an embedding of every symbol's name and signature."""
        if self.encoder is None:
            raise ValueError("this engine has no encoder")
        text = search.symbol_text(F.col("name"), F.col("signature"))
        self.write({"embeddings": self.table("symbols").select("qualified_name", "file_path", self.encoder(text, dim).alias("embedding"), F.lit(f"{self.encoder.__name__}-{dim}").alias("model_version")).dropDuplicates(["qualified_name", "file_path"])})

    def search_semantic(self, query: str, limit: int = 10, dim: int = 384) -> DataFrame:
        """Vectors and text together; text alone where nothing is embedded."""
        stored = self.table("embeddings").where(F.size("embedding") == dim)
        texts = self.search_task(query, limit)
        if self.encoder is None or stored.isEmpty():
            return texts.select("qualified_name", F.col("score").alias("combined"))
        v = self.spark.range(1).select(self.encoder(F.lit(f"query {query}"), dim).alias("v")).first()["v"]
        return search.hybrid(texts.select("qualified_name", "score"), search.vector_search(stored, v, limit).select("qualified_name", "similarity"))

    def rerank_semantic(self, query: str, limit: int = 10, dim: int = 384) -> DataFrame:
        """Text results that are embedded, joined by name and file, by the cosine of their vectors."""
        texts = self.search(query, 3 * limit).select("qualified_name", "file_path", "kind", "score")
        v = self.spark.range(1).select(self.encoder(F.lit(f"query {query}"), dim).alias("v")).first()["v"]
        return search.vector_search(texts.join(self.table("embeddings"), ["qualified_name", "file_path"]), v, limit)

    def context(self, task: str, limit: int = 10, most: int | None = 200) -> DataFrame:
        """Results with callers, callees (the first `most`, and how many there are) and summaries; hits: how often each was found before; relevance: its score over the best one's."""
        found = documents.context(self.search_task(task, limit), self.table("edges"), self.documents(), most)
        used = self.table("query_log").select(F.explode("symbols").alias("qualified_name")).groupBy("qualified_name").agg(F.count("*").alias("hits"))
        best = found.agg(F.max("score").alias("_best"))  # one row
        rows = found.join(used, "qualified_name", "left").crossJoin(F.broadcast(best))
        return rows.withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("relevance", F.try_divide("score", "_best")).drop("_best")

    # ------------------------------------------------------------ analytics, documents, usage

    def patterns(self) -> DataFrame:
        return analytics.patterns(self.table("symbols"), self.table("edges")).orderBy(F.desc("confidence"), "pattern", "symbol")

    def roles(self) -> DataFrame:
        return analytics.roles(self.table("symbols"), self.table("edges"))

    def documents(self) -> DataFrame:
        return documents.merge_documents(self.table("documents"))

    def save_documents(self, docs: DataFrame) -> None:
        """Adds versions; only they are written, and reading merges. The number of the engine's version orders them."""
        self.append("documents", docs.withColumn("ingest_seq", F.lit(self._version()[0] + 1).cast("long")))

    def annotate(self, file: str, symbol: str, summary: str, kind: str = "unknown", design_intent: str = "", pitfalls: str = "") -> None:
        row = [(file, [(symbol, kind, summary, design_intent, pitfalls)])]
        self.save_documents(self.spark.createDataFrame(row, "file string, annotations array<struct<symbol: string, kind: string, summary: string, design_intent: string, pitfalls: string>>"))

    def add_insight(self, file: str, insight: str, related: list[str] | None = None) -> None:
        self.save_documents(self.spark.createDataFrame([(file, [(insight, related or [])])], "file string, insights array<struct<insight: string, related_symbols: array<string>>>"))

    def add_unknown(self, file: str, symbol: str, question: str, context: str = "") -> None:
        self.save_documents(self.spark.createDataFrame([(file, [(symbol, question, context)])], "file string, unknowns array<struct<symbol: string, question: string, context: string>>"))

    def annotations(self, file: str | None = None, symbol: str | None = None) -> DataFrame:
        return documents.filter_annotations(documents.annotations_of(self.table("documents")), file, symbol)

    def unknowns(self, limit: int = 20) -> DataFrame:
        return documents.unknowns_ranked(documents.unknowns_of(self.table("documents")), self.table("edges"), limit)

    def insights(self, limit: int = 20) -> DataFrame:
        return documents.first_insights(documents.insights_of(self.table("documents")), limit)

    def coverage(self) -> DataFrame:
        return documents.coverage(self.table("documents"), self.table("files"), self.table("symbols"))

    def smells(self, file: str | None = None, severity: str | None = None) -> DataFrame:
        return analytics.filter_smells(documents.odors_of(self.table("documents")), file, severity)

    def metrics(self, file: str | None = None) -> DataFrame:
        return documents.complexity_rows(self.documents(), file)

    def ingest_conversation(self, text: str, file: str, tiers: list[Callable[[DataFrame], DataFrame]] | None = None) -> None:
        """Statements of a conversation as a document of the file; documents without annotation or summary are not kept.

        tiers: ways from texts (id, text) to statements, tried in turn until one finds any; the last by default is the patterns over the whole text.
        """
        rows = conversations.texts(self.spark.createDataFrame([(0, text)], "id int, json string"))
        for way in [*(tiers or []), conversations.statements]:
            said = graph.materialized(way(rows), "said")
            if not said.isEmpty():
                break
        found = documents.merge_documents(self._padded(conversations.statement_documents(said, file)))
        self.save_documents(found.where("size(annotations) > 0 OR module_summary <> ''"))

    def summarize(self, root: str) -> None:
        """A document with its summary for each file of a tree, without an index."""
        parsed = project.parse(self._sources(root), self.registry).where("fatal_error IS NULL")
        self.save_documents(parsed.select(F.col("path").alias("file"), F.col("content_hash").alias("file_hash"), F.lit("semantic-ingest").alias("source"), F.col("summary").alias("module_summary")))

    def file_semantics(self, file: str) -> DataFrame:
        """What a file's document says, in five columns: module_summary, annotations, unknowns, insights, module_roles; no row without a document."""
        return documents.merge_documents(self.table("documents").where(F.col("file") == file)).select("module_summary", "annotations", "unknowns", "insights", "module_roles")

    def start(self, root: str, enabled: bool = True, analyze: bool = False) -> dict:
        """Syncs if anything changed: {status: off, fresh, synced or error, ...}."""
        if not enabled:
            return {"status": "off"}
        try:
            stale = {r.status: r.n for r in self.freshness(root).where("status <> 'unchanged'").collect()}
            if not stale:
                return {"status": "fresh"}
            self.index(root, analyze)
            return {"status": "synced", **stale}
        except (OSError, ValueError, RuntimeError) as e:
            return {"status": "error", "error": str(e)}

    def tours(self, folder: str) -> DataFrame:
        """file, tour (JSON) of every JSON file in a folder; malformed ones are left out."""
        text = self.spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("tour"))
        return text.where("try_parse_json(tour) IS NOT NULL")

    def _padded(self, docs: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], self.NAMES["documents"]).schema
        return docs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def save_conversation(self, text: str, folder: str) -> str:
        """Keeps a conversation as a JSON file with the time it was saved; returns its path."""
        fs, p = self._fs(f"{folder}/conversation-{time.strftime('%Y%m%d-%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}.json")
        stream = fs.create(p, False)
        stream.write(bytearray(stores.saved_conversation(text).encode()))
        stream.close()
        return p.toString()

    def health(self) -> DataFrame:
        """One row: what there is, and whether it can be asked (healthy, or degraded without an index)."""
        counted = lookup.stats(self.table("files"), self.table("symbols"), self.table("edges"), self.table("embeddings"))
        return lookup.health(counted)

    def index_rate(self) -> DataFrame:
        return usage.index_rate(self.table("files"))

    def log_query(self, tool: str, query: str, symbols: list[str]) -> None:
        """Notes what was found; entries are written log_every at a time, and before anything reads the log."""
        self._unlogged.append((time.time(), tool, query, symbols))
        if len(self._unlogged) >= self.log_every:
            self.flush_log()

    def flush_log(self) -> None:
        if self._unlogged:
            rows, self._unlogged = self._unlogged, []
            self.append("query_log", changes.log_entry(self.spark.createDataFrame(rows, schemas.QUERY_LOG)))

    def hot_symbols(self, limit: int = 20) -> DataFrame:
        return usage.hot_symbols(self.table("query_log"), limit)

    def freshness(self, root: str) -> DataFrame:
        files = self._sources(root).where("content IS NOT NULL")
        disk = files.select("path", F.sha2("content", 256).alias("content_hash"))
        return sync.freshness(disk, self.table("files"))

    # ------------------------------------------------------------ exports

    def export_json(self, max_files: int = 50) -> DataFrame:
        return export.json_document(self.table("symbols"), self.table("edges"), max_files)

    def export_dot(self) -> DataFrame:
        return export.dot(self.table("symbols"), self.table("edges"))

    def export_lsif(self, root: str = ".") -> DataFrame:
        return export.lsif(self.table("files"), self.table("symbols"), self.table("edges"), root)
