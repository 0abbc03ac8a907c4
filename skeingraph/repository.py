"""Semantic documents as four flat relations behind one interface, whatever keeps them."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import documents

KEYS = {"annotations": ["file", "symbol"], "unknowns": ["file", "symbol", "question"], "insights": ["file", "place"], "modules": ["file"]}


class Repository(ABC):
    """A home of versions of semantic documents: subclasses read and add them, everything else follows."""

    @abstractmethod
    def versions(self) -> DataFrame:
        """Every version of every document, with ingest_seq."""

    @abstractmethod
    def save(self, docs: DataFrame) -> None:
        """Adds versions."""

    def relation(self, name: str, file: str | None = None) -> DataFrame:
        """One of KEYS, of all files or one, in the order of its key."""
        if name not in KEYS:
            raise ValueError(f"no such relation: {name}")
        docs = self.versions() if file is None else self.versions().where(F.col("file") == file)
        if name == "modules":
            rows = documents.merge_documents(docs).select("file", "file_hash", "ingested_at", "source", "module_summary", "metrics", "module_roles")
        else:
            rows = {"annotations": documents.annotations_of, "unknowns": documents.unknowns_of, "insights": documents.insights_of}[name](docs)
        return rows.orderBy(*KEYS[name])

    def annotation(self, file: str, symbol: str) -> DataFrame:
        """One row, or none."""
        return documents.filter_annotations(self.relation("annotations", file), file, symbol)

    def module(self, file: str) -> DataFrame:
        """One row, or none."""
        return self.relation("modules", file)


class Versions(Repository):
    """Documents in an engine's own storage."""

    def __init__(self, engine):
        self.engine = engine

    def versions(self) -> DataFrame:
        return self.engine.table("documents")

    def save(self, docs: DataFrame) -> None:
        self.engine.save_documents(docs)


class JsonFiles(Repository):
    """A folder with one JSON file for each document; what is saved goes as JSON lines into its folder `added`."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        from .schemas import DOCUMENTS
        from .sources.stores import semantic_documents

        added = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/added")
        fs = added.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(added.getParent()):
            return self.spark.createDataFrame([], DOCUMENTS + ", ingest_seq BIGINT")
        docs = semantic_documents(self.spark, self.path)
        if fs.exists(added):
            docs = docs.unionByName(self.spark.read.schema(DOCUMENTS).json(f"{self.path}/added"))
        return docs.withColumn("ingest_seq", F.coalesce(F.unix_micros(F.expr("try_to_timestamp(ingested_at)")), F.lit(0).cast("long")))

    def save(self, docs: DataFrame) -> None:
        text = docs.withColumn("ingested_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        text.write.mode("append").json(f"{self.path}/added")


class Tables(Repository):
    """Four tables of a database through JDBC, read only."""

    def __init__(self, spark, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def versions(self) -> DataFrame:
        from .sources.stores import database

        flat = [database(self.spark, self.url, t, **self.options) for t in ("annotations", "unknowns", "insights", "modules")]
        return documents.from_relations(*flat).withColumn("ingest_seq", F.lit(1).cast("long"))

    def save(self, docs: DataFrame) -> None:
        raise NotImplementedError("a database is read only here")


def repository(spark, at: str, engine=None, **options: str) -> Repository:
    """By where it is: a JDBC address, an engine's home, or a folder of JSON files."""
    if at.startswith("jdbc:"):
        return Tables(spark, at, **options)
    return Versions(engine) if engine is not None and at == engine.home else JsonFiles(spark, at)
