"""Other homes of the same data: semantic documents as JSON files, a relational database, saved conversations, generated projects."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENTS


def semantic_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per JSON file; malformed files are left out, missing and null fields get their defaults."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.from_json("value", DOCUMENTS, {"mode": "PERMISSIVE"}).alias("d"))
    rows = text.select("d.*").where("file IS NOT NULL")
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("annotations", "unknowns", "insights", "odors")}
    strings = {c: F.coalesce(c, F.lit("")) for c in ("file_hash", "ingested_at", "source", "module_summary")}
    return rows.withColumns(empty | strings | {"module_roles": F.coalesce("module_roles", F.create_map().cast("map<string,string>"))})


def document_key(path: F.Column) -> F.Column:
    """The first 16 hex digits of the SHA-256 of a relative path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def project_schema(root: F.Column, prefix: str = "graph_") -> F.Column:
    """A database's schema name for a project: prefix and 8 hex digits."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(root, 256), 1, 8))


def database(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A relation of a database through JDBC, read in parts by ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key is not None:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def saved_conversation(raw: str) -> str:
    """JSON text with the time it was saved; what is not a JSON object becomes the text of one."""
    try:
        data = json.loads(raw)
    except ValueError:
        data = raw
    data = data if isinstance(data, dict) else {"text": data}
    return json.dumps({**data, "saved_at": datetime.now(timezone.utc).isoformat()}, ensure_ascii=False)


#: Weights of branch counts per function in each complexity profile.
PROFILES = {"flat": ((1, 1.0),), "typical": ((1, 0.6), (4, 0.25), (9, 0.1), (16, 0.05)), "complex": ((2, 0.3), (8, 0.3), (16, 0.25), (32, 0.15))}


def synthetic_project(spark: SparkSession, files: int = 1000, functions: int = 8, edge_density: float = 0.3, seed: int = 42, folders: int = 20, profile: str = "typical") -> DataFrame:
    """path, content of seeded Python files, made on the executors: functions with branches that call functions of other files."""
    weights, total = [], 0.0
    for branches, share in PROFILES[profile]:
        total += share
        weights.append((branches, total))
    draw = lambda *parts: F.pmod(F.xxhash64(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts]), F.lit(1_000_000)) / 1_000_000

    def function(i: F.Column) -> F.Column:
        b = F.lit(weights[-1][0])
        for branches, most in reversed(weights):
            b = F.when(draw(F.col("id"), i, seed) < most, branches).otherwise(b)
        body = F.repeat(F.lit("    if x:\n        x += 1\n"), b.cast("int"))
        other = F.floor(draw(F.col("id"), i, seed + 1) * files).cast("string")
        call = F.when(draw(F.col("id"), i, seed + 2) < edge_density, F.concat(F.lit("    f_"), other, F.lit("_0(x)\n"))).otherwise("")
        return F.concat(F.lit("def f_"), F.col("id").cast("string"), F.lit("_"), i.cast("string"), F.lit("(x):\n"), body, call, F.lit("    return x\n\n\n"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), function), "")
    path = F.concat(F.lit("pkg_"), (F.col("id") % folders).cast("string"), F.lit("/mod_"), F.col("id").cast("string"), F.lit(".py"))
    return spark.range(files).select(path.alias("path"), F.encode(text, "utf-8").alias("content"))
