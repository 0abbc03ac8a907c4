"""The star schema seen as a code graph: one SQL text per canonical relation, valid in Spark and in DuckDB alike.

Customers are functions, their orders methods, parts classes, suppliers interfaces, nations types, regions
variables; orders call parts (through line items), parts their suppliers, and suppliers a part, which makes cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

SYMBOLS = """
SELECT CAST(r_regionkey AS BIGINT) AS id, 'src/config/regions.py' AS file_path, r_name AS name, concat('region_', CAST(r_regionkey AS STRING)) AS qualified_name, 'variable' AS kind, CAST(NULL AS STRING) AS parent_symbol, CAST(NULL AS STRING) AS signature, CAST(r_regionkey % 1000 AS INT) AS start_line FROM region
UNION ALL
SELECT 1000 + n_nationkey, concat('src/schemas/region_', CAST(n_regionkey AS STRING), '.ts'), n_name, concat('nation_', CAST(n_nationkey AS STRING)), 'type', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(n_nationkey % 1000 AS INT) FROM nation
UNION ALL
SELECT 1000000000 + s_suppkey, concat('src/services/nation_', CAST(s_nationkey AS STRING), '.go'), s_name, concat('supplier_', CAST(s_suppkey AS STRING)), 'interface', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(s_suppkey % 1000 AS INT) FROM supplier
UNION ALL
SELECT 2000000000 + p_partkey, concat('src/models/', lower(replace(p_brand, '#', '_')), '.py'), p_name, concat('part_', CAST(p_partkey AS STRING)), 'class', p_type, concat('class ', p_name, ' ', p_brand, ' ', p_type), CAST(p_partkey % 1000 AS INT) FROM part
UNION ALL
SELECT 3000000000 + c_custkey, concat('src/handlers/', lower(c_mktsegment), '.py'), c_name, concat('customer_', CAST(c_custkey AS STRING)), 'function', CAST(NULL AS STRING), concat('def ', c_name, '(segment) -> ', c_mktsegment, ':'), CAST(c_custkey % 1000 AS INT) FROM customer
UNION ALL
SELECT 4000000000 + o_orderkey, concat('src/orders/status_', lower(o_orderstatus), '.java'), concat('order_', CAST(o_orderkey AS STRING)), concat('customer_', CAST(o_custkey AS STRING), '.order_', CAST(o_orderkey AS STRING)), 'method', concat('customer_', CAST(o_custkey AS STRING)), concat('def order(self) -> part_', CAST(o_orderkey % 200 AS STRING), ':'), CAST(o_orderkey % 1000 AS INT) FROM orders
"""

EDGES = """
SELECT concat('order_', CAST(l_orderkey AS STRING)) AS source, concat('part_', CAST(l_partkey AS STRING)) AS target, 'calls' AS kind, 'src/orders/lines.java' AS source_file, CAST(l_linenumber AS INT) AS source_line FROM lineitem
UNION ALL
SELECT DISTINCT concat('part_', CAST(l_partkey AS STRING)), concat('supplier_', CAST(l_suppkey AS STRING)), 'calls', 'src/models/parts.py', CAST(l_partkey % 1000 AS INT) FROM lineitem
UNION ALL
SELECT concat('supplier_', CAST(s_suppkey AS STRING)), concat('part_', CAST((7 * s_suppkey) % (SELECT count(*) FROM part) AS STRING)), 'calls', concat('src/services/nation_', CAST(s_nationkey AS STRING), '.go'), 1 FROM supplier
UNION ALL
SELECT concat('customer_', CAST(c_custkey AS STRING)), concat('nation_', CAST(c_nationkey AS STRING)), 'extends', concat('src/handlers/', lower(c_mktsegment), '.py'), 1 FROM customer
UNION ALL
SELECT concat('supplier_', CAST(s_suppkey AS STRING)), concat('nation_', CAST(s_nationkey AS STRING)), 'extends', concat('src/services/nation_', CAST(s_nationkey AS STRING), '.go'), 1 FROM supplier
UNION ALL
SELECT concat('nation_', CAST(n_nationkey AS STRING)), concat('region_', CAST(n_regionkey AS STRING)), 'imports', concat('src/schemas/region_', CAST(n_regionkey AS STRING), '.ts'), 1 FROM nation
"""

USES = {"symbols": ("region", "nation", "supplier", "part", "customer", "orders"), "edges": ("lineitem", "part", "supplier", "customer", "nation")}


def _run(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    # names of DataFrame arguments stand in braces in the text
    marked = reduce(lambda s, t: __import__("re").sub(rf"\b(FROM) {t}\b", rf"\1 {{{t}}}", s), tables, text)
    return spark.sql(marked, **frames)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SYMBOLS, USES["symbols"])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, EDGES, USES["edges"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, file_hash and what the file holds."""
    from pyspark.sql import functions as F

    s = symbols(spark, sf_dir).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbol_count"))
    e = edges(spark, sf_dir).groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("edge_count"))
    ext = F.substring_index("path", ".", -1)
    language = F.when(ext == "py", "python").when(ext == "ts", "typescript").when(ext == "go", "go").otherwise("java")
    return s.join(e, "path", "left").select("path", language.alias("language"), F.sha2("path", 256).alias("file_hash"), F.lit(None).cast("timestamp").alias("last_indexed"), "symbol_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.lit(0).alias("error_count"))


def oracle(body: str, recursive: bool = False) -> str:
    """A DuckDB query over symbols, edges, files and calls (distinct pairs)."""
    s, e = (t.replace("AS STRING)", "AS VARCHAR)") for t in (SYMBOLS, EDGES))
    files_ = """SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' ELSE 'java' END AS language, sha256(path) AS file_hash, symbol_count, coalesce(edge_count, 0) AS edge_count, 0 AS error_count
FROM (SELECT file_path AS path, count(*) AS symbol_count FROM symbols GROUP BY 1) LEFT JOIN (SELECT source_file AS path, count(*) AS edge_count FROM edges GROUP BY 1) USING (path)"""
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} symbols AS MATERIALIZED ({s}), edges AS MATERIALIZED ({e}), files AS ({files_}), calls AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls') {body}"
