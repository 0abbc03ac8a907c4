"""Queries: full-text, multi-word, vector and hybrid search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, lookup, search
from ..sources import star
from ..sources.star import oracle
from .registering import registrar

QUERIES, ORACLES, query = registrar()

TOKEN = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
FIELDS = ("name", "qualified_name", "signature", "kind")


def _bm25(phrases: list[list[str]], extra: str) -> str:
    """Common tables: d (documents), spots, s (phrase, doc, rank)."""
    fields = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {TOKEN.format(c=f)} AS terms FROM d" for f in FIELDS)
    spots = " UNION ALL ".join(
        f"SELECT {i} AS phrase, id, count(*) AS tf FROM p p0 {' '.join(f'JOIN p p{k} USING (id, field)' for k in range(1, len(ts)))} WHERE " + " AND ".join(f"p{k}.term = '{t}' AND p{k}.pos = p0.pos + {k}" for k, t in enumerate(ts)) + " GROUP BY id" for i, ts in enumerate(phrases)
    )
    return oracle(
        f""", d AS (SELECT * FROM symbols), f AS ({fields}), p AS MATERIALIZED (SELECT id, field, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM f),
        len AS (SELECT id, sum(len(terms)) AS length FROM f GROUP BY id), total AS (SELECT count(*) AS n, avg(length) AS mean FROM len), spots AS ({spots}),
        s AS (SELECT phrase, id, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM spots) JOIN len USING (id), total)
        {extra}"""
    )


def _score(rank: str, q: str) -> str:
    return f"{rank} - CASE WHEN lower(name) = {q} THEN 1000 WHEN starts_with(lower(name), {q}) THEN 500 WHEN contains(lower(name), {q}) THEN 200 ELSE 0 END + CASE kind WHEN 'class' THEN 0 WHEN 'interface' THEN 0 WHEN 'function' THEN 50 WHEN 'method' THEN 50 WHEN 'type_alias' THEN 80 WHEN 'variable' THEN 100 ELSE 110 END"


def _index(spark: SparkSession, d: str) -> search.Index:
    return search.of_symbols(star.symbols(spark, d))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_bm25([["brand", "1"]], "SELECT id, round(rank, 6) AS rank FROM s"))
def text_rank(spark, d):
    return _rounded(search.match(_index(spark, d), "brand_1").select("id", "rank"), "rank")


@query(_bm25([["widget"], ["class"]], "SELECT id, round(sum(rank), 6) AS rank FROM s GROUP BY id HAVING count(*) = 2"))
def text_all_words(spark, d):
    return _rounded(search.match(_index(spark, d), "Widget class").select("id", "rank"), "rank")


@query(_bm25([["supplier"]], f"SELECT id, round({_score('rank', chr(39) + 'supplier' + chr(39))}, 6) AS score FROM (SELECT * FROM s JOIN d USING (id) ORDER BY rank, id LIMIT 60) ORDER BY score, rank, id LIMIT 20"))
def text_search(spark, d):
    return _rounded(search.search(_index(spark, d), "supplier", 20).select("id", "score"), "score")


@query(_bm25([["class"]], f"SELECT id, round({_score('rank', chr(39) + 'class' + chr(39))}, 6) AS score FROM (SELECT * FROM s JOIN d USING (id) WHERE file_path = 'src/models/brand_11.py' ORDER BY rank, id LIMIT 60) ORDER BY score, rank, id LIMIT 5"))
def text_search_in_file(spark, d):
    return _rounded(search.search(_index(spark, d), "class", 5, "src/models/brand_11.py").select("id", "score"), "score")


@query(_bm25([["widget"], ["supplier"], ["brand", "1"]], "SELECT id, round(sum(rank), 6) AS rank FROM s GROUP BY id HAVING (bool_or(phrase = 0) OR bool_or(phrase = 1)) AND NOT bool_or(phrase = 2)"))
def text_expression(spark, d):
    """OR, NOT, quotes and parentheses."""
    return _rounded(search.match(_index(spark, d), '(widget OR supplier) NOT "brand 1"').select("id", "rank"), "rank")


def _near_sql(phrases: list[list[str]], far: int, tables: str = "") -> str:
    """NEAR by joining all places of all phrases: distance from the end of each to the start of the last."""
    n = len(phrases)
    occ = " UNION ALL ".join(
        f"SELECT {i} AS phrase, {len(ts)} AS n, p0.id, p0.field, p0.pos AS at_pos FROM p p0 {' '.join(f'JOIN p p{k} USING (id, field)' for k in range(1, len(ts)))} WHERE " + " AND ".join(f"p{k}.term = '{t}' AND p{k}.pos = p0.pos + {k}" for k, t in enumerate(ts)) for i, ts in enumerate(phrases)
    )
    last = f"greatest({', '.join(f'o{i}.at_pos' for i in range(n))})"
    cover = f"SELECT o0.id, o0.field, {', '.join(f'o{i}.at_pos AS s{i}' for i in range(n))} FROM occ o0 {' '.join(f'JOIN occ o{i} ON o{i}.id = o0.id AND o{i}.field = o0.field AND o{i}.phrase = {i}' for i in range(1, n))} WHERE o0.phrase = 0 AND " + " AND ".join(f"{last} - (o{i}.at_pos + o{i}.n) <= {far}" for i in range(n))
    spots = " UNION ALL ".join(f"SELECT {i} AS phrase, id, count(DISTINCT (field, s{i})) AS tf FROM cover GROUP BY id" for i in range(n))
    fields = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {TOKEN.format(c=f)} AS terms FROM d" for f in FIELDS)
    return oracle(
        f""", d AS (SELECT * FROM symbols), f AS ({fields}), p AS MATERIALIZED (SELECT id, field, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM f),
        len AS (SELECT id, sum(len(terms)) AS length FROM f GROUP BY id), total AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
        occ AS MATERIALIZED ({occ}), cover AS MATERIALIZED ({cover}), spots AS ({spots}),
        s AS (SELECT phrase, id, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM spots) JOIN len USING (id), total)
        SELECT id, round(sum(rank), 6) AS rank FROM s GROUP BY id"""
    )


@query(_near_sql([["ring"], ["economy"]], 2))
def text_near(spark, d):
    return _rounded(search.match(_index(spark, d), "NEAR(ring economy, 2)").select("id", "rank"), "rank")


@query(_near_sql([["class"], ["brand", "2"], ["widget"]], 2))
def text_near_phrases(spark, d):
    """Three phrases of several terms."""
    return _rounded(search.match(_index(spark, d), 'NEAR(class "brand 2" widget, 2)').select("id", "rank"), "rank")


@query(oracle("SELECT id FROM symbols WHERE kind = 'interface'"))
def text_in_field(spark, d):
    return search.match(_index(spark, d), "kind:interface").select("id")


@query(oracle("SELECT id FROM symbols WHERE kind = 'type' OR regexp_matches(lower(coalesce(signature, '') || ' ' || name || ' ' || qualified_name), '(^|[^a-z0-9])build[a-z0-9]*')"))
def text_prefix(spark, d):
    return search.match(_index(spark, d), "build* OR kind:type").select("id")


@query(oracle(", hit AS (SELECT qualified_name, kind FROM symbols), line AS (SELECT kind, qualified_name, arg_max(start_line, id) AS start_line FROM symbols GROUP BY 1, 2) SELECT qualified_name, kind, start_line FROM hit LEFT JOIN line USING (kind, qualified_name)"))
def results_with_lines(spark, d):
    s = star.symbols(spark, d)
    return lookup.with_start_lines(s.select("qualified_name", "kind"), s).select("qualified_name", "kind", "start_line")


def _packed(vectors: pd.Series, many: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.asarray(v[:n], "<f4").tobytes() for v, n in zip(vectors, many, strict=True)])


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id % 7 <> 3")
def stored_vectors(spark, d):
    """Vectors out of stored bytes; those of another length are left out."""
    blob = F.pandas_udf(_packed, "binary")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", blob("embedding", F.when(F.col("vec_id") % 7 == 3, 63).otherwise(64)).alias("blob"))
    vectors = rows.select("vec_id", search.decoded(F.col("blob"), 64).alias("v")).where("v IS NOT NULL")
    return vectors.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


_WORDS = ["brand", "widget", "supplier"]


@query(
    _bm25(
        [[w] for w in _WORDS],
        f""", w AS (SELECT * FROM (SELECT s.phrase, s.rank, d.*, row_number() OVER (PARTITION BY phrase ORDER BY rank, id) AS n FROM s JOIN d USING (id)) WHERE n <= 90),
        r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY {_score('rank', f'list_extract({_WORDS}, phrase + 1)')}, rank, id) AS place FROM w) WHERE place <= 30)
        SELECT qualified_name, CAST(count(*) AS DOUBLE) AS score, arg_min(id, (phrase, place)) AS id FROM r GROUP BY qualified_name ORDER BY score DESC, min((phrase, place)) LIMIT 10""",
    )
)
def task_search(spark, d):
    return search.search_words(_index(spark, d), "a brand of Widget by supplier", 10).select("qualified_name", "score", "id")


def _dots(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


_COS = f"CASE WHEN {_dots('v.embedding', 'v.embedding')} > 0 THEN {_dots('v.embedding', 'q.embedding')} / (sqrt({_dots('v.embedding', 'v.embedding')}) * sqrt({_dots('q.embedding', 'q.embedding')})) ELSE 0 END"


def _query_vector(spark, d) -> list[float]:
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 7").first()["embedding"]


@query(f"SELECT v.vec_id, round({_COS}, 6) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q")
def cosine_all(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    return vectors.select("vec_id", F.round(search.cosine(F.col("embedding"), q), 6).alias("similarity"))


@query(f"SELECT v.vec_id, round({_COS}, 6) AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_search(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    return _rounded(search.vector_search(vectors, _query_vector(spark, d), 10, key="vec_id").select("vec_id", "similarity"), "similarity")


@query(f"WITH v AS (SELECT 'v' || v.vec_id AS qualified_name, {_COS} AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY similarity DESC, vec_id LIMIT 30), t AS (SELECT 'v' || vec_id AS qualified_name, CAST(vec_id % 13 AS DOUBLE) AS score FROM embeddings WHERE vec_id % 5 = 0) SELECT coalesce(t.qualified_name, v.qualified_name) AS qualified_name, round(coalesce(0.4 * score / (SELECT max(score) FROM t), 0) + coalesce(0.6 * similarity / (SELECT max(similarity) FROM v), 0), 6) AS combined FROM t FULL JOIN v ON t.qualified_name = v.qualified_name")
def hybrid_search(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("qualified_name", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    texts = vectors.where("vec_id % 5 = 0").select("qualified_name", (F.col("vec_id") % 13).cast("double").alias("score"))
    found = search.vector_search(vectors, _query_vector(spark, d), 30, key="vec_id").select("qualified_name", "similarity")
    return _rounded(search.hybrid(texts, found), "combined")


#: CRC-32 byte by byte: the table, and of a text the number.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"


def crc_sql(text: str) -> str:
    """With the common table crc in scope."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda j: CAST('0x' || substr(hex(encode({text})), 2 * j + 1, 2) AS BIGINT))), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])), 4294967295)"


def embedded_sql(rows: str, dim: int, name: str) -> str:
    """Common tables {name} (id, b, v): the hashed terms of rows (id, text), each different term hashed once; needs crc."""
    return f"""{name}_t AS (SELECT id, unnest({TOKEN.format(c="text")}) AS term FROM ({rows})), {name}_h AS (SELECT term, {crc_sql("term")} AS h FROM (SELECT DISTINCT term FROM {name}_t), crc),
    {name} AS MATERIALIZED (SELECT id, h % {dim} AS b, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_t JOIN {name}_h USING (term) GROUP BY 1, 2)"""


def cosine_sql(a: str, b: str) -> str:
    """a_id, b_id, similarity of all pairs that share anything."""
    return f"SELECT a.id AS a_id, b.id AS b_id, sum(a.v * b.v) / sqrt(any_value(na) * any_value(nb)) AS similarity FROM {a} a JOIN {b} b USING (b) JOIN (SELECT id, sum(v * v) AS na FROM {a} GROUP BY 1) x ON x.id = a.id JOIN (SELECT id, sum(v * v) AS nb FROM {b} GROUP BY 1) y ON y.id = b.id WHERE na > 0 AND nb > 0 GROUP BY 1, 2"


@query(oracle(f""", {CRC_TABLE}, {embedded_sql("SELECT id, name || coalesce(': ' || signature, '') AS text FROM symbols", 64, "e")}, {embedded_sql("SELECT 0 AS id, 'query widget brand' AS text", 64, "q")}, c AS ({cosine_sql("e", "q")}) SELECT symbols.id, round(coalesce(similarity, 0), 5) + 0.0 AS similarity FROM symbols LEFT JOIN c ON a_id = symbols.id"""))
def encoded_similarity(spark, d):
    """Every symbol's cosine to a query, by hashed embeddings of their texts."""
    s = star.symbols(spark, d)
    q = F.array(*[F.lit(x) for x in spark.range(1).select(search.hashed_embedding(F.lit("query widget brand"), 64).alias("e")).first()["e"]])
    rows = s.select("id", search.hashed_embedding(search.symbol_text(F.col("name"), F.col("signature")), 64).alias("e"))
    return rows.select("id", (F.round(search.cosine(F.col("e"), q), 5) + F.lit(0.0)).alias("similarity"))


@query()
def encoded_search(spark, d):
    """Symbols by the cosine of hashed embeddings of their texts."""
    s = star.symbols(spark, d)
    stored = s.select("qualified_name", search.hashed_embedding(search.symbol_text(F.col("name"), F.col("signature")), 64).alias("embedding"))
    q = spark.range(1).select(search.hashed_embedding(F.lit("query widget brand"), 64).alias("e")).first()["e"]
    return search.vector_search(stored, q, 10)


@query(oracle(""", r AS (SELECT qualified_name, file_path FROM symbols), n AS (SELECT DISTINCT qualified_name, unnest([qualified_name, split_part(qualified_name, '.', -1)]) AS name FROM symbols),
    up AS (SELECT qualified_name, string_agg(DISTINCT source, ',' ORDER BY source) AS callers FROM n JOIN calls ON target = name GROUP BY 1), down AS (SELECT qualified_name, string_agg(DISTINCT target, ',' ORDER BY target) AS callees FROM n JOIN calls ON source = name GROUP BY 1)
    SELECT qualified_name, md5(coalesce(callers, '')) AS callers, md5(coalesce(callees, '')) AS callees, CASE WHEN symbol_count > 3 THEN 'about ' || file_path END AS module_summary FROM r LEFT JOIN up USING (qualified_name) LEFT JOIN down USING (qualified_name) JOIN files ON path = file_path"""))
def task_context(spark, d):
    s = star.symbols(spark, d).select("qualified_name", "file_path")
    docs = star.files(spark, d).where("symbol_count > 3").select(F.col("path").alias("file"), F.concat(F.lit("about "), "path").alias("module_summary"))
    rows = documents.context(s, star.edges(spark, d), docs)
    return rows.select("qualified_name", F.md5(F.array_join("callers", ",")).alias("callers"), F.md5(F.array_join("callees", ",")).alias("callees"), "module_summary")


_FEW = "list_slice(list_sort(list(DISTINCT {c})), 1, 3)"


@query(oracle(f""", n AS (SELECT DISTINCT qualified_name, unnest([qualified_name, split_part(qualified_name, '.', -1)]) AS name FROM symbols),
    up AS (SELECT qualified_name, count(DISTINCT source) AS n_callers, array_to_string({_FEW.format(c='source')}, ',') AS callers FROM n JOIN calls ON target = name GROUP BY 1), down AS (SELECT qualified_name, count(DISTINCT target) AS n_callees, array_to_string({_FEW.format(c='target')}, ',') AS callees FROM n JOIN calls ON source = name GROUP BY 1)
    SELECT s.id, coalesce(n_callers, 0) AS n_callers, coalesce(callers, '') AS callers, coalesce(n_callees, 0) AS n_callees, coalesce(callees, '') AS callees FROM symbols s LEFT JOIN up USING (qualified_name) LEFT JOIN down USING (qualified_name)"""))
def bounded_context(spark, d):
    """Of each symbol the first three callers and callees, and how many there are."""
    s = star.symbols(spark, d).select("id", "qualified_name", "file_path")
    docs = star.files(spark, d).select(F.col("path").alias("file"), F.lit("").alias("module_summary"))
    rows = documents.context(s, star.edges(spark, d), docs, most=3)
    return rows.select("id", "n_callers", F.array_join("callers", ",").alias("callers"), "n_callees", F.array_join("callees", ",").alias("callees"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hashes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
