"""Plain-text search by English stems over stored postings: a dictionary of stems leads to the terms that are looked up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import STOP, stems
from .search import Index, bucket, tokens

#: Fixed values of the rank: weight of a lexeme, and how a pair's distance counts (0 beyond FAR).
WEIGHT, NEAR, STEP, SCALE, SHIFT, FAR, NOTHING = 0.1, 1.005, 0.05, 1.5, 2.0, 100, 1e-30
SQUARES = 1.64493406685
FIELDS = ("symbol_name", "signature")


def dictionary(postings: DataFrame) -> DataFrame:
    """bucket, stem, term of all terms of the fields that are searched; stop words have none."""
    terms = postings.where(F.col("field").isin(*FIELDS)).select("term").distinct().where(~F.col("term").isin(*STOP))
    return stems(terms).select(bucket(F.col("stem")).alias("bucket"), "stem", "term")


def words(query: str) -> list[str]:
    """Different words of a query but stop words, in order."""
    return [w for w in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())) if w not in STOP]


def lexemes(index: Index, by_stem: DataFrame, query: str) -> tuple[DataFrame, int]:
    """doc, stem, at of every place of a query's stems in name and signature one after the other, and how many stems it has.

    The dictionary and then the postings are read in the buckets that the query needs alone.
    """
    spark = index.docs.sparkSession
    asked = stems(spark.createDataFrame([(w,) for w in words(query)], "term string")).select("stem").distinct()
    wanted = sorted(r.stem for r in asked.collect())  # a few words
    if not wanted:
        return spark.createDataFrame([], "doc long, stem string, at int"), 0
    terms = by_stem.where(F.col("stem").isin(wanted) & F.col("bucket").isin([r[0] for r in asked.select(bucket(F.col("stem"))).distinct().collect()])).select("stem", "term").distinct()
    heads = sorted(r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect())  # numbers of buckets
    spots = index.postings.where(F.col("bucket").isin(heads) & F.col("field").isin(*FIELDS)).join(terms, "term").select("doc", "stem", "field", "pos")
    # what the signature's places begin with: the name's number of terms
    named = index.docs.select(F.col("id").alias("doc"), F.size(tokens(F.col("symbol_name"))).alias("_name"))
    placed = spots.join(named, "doc").select("doc", "stem", (F.col("pos") + F.when(F.col("field") == "signature", F.col("_name")).otherwise(0) + 1).alias("at"))
    return placed, len(wanted)


def rank(places: DataFrame, wanted: int) -> DataFrame:
    """doc, rank of the documents that have all stems; higher is better.

    One stem: a weight over the squares of its places' numbers. Several: each pair of places of two stems is a chance, the less the further
    apart they are, and the rank is the chance of any.
    """
    whole = places.groupBy("doc").agg(F.count_distinct("stem").alias("n"), F.count("*").alias("tf")).where(F.col("n") == wanted)
    if wanted < 2:
        squares = F.aggregate(F.sequence(F.lit(1), F.col("tf").cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
        return whole.select("doc", (WEIGHT * squares / SQUARES).alias("rank"))
    own = places.join(whole.select("doc"), "doc", "left_semi")
    a, b = own.select("doc", F.col("stem").alias("s"), F.col("at").alias("x")), own.select("doc", F.col("stem").alias("t"), F.col("at").alias("y"))
    far = F.abs(F.col("x") - F.col("y"))
    chance = F.sqrt(WEIGHT * WEIGHT * F.when(far > FAR, NOTHING).otherwise(1.0 / (NEAR + STEP * F.exp(far / SCALE - SHIFT))))
    pairs = a.join(b, "doc").where("s < t").groupBy("doc").agg(F.sum(F.log1p(-chance)).alias("none"))
    return pairs.select("doc", (-F.expm1("none")).alias("rank"))


def search_plain(index: Index, by_stem: DataFrame, query: str, limit: int = 20, file_path: str | None = None) -> DataFrame:
    """The limit best symbols that have all of a query's words in some form in name or signature, ties to the smaller id; nothing for stop words alone."""
    places, n = lexemes(index, by_stem, query)
    found = index.docs.drop("length").join(rank(places, n).withColumnRenamed("doc", "id"), "id") if n else index.docs.drop("length").withColumn("rank", F.lit(0.0)).limit(0)
    if file_path is not None:
        found = found.where(F.col("file_path") == file_path)
    return found.orderBy(F.desc("rank"), "id").limit(limit)
