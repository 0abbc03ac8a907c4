"""Ranked full-text search over an inverted index, re-ranking, multi-word search, vectors and their mixture."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking: BM25's constants, boosts by name, penalties by kind.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
EXACT, PREFIX, PART = 1000.0, 500.0, 200.0
KIND_PENALTY = {"class": 0.0, "interface": 0.0, "function": 50.0, "method": 50.0, "type_alias": 80.0, "variable": 100.0}
OTHER_PENALTY = 110.0
FIELDS = ("symbol_name", "qualified_name", "signature", "kind")
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an underscore separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


#: Postings are stored under so many buckets, by the first two characters of the term (so that prefixes prune, too).
BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


class Index:
    """postings (bucket, term, doc, field, pos) of a table with id, FIELDS and file_path; docs: the table and each row's length."""

    def __init__(self, docs: DataFrame, postings: DataFrame):
        self.docs, self.postings = docs, postings

    def totals(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))


def index(rows: DataFrame) -> Index:
    """The index of rows, not yet computed: to search it often, store docs, and postings partitioned by bucket."""
    docs = rows.withColumn("length", sum((F.size(tokens(F.col(f))) for f in FIELDS), F.lit(0)))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in FIELDS])).alias("f")
    own = ["file_path"] if "file_path" in rows.columns else []
    flat = rows.select(F.col("id").alias("doc"), *own, pairs)
    postings = flat.select("doc", *own, F.col("f.field").alias("field"), F.posexplode("f.terms").alias("pos", "term"))
    return Index(docs, postings.withColumn("bucket", bucket(F.col("term"))))


def of_symbols(symbols: DataFrame) -> Index:
    return index(symbols.select("id", F.col("name").alias("symbol_name"), "qualified_name", "signature", "kind", "file_path"))


#: Names of the fields in queries.
FIELD_NAMES = {"symbol_name": "symbol_name", "name": "symbol_name", "qualified_name": "qualified_name", "signature": "signature", "kind": "kind"}
#: Fixed value: how far apart NEAR's phrases may be where it does not say.
NEAR_TERMS = 10
_LEXEME = re.compile(r'\s*(?:(?P<near>NEAR\s*\()|(?P<comma>,)|(?P<open>\()|(?P<close>\))|(?P<field>\w+)\s*:\s*|(?P<quoted>"[^"]*"\*?)|(?P<word>[^\s()":,]+))')


def parse(query: str) -> tuple[list[tuple[list[str], bool, str | None]], object]:
    """A query's phrases (terms, whether the last is a prefix, the field or None), and how they must match.

    Words and "quoted phrases" are phrases of terms (an underscore separates); a final * makes the last term a prefix;
    `field:` before one restricts it. NEAR(phrases, n) asks for all of them in one field with at most n terms (NEAR_TERMS)
    between the end of the first and the start of the last. AND (or nothing) binds stronger than OR, NOT leaves out what follows;
    parentheses group. The second value is a number of a phrase, ("near", numbers, n), or ("and" | "or" | "not", left, right);
    None: nothing is asked for.
    """
    lexemes, at = [], 0
    while query[at:].strip():
        m = _LEXEME.match(query, at)
        if m is None:
            raise ValueError(f"not understood in a query: {query[at:]}")
        lexemes.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    found: list[tuple[list[str], bool, str | None]] = []
    lexemes.reverse()

    def peek(*words: str) -> bool:
        return bool(lexemes) and lexemes[-1][0] == "word" and lexemes[-1][1] in words

    def one(field: str | None = None):
        kind, text = lexemes.pop() if lexemes else ("end", "")
        if kind == "open":
            inner = either()
            if not lexemes or lexemes.pop()[0] != "close":
                raise ValueError(f"a parenthesis is not closed: {query}")
            return inner
        if kind == "field":
            if text not in FIELD_NAMES:
                raise ValueError(f"no such field: {text}")
            return one(FIELD_NAMES[text])
        if kind == "near":
            return near(field)
        if kind == "comma" and lexemes:  # between words it says nothing
            return one(field)
        if kind not in ("word", "quoted") or kind == "word" and text in ("AND", "OR", "NOT", "NEAR"):
            raise ValueError(f"not supported in a query: {text or query}")
        terms = [t.lower() for t in re.findall(r"[^\W_]+", text)]
        if not terms:
            return None
        found.append((terms, text.endswith("*"), field))
        return len(found) - 1

    def near(field: str | None):
        inner, far = [], NEAR_TERMS
        while lexemes and lexemes[-1][0] in ("word", "quoted"):
            inner.append(one(field))
        if lexemes and lexemes[-1][0] == "comma":
            lexemes.pop()
            kind, text = lexemes.pop() if lexemes else ("end", "")
            if kind != "word" or not text.isdigit():
                raise ValueError(f"NEAR asks for a number after the comma: {query}")
            far = int(text)
        if not lexemes or lexemes.pop()[0] != "close":
            raise ValueError(f"NEAR is not closed: {query}")
        inner = [i for i in inner if i is not None]
        return ("near", tuple(inner), far) if len(inner) > 1 else inner[0] if inner else None

    def joined(op: str, a, b):
        return (b if op != "not" else None) if a is None else a if b is None else (op, a, b)

    def all_of():
        tree = one()
        while lexemes and lexemes[-1][0] != "close" and not peek("OR"):
            if lexemes[-1][0] == "comma":
                lexemes.pop()
                continue
            op = "and"
            if peek("AND", "NOT"):
                op = lexemes.pop()[1].lower()
            tree = joined(op, tree, one())
        return tree

    def either():
        tree = all_of()
        while peek("OR"):
            lexemes.pop()
            tree = joined("or", tree, all_of())
        return tree

    tree = either() if lexemes else None
    if lexemes:
        raise ValueError(f"not understood in a query: {query}")
    return found, tree


def holds(tree, met: Column) -> Column:
    """Whether the phrases met (their numbers) fulfil a query."""
    if isinstance(tree, int):
        return F.array_contains(met, tree)
    op, a, b = tree
    if op == "near":  # its phrases are only met where they are near
        return holds(a[0], met)
    left, right = holds(a, met), holds(b, met)
    return left & right if op == "and" else left | right if op == "or" else left & ~right


def phrase_spots(index: Index, wanted: list[tuple[int, list[str], bool, str | None]]) -> DataFrame:
    """phrase, n, doc, field, at for numbered phrases: each place where all n terms of one stand in a row in a field.

    Of stored postings only the buckets of the query's terms are read (all for a prefix of one character).
    """
    spark = index.docs.sparkSession
    rows = [(p, i, t, i == len(terms) - 1 and prefix, len(terms), only) for p, terms, prefix, only in wanted for i, t in enumerate(terms)]
    schema = "phrase int, place int, want string, prefix boolean, n int, only string"
    postings = index.postings
    if all(len(t) > 1 or not prefix for _, _, t, prefix, _, _ in rows):
        heads = spark.createDataFrame([(r[2],) for r in rows], "t string").select(bucket(F.col("t")).alias("b")).distinct().collect()  # a few words
        postings = postings.where(F.col("bucket").isin([r.b for r in heads]))
    asked = F.broadcast(spark.createDataFrame(rows, schema))
    same = F.col("term") == F.col("want")
    if any(r[3] for r in rows):
        same = F.when(F.col("prefix"), F.startswith("term", "want")).otherwise(same)
    joined = postings.join(asked, same).where("only IS NULL OR only = field")
    spots = joined.groupBy("phrase", "n", "doc", "field", (F.col("pos") - F.col("place")).alias("at")).agg(F.count_distinct("place").alias("met"))
    return spots.where("met = n").drop("met")


def phrase_hits(index: Index, wanted: list[tuple[int, list[str], bool, str | None]]) -> DataFrame:
    """phrase, doc, tf for numbered phrases: how often each stands in a document."""
    return phrase_spots(index, wanted).groupBy("phrase", "doc").agg(F.count("*").alias("tf"))


def near_spots(spots: DataFrame, phrases: tuple[int, ...], far: int) -> DataFrame:
    """Of spots (phrase, n, doc, field, at) those of the phrases that are part of a cover.

    A cover has a place of each phrase in one field, and at most far terms between the end of any and the start of the last one. One
    pass over a field's places in order finds, for each place, whether it ends a cover (of each other phrase the last place before it is near
    enough), and then whether a cover of another phrase's end follows that is near enough.
    """
    own = spots.where(F.col("phrase").isin(*phrases))
    before = Window.partitionBy("doc", "field").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("doc", "field").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    # of each phrase the last place so far, as where its end lies: the one that reaches furthest
    ends = [F.max(F.when(F.col("phrase") == p, F.col("at") + F.col("n"))).over(before) for p in phrases]
    closed = own.withColumn(
        "_closes", reduce(lambda a, b: a & b, [F.coalesce((F.col("phrase") == p) | (F.col("at") - e <= far), F.lit(False)) for p, e in zip(phrases, ends, strict=True)])
    )
    nexts = F.array(*[F.min(F.when(F.col("_closes") & (F.col("phrase") == p), F.col("at"))).over(after) for p in phrases])
    others = F.array_min(F.array_compact(F.transform(F.filter(F.arrays_zip(F.array(*map(F.lit, phrases)).alias("p"), nexts.alias("a")), lambda x: x["p"] != F.col("phrase")), lambda x: x["a"])))
    found = closed.withColumn("_in", F.col("_closes") | F.coalesce(others - (F.col("at") + F.col("n")) <= far, F.lit(False)))
    return found.where("_in").drop("_closes", "_in")


def near_groups(tree) -> list[tuple[tuple[int, ...], int]]:
    if not isinstance(tree, tuple):
        return []
    return [(tree[1], tree[2])] if tree[0] == "near" else near_groups(tree[1]) + near_groups(tree[2])


def bm25(index: Index, hits: DataFrame) -> DataFrame:
    """phrase, doc, rank: the negative BM25 of each phrase, so lower is better."""
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))  # a row for each phrase of the query
    scored = hits.join(index.docs.select(F.col("id").alias("doc"), "length"), "doc").join(F.broadcast(df), "phrase")
    scored = scored.crossJoin(F.broadcast(index.totals()))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return scored.select("phrase", "doc", (-idf * tf).alias("rank"))


def match(index: Index, query: str, file_path: str | None = None) -> DataFrame:
    """All documents that fulfil the query, with their rank: the sum over its phrases that they hold."""
    asked, tree = parse(query)
    if tree is None:
        return index.docs.drop("length").withColumn("rank", F.lit(0.0)).limit(0)
    spots = phrase_spots(index, [(i, *p) for i, p in enumerate(asked)])
    groups = near_groups(tree)
    if groups:
        alone = spots.where(~F.col("phrase").isin(*[p for g, _ in groups for p in g]))
        spots = reduce(DataFrame.unionByName, [near_spots(spots, g, far) for g, far in groups], alone)
    per = bm25(index, spots.groupBy("phrase", "doc").agg(F.count("*").alias("tf")))
    whole = per.groupBy("doc").agg(F.collect_set("phrase").alias("met"), F.sum("rank").alias("rank")).where(holds(tree, F.col("met")))
    found = index.docs.drop("length").join(whole.select(F.col("doc").alias("id"), "rank"), "id")
    return found if file_path is None else found.where(F.col("file_path") == file_path)


def rerank_score(rank: Column, name: Column, kind: Column, query: Column) -> Column:
    """Lower is better: rank, less the boost of the best name match, plus the kind's penalty."""
    q, n = F.lower(F.trim(query)), F.lower(F.coalesce(name, F.lit("")))
    boost = F.when(n == q, EXACT).when(F.startswith(n, q), PREFIX).when(F.contains(n, q), PART).otherwise(0.0)
    penalty = F.lit(OTHER_PENALTY)
    for k, v in KIND_PENALTY.items():
        penalty = F.when(kind == k, v).otherwise(penalty)
    return rank - boost + penalty


def over_fetch(limit: int) -> int:
    return max(3 * limit, 60)


def search(index: Index, query: str, limit: int = 20, file_path: str | None = None) -> DataFrame:
    """The limit best of the candidates by rank, in new order: candidates beyond the first cut stay out."""
    best = match(index, query, file_path).orderBy("rank", "id").limit(over_fetch(limit))
    scored = best.withColumn("score", rerank_score(F.col("rank"), F.col("symbol_name"), F.col("kind"), F.lit(query)))
    return scored.orderBy("score", "rank", "id").limit(limit)


def task_words(task: str) -> list[str]:
    return [w for w in re.findall(r"\w+", task.lower()) if len(w) >= 3]


def search_words(index: Index, task: str, limit: int = 10, file_path: str | None = None) -> DataFrame:
    """Symbols by how many words of a task find them, ties in order of discovery; score is that count.

    Every word is a search of its own with three times the limit; all of them are one join of the postings. Without
    a word of three letters the text is searched as it is; if several words find nothing, so is the whole text, in all files.
    """
    words = task_words(task)
    if not words:
        return search(index, task, limit, file_path)
    spark = index.docs.sparkSession
    parts = [(i, [t for t in re.findall(r"[^\W_]+", w)], False, None) for i, w in enumerate(words)]
    parts = [p for p in parts if p[1]]
    ranked = bm25(index, phrase_hits(index, parts)).select(F.col("phrase").alias("word"), F.col("doc").alias("id"), "rank")
    rows = index.docs.drop("length").join(ranked, "id")
    if file_path is not None:
        rows = rows.where(F.col("file_path") == file_path)
    k = 3 * limit
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("word").orderBy("rank", "id"))).where(F.col("_n") <= over_fetch(k))
    asked = F.broadcast(spark.createDataFrame(list(enumerate(words)), "word int, _text string"))
    rows = rows.join(asked, "word").withColumn("_score", rerank_score(F.col("rank"), F.col("symbol_name"), F.col("kind"), F.col("_text")))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("word").orderBy("_score", "rank", "id"))).where(F.col("_place") <= k)
    one = rows.groupBy("qualified_name").agg(F.count("*").cast("double").alias("score"), F.min_by(F.struct("id", "symbol_name", "kind", "file_path", "rank", "word", "_place"), F.struct("word", "_place", "id")).alias("_r"))
    found = one.select("qualified_name", "score", "_r.*").orderBy(F.desc("score"), "word", "_place").limit(limit)
    if len(words) > 1 and found.isEmpty():
        return search(index, task, limit).withColumn("score", F.lit(1.0))
    return found.drop("word", "_place")


# ---------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


def vector_search(stored: DataFrame, query: list[float], top_k: int = 10, field: str = "embedding", key: str = "qualified_name") -> DataFrame:
    """The top_k rows by cosine; rows without a vector, or with one of another length, are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = stored.where(F.col(field).isNotNull() & (F.size(field) == len(query)))
    return rows.withColumn("similarity", cosine(F.col(field), q)).drop(field).orderBy(F.desc("similarity"), key).limit(top_k)


def hybrid(texts: DataFrame, vectors: DataFrame, text_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """qualified_name, combined: both sides' scores over their maxima, weighted; a missing side adds nothing.

    texts: qualified_name, score, and maybe position (of equal names the last by it counts, else the lowest score); vectors:
    qualified_name, similarity (equal names add up).
    """
    norm = lambda c, t: F.when(F.col(t) > 0, F.col(c) / F.col(t)).otherwise(0.0)
    place = F.col("position") if "position" in texts.columns else -F.col("score")
    t = texts.withColumn("_at", place).crossJoin(F.broadcast(texts.agg(F.max("score").alias("_t")))).select("qualified_name", "_at", (text_weight * norm("score", "_t")).alias("_a"))
    v = vectors.crossJoin(F.broadcast(vectors.agg(F.max("similarity").alias("_v")))).select("qualified_name", (vector_weight * norm("similarity", "_v")).alias("_b"))
    t = t.groupBy("qualified_name").agg(F.max_by("_a", F.struct("_at", "_a")).alias("_a"))
    v = v.groupBy("qualified_name").agg(F.sum("_b").alias("_b"))
    both = t.join(v, "qualified_name", "full_outer")
    return both.select("qualified_name", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("combined")).orderBy(F.desc("combined"), "qualified_name")


def decoded(blob: Column, dim: int) -> Column:
    """A stored vector (little-endian 32-bit floats); null if it has not dim components."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<f4") if b is not None and len(b) == 4 * dim else None for b in blobs])

    return decode(blob)


def hashed_embedding(text: Column, dim: int = 384) -> Column:
    """A deterministic stand-in for a sentence encoder: signed counts of hashed terms, unit length (zero for no terms).

    Arrow batches: higher-order functions would take the number of terms times dim.
    """
    import zlib

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for terms in texts:
            v = np.zeros(dim, np.float32)
            for t in terms:
                h = zlib.crc32(t.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append(v / n if n else v)
        return pd.Series(out)

    return encode(tokens(text))


def symbol_text(name: Column, signature: Column, context: Column | None = None) -> Column:
    parts = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (name, signature, *([] if context is None else [context]))]
    return F.concat_ws(" ", *parts)
