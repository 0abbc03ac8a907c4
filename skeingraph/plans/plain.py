"""Queries: stems of words, and plain-text search by stems, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stems as rules
from ..operators import stemmed
from ..operators.search import Index, tokens
from ..sources.star import oracle
from . import stored
from .registering import registrar
from .searches import TOKEN, _index, _rounded

QUERIES, ORACLES, query = registrar()


def _step(name: str, before: str, ends: dict[str, tuple[str, str]], keep: str = "w") -> str:
    cases = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {may} THEN {to} ELSE w END" for e, (may, to) in sorted(ends.items(), key=lambda x: -len(x[0])))
    return f"{name} AS (SELECT * REPLACE (CASE {cases} ELSE {keep} END AS w) FROM {before})"


def _cut(n: int, more: str = "") -> str:
    return f"left(w, length(w) - {n}) || '{more}'"


def stem_sql(terms: str) -> str:
    """Common tables that end in dictionary (term, stem), for a query of distinct terms."""
    region, short = r"^.*?[aeiouy][^aeiouy](.*)$", rules._SHORT
    vowel = lambda n: f"regexp_matches(left(w, length(w) - {n}), '[aeiouy]')"
    inside = lambda r, e: f"length(w) - {len(e)} >= {r}"
    i_or_ie = ("true", f"CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END")
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    asks = {"ogi": "regexp_matches(left(w, length(w) - 3), 'l$')", "li": f"regexp_matches(left(w, length(w) - 2), '[{rules.BEFORE_LI}]$')"}
    own = " ".join(f"WHEN term = '{k}' THEN '{v}'" for k, v in rules.OWN.items())
    return ", ".join(
        [
            f"k0 AS ({terms})",
            f"k1 AS (SELECT term, regexp_matches(term, '^[a-z]{{3,}}$') AND term NOT IN ({listed([*rules.STAY, *rules.OWN])}) AS plain, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM k0)",
            f"k2 AS (SELECT *, CASE WHEN regexp_matches(w, '^({'|'.join(rules.LONG_BEGINNINGS)})') THEN regexp_extract(w, '^(?:{'|'.join(rules.LONG_BEGINNINGS)})(.*)$', 1) ELSE regexp_extract(w, '{region}', 1) END AS r FROM k1)",
            f"k3 AS (SELECT *, length(w) - length(r) AS r1, length(w) - length(regexp_extract(r, '{region}', 1)) AS r2 FROM k2)",
            _step("k4", "k3", {"sses": ("true", _cut(2)), "ied": i_or_ie, "ies": i_or_ie, "us": ("false", "w"), "ss": ("false", "w"), "s": (vowel(2), _cut(1))}),
            f"k5 AS (SELECT *, NOT plain OR w IN ({listed(rules.STAY_SINGULAR)}) AS done, w AS kept FROM k4)",
            _step("k6", "k5", {**{e: (inside("r1", e), _cut(len(e), "ee")) for e in ("eed", "eedly")}, **{e: (vowel(len(e)), _cut(len(e), "+")) for e in ("ed", "edly", "ing", "ingly")}}),
            "k7 AS (SELECT * REPLACE (rtrim(w, '+') AS w), ends_with(w, '+') AS shorter FROM k6)",
            f"k8 AS (SELECT * REPLACE (CASE WHEN NOT shorter THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '({'|'.join(rules.DOUBLES)})$') THEN {_cut(1)} WHEN regexp_matches(w, '{short}') AND r1 >= length(w) THEN w || 'e' ELSE w END AS w) FROM k7)",
            f"k9 AS (SELECT * REPLACE (CASE WHEN regexp_matches(w, '^.+[^aeiouy][yY]$') THEN {_cut(1, 'i')} ELSE w END AS w) FROM k8)",
            _step("k10", "k9", {e: (f"{inside('r1', e)} AND {asks.get(e, 'true')}", _cut(len(e), to)) for e, to in rules.SECOND.items()}),
            _step("k11", "k10", {e: (inside("r2" if e == "ative" else "r1", e), _cut(len(e), to)) for e, to in rules.THIRD.items()}),
            _step("k12", "k11", {e: (inside("r2", e) + (" AND regexp_matches(left(w, length(w) - 3), '[st]$')" if e == "ion" else ""), _cut(len(e))) for e in rules.FOURTH}),
            f"k13 AS (SELECT *, CASE WHEN ends_with(w, 'e') AND ({inside('r2', 'e')} OR ({inside('r1', 'e')} AND NOT regexp_matches(left(w, length(w) - 1), '{short}'))) THEN {_cut(1)} WHEN ends_with(w, 'll') AND {inside('r2', 'l')} THEN {_cut(1)} ELSE w END AS v FROM k12)",
            f"dictionary AS (SELECT term, CASE WHEN NOT done THEN lower(v) WHEN plain THEN lower(kept) ELSE CASE {own} ELSE term END END AS stem FROM k13)",
        ]
    )


_WORDS = TOKEN.format(c="text")


@query(f"WITH {stem_sql(f'SELECT DISTINCT unnest({_WORDS}) AS term FROM documents')} SELECT term, stem FROM dictionary")
def document_stems(spark, d):
    """Every different word of all documents, and its stem."""
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return rules.stems(words).select("term", "stem")


def _plain_sql(stems: list[str], limit: int) -> str:
    fields = " UNION ALL ".join(f"SELECT id, {shift} AS shift, {TOKEN.format(c=f)} AS terms FROM symbols" for f, shift in (("name", "0"), ("signature", f"len({TOKEN.format(c='name')})")))
    listed = ", ".join(f"'{s}'" for s in stems)
    stop = ", ".join(f"'{w}'" for w in rules.STOP)
    pairs = "SELECT a.id, 1 - exp(sum(ln(1 - sqrt(0.01 * CASE WHEN abs(a.at_pos - b.at_pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.at_pos - b.at_pos) / 1.5 - 2)) END)))) AS rank FROM o a JOIN o b ON a.id = b.id AND a.stem < b.stem GROUP BY a.id"
    one = "SELECT id, 0.1 * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493406685 AS rank FROM o GROUP BY id"
    return oracle(
        f""", f AS ({fields}), p AS MATERIALIZED (SELECT id, unnest(terms) AS term, generate_subscripts(terms, 1) + shift AS at_pos FROM f), {stem_sql(f"SELECT DISTINCT term FROM p WHERE term NOT IN ({stop})")},
        o0 AS (SELECT id, stem, at_pos FROM p JOIN dictionary USING (term) WHERE stem IN ({listed})), whole AS (SELECT id FROM o0 GROUP BY id HAVING count(DISTINCT stem) = {len(stems)}), o AS MATERIALIZED (SELECT o0.* FROM o0 JOIN whole USING (id))
        SELECT id, round(rank, 9) AS rank FROM ({pairs if len(stems) > 1 else one}) ORDER BY round(rank, 9) DESC, id LIMIT {limit}"""
    )


def _plain(spark, d, index, by_stem, text: str, limit: int):
    places, n = stemmed.lexemes(index, by_stem, text)
    found = stemmed.rank(places, n).select(F.col("doc").alias("id"), F.round("rank", 9).alias("rank"))
    return found.orderBy(F.desc("rank"), "id").limit(limit)


@query(_plain_sql(["class", "ring", "econom"], 1_000_000))
def plain_search(spark, d):
    """All symbols with the words of a text in any form."""
    index = _index(spark, d)
    return _plain(spark, d, index, stemmed.dictionary(index.postings), "The classes of rings, economic", 1_000_000)


@query(stored._final(_plain_sql(["bolt"], 40)))
def stored_plain_search(spark, d):
    """Over stored postings and dictionary, the best forty."""
    docs, postings, stems = stored.live(spark, d, *stored.INDEX, "stems")
    return _plain(spark, d, Index(docs, postings), stems, "bolted", 40)
