"""English stems as column expressions, for a dictionary of distinct terms that postings are looked up through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the English stemming rules: what a word's end becomes, by step. R1 and R2 say which region the end must lie in.
#: Words with stems of their own, and words that stay.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
#: Words that stay once a plural s is off.
STAY_SINGULAR = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which R1 starts.
LONG_BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
#: Step 2, in R1.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
#: Step 3, in R1, but ative in R2.
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Step 4, in R2.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: English words that searches leave out.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
_SHORT = "^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$"
_REGION = "^.*?[aeiouy][^aeiouy](.*)$"


def _ends(w: Column, rules: dict[str, tuple[Column, Column]]) -> Column:
    """The word after the rule (whether it may, what it becomes) of the longest end that it has."""
    out = w
    for end, (may, to) in sorted(rules.items(), key=lambda x: len(x[0])):  # the longest is asked for first
        out = F.when(F.endswith(w, F.lit(end)), F.when(may, to).otherwise(w)).otherwise(out)
    return out


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """The different rows of terms with a column stem: each lower-case term's English stem; terms with other characters stay as they are.

    One step a projection, so that no expression is nested in itself.
    """
    w = F.col("_w")
    cut = lambda n, more="": F.concat(F.expr(f"left(_w, length(_w) - {n})"), F.lit(more))
    has_vowel = lambda n: F.rlike(F.expr(f"left(_w, length(_w) - {n})"), F.lit("[aeiouy]"))
    within = lambda region, end: F.length(w) - len(end) >= F.col(region)
    t = F.col(term)
    plain = F.rlike(t, F.lit("^[a-z]{3,}$")) & ~t.isin(*STAY, *OWN)
    rows = terms.withColumn("_w", F.regexp_replace(F.regexp_replace(t, "^y", "Y"), "([aeiouy])y", "$1Y"))
    beginning = f"^(?:{'|'.join(LONG_BEGINNINGS)})(.*)$"
    rows = rows.withColumn("_r", F.when(F.rlike(w, F.lit(beginning)), F.regexp_extract(w, beginning, 1)).otherwise(F.regexp_extract(w, _REGION, 1)))
    rows = rows.withColumn("_r1", F.length(w) - F.length("_r")).withColumn("_r2", F.length(w) - F.length(F.regexp_extract("_r", _REGION, 1)))
    yes = F.lit(True)
    i_or_ie = (yes, F.when(F.length(w) > 4, cut(2)).otherwise(cut(1)))
    rows = rows.withColumn("_w", _ends(w, {"sses": (yes, cut(2)), "ied": i_or_ie, "ies": i_or_ie, "us": (~yes, w), "ss": (~yes, w), "s": (has_vowel(2), cut(1))}))
    rows = rows.withColumn("_done", ~plain | w.isin(*STAY_SINGULAR)).withColumn("_kept", w)
    gone = {e: (has_vowel(len(e)), F.concat(cut(len(e)), F.lit("+"))) for e in ("ed", "edly", "ing", "ingly")}  # a plus: something is off
    rows = rows.withColumn("_w", _ends(w, {**{e: (within("_r1", e), cut(len(e), "ee")) for e in ("eed", "eedly")}, **gone}))
    rows = rows.withColumn("_off", F.endswith(w, F.lit("+"))).withColumn("_w", F.rtrim(w, F.lit("+")))
    short = F.rlike(w, F.lit(_SHORT)) & (F.col("_r1") >= F.length(w))
    tail = F.when(F.rlike(w, F.lit("(at|bl|iz)$")), F.concat(w, F.lit("e"))).when(F.rlike(w, F.lit(f"({'|'.join(DOUBLES)})$")), cut(1)).when(short, F.concat(w, F.lit("e"))).otherwise(w)
    rows = rows.withColumn("_w", F.when(F.col("_off"), tail).otherwise(w))
    rows = rows.withColumn("_w", F.when(F.rlike(w, F.lit("^.+[^aeiouy][yY]$")), cut(1, "i")).otherwise(w))
    before = lambda n, letters: F.rlike(F.expr(f"left(_w, length(_w) - {n})"), F.lit(f"[{letters}]$"))
    asks = {"ogi": before(3, "l"), "li": before(2, BEFORE_LI)}
    rows = rows.withColumn("_w", _ends(w, {e: (within("_r1", e) & asks.get(e, yes), cut(len(e), to)) for e, to in SECOND.items()}))
    rows = rows.withColumn("_w", _ends(w, {e: (within("_r2" if e == "ative" else "_r1", e), cut(len(e), to)) for e, to in THIRD.items()}))
    rows = rows.withColumn("_w", _ends(w, {e: (within("_r2", e) & (before(3, "st") if e == "ion" else yes), cut(len(e))) for e in FOURTH}))
    no_short = ~F.rlike(F.expr("left(_w, length(_w) - 1)"), F.lit(_SHORT))
    last = F.when(F.endswith(w, F.lit("e")) & (within("_r2", "e") | within("_r1", "e") & no_short), cut(1)).when(F.endswith(w, F.lit("ll")) & within("_r2", "l"), cut(1)).otherwise(w)
    own = t
    for x, to in OWN.items():
        own = F.when(t == x, F.lit(to)).otherwise(own)
    singular = F.when(plain, F.lower("_kept")).otherwise(own)
    rows = rows.withColumn("_w", F.when(F.col("_done"), singular).otherwise(F.lower(last)))
    # an aggregate, so that no later filter of stems is pushed into the steps, where it would unfold them all into one expression
    return rows.groupBy(terms.columns).agg(F.max("_w").alias("stem"))
