"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are its runs of 1 to 4 lower-cased characters (digits and signs become blanks, runs
of blanks one blank); each is hashed to a row of an embedding table. The mean of the rows goes through
a linear softmax. Table and weights are trained together by stochastic gradient descent in numpy, on
a bounded, seeded sample of labelled texts. Probabilities are calibrated by a temperature fitted on a
part of the sample held back from training, and a text is rejected when its best probability lies
below a threshold that keeps all but `lost` of that part's rightly labelled texts.

Prediction folds table and weights into one table of a few scores per subword and sums it over the
whole text, so it needs no sampling of long texts; the folded table (a fixed number of buckets times
the number of languages) is all that the executors get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE, materialize, read, released, ship, slices, small, text_of

UNKNOWN = "und"
BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
#: Labelled texts of a language used for fitting, and the most characters of all of them together.
SAMPLE, SAMPLE_CHARS, EPOCHS, RATE = 1500, 40_000_000, 6, 0.5
#: Share of rightly labelled texts that the threshold may reject.
LOST = 0.001

_FOLD = np.arange(0x250, dtype=np.uint16)
_FOLD[[c for c in range(0x250) if not chr(c).isalpha()]] = 32


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each with a blank before and behind; where each begins."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = np.asarray(pc.utf8_length(lowered), np.int64)
    cp = np.frombuffer(text_of(lowered).data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.full(at[-1], 32, np.uint32)
    inside = np.ones(at[-1], bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    out[inside] = np.where(cp < 0x250, _FOLD[np.minimum(cp, 0x24F)], cp)
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == 32) & (out[:-1] == 32)
    again[at[:-1]] = False
    keep = ~again
    counts = np.add.reduceat(keep, at[:-1]) if len(at) > 1 else np.empty(0, np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def subwords(cp: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the runs of each order that end at each character (runs over two texts' blanks do little harm)."""
    run = np.zeros(len(cp), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        back = cp if k == 1 else np.concatenate([np.full(k - 1, 32, np.uint32), cp[: max(0, len(cp) - k + 1)]])[: len(cp)]
        run = (run + back + np.uint32(k)) * np.uint32(0x9E3779B1)
        if k in ORDERS:
            mixed = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield mixed >> np.uint32(32 - 15)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float
    threshold: float

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all subwords of each text, and how many characters it has."""
        cp, at = characters(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for b in subwords(cp):
            for j in range(len(self.langs)):
                total[:, j] += np.add.reduceat(self.scores[j][b].astype(np.float64), at[:-1])
        return total, np.diff(at)

    def logits(self, texts: pa.Array, piece: int = PIECE) -> np.ndarray:
        """A text alone that is longer than a piece is added up piece by piece, each between blanks."""
        if len(texts) == 1 and len(text := texts[0].as_py() or "") > piece:
            parts = [self.sums(pa.array([text[i : i + piece]])) for i in range(0, len(text), piece)]
            total, n = (sum(x) for x in zip(*parts, strict=True))
        else:
            total, n = self.sums(texts)
        return total / (n * len(ORDERS))[:, None] + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    bags = []
    for t in texts:
        cp, _ = characters(pa.array([t]))
        b, n = np.unique(np.concatenate(list(subwords(cp))), return_counts=True)
        bags.append((b, (n / n.sum()).astype(np.float32)))
    table = (rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = EPOCHS * len(train)
    for step in range(steps):
        if step % len(train) == 0:
            rng.shuffle(train)
        i = train[step % len(train)]
        rate = np.float32(RATE * (1 - step / steps))
        b, n = bags[i]
        x = n @ table[b]
        p = softmax((x @ w + bias)[None])[0].astype(np.float32)
        p[y[i]] -= 1
        back = w @ p
        w -= rate * np.outer(x, p)
        bias -= rate * p
        table[b] -= (rate * len(b) ** 0.5 * n)[:, None] * back
    model = Model(langs, np.ascontiguousarray((table @ w).T), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = np.stack([model.logits(pa.array([texts[i]]))[0] for i in held])
        best = min((2.0**k for k in np.arange(-6, 4.01, 0.25)), key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
        p = softmax(z / best)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y[held]])
        model.temperature = float(best)
        if len(right):
            model.threshold = float(right[int(LOST * len(right))])
    return model


def sample(labelled: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], list[str]]:
    """About per_language texts of each language, by a hash of their ids: a bounded sample."""
    n = materialize(labelled.groupBy("lang").count(), "languages")
    shares = small(n.select("lang", F.least(F.lit(1.0), per_language / F.col("count")).alias("share")))
    part = labelled.join(shares, "lang").where((F.abs(F.xxhash64("doc_id", F.lit("language"))) % 1_000_000) < F.col("share") * 1_000_000)
    texts, langs, chars = [], [], 0
    for r in part.select("doc_id", "lang", "text").orderBy(F.xxhash64("doc_id"), "text").toLocalIterator():
        if chars >= SAMPLE_CHARS:
            break
        texts.append(r[2])
        langs.append(r[1])
        chars += len(r[2])
    return texts, langs


def train(labelled: DataFrame) -> Model:
    """labelled: doc_id, text, lang; rows with a null text or lang, or a text without a letter, teach nothing."""
    texts, langs = sample(labelled.where(r"lang IS NOT NULL AND text RLIKE '\\p{L}'"))
    if not texts:
        return Model([UNKNOWN], np.zeros((1, BUCKETS), np.float32), np.zeros(1), 1.0, 0.0)
    return fit(texts, langs)


def with_language(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs (with a text column) and three columns more, named with the prefix: lang_pred, score, rejected.

    Columns of docs that have these names give way. A null text or one without a letter is `und` with score 0 and
    rejected. Ties go to the language first in the alphabet; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    kept = [c for c in docs.columns if c not in added]
    d = docs.select(*kept).withColumn("text", F.col("text").cast("string"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        for b in slices(batches, limit=1 << 20):
            texts = pc.fill_null(b.column("text"), "")
            letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
            p = m.probabilities(texts)
            best = np.where(letters, p.argmax(axis=1), len(m.langs))
            score = np.where(letters, p.max(axis=1), 0.0)
            new = [pa.array(names[best], pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*kept, *added])

    schema = T.StructType([*d.schema.fields, *(T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return d.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row (repeated rows each get theirs), from whole texts."""
    return with_language(docs.select(F.col("doc_id").cast("long"), "text"), model)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the model rejects; a null lang is filled with the prediction. Other columns stay as they are, whatever their names."""
    prefix = "_lid_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = with_language(docs, model, prefix).where(f"NOT {prefix}rejected")
    lang = {"lang": F.coalesce("lang", f"{prefix}lang_pred")} if "lang" in docs.columns else {}
    return found.withColumns(lang).select(docs.columns)


def held_out(column: str = "doc_id") -> F.Column:
    """A row without an id is not held out, and has no label either where ids tell them."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()).select("doc_id", "text", "lang"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict for all documents; nulls, texts without letters, ties, repeats and empty tables as in with_language."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train_on_documents(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
