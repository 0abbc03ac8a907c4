"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Two dictionaries are trained by zstandard, one on toxic and one on ordinary text, and set behind a third one of
ordinary text that both share, so that the two differ in little but what they were trained on. Toxic documents are
ordinary text for the most part; the toxic dictionary is therefore trained on the words of theirs that several toxic
documents hold and that are far rarer in ordinary ones. A document is cut into overlapping windows of 48 bytes (long enough
for a phrase, and short enough that zstandard leaves literals alone and lengths compare). A window counts as toxic if
the toxic dictionary makes it shorter by a threshold; the share of such windows, through a logistic curve, is the score.
Threshold and curve are fitted on labelled texts that trained no dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

#: Labelled texts of each kind used for fitting, and the most characters of each kind; drawn and ordered by a hash of their ids.
TOXIC, ORDINARY, SAMPLE_CHARS = 2000, 3000, 10_000_000
WINDOW, STRIDE = 48, 24
#: Bytes of the shared dictionary and of each of the two; segment and run length with which zstandard picks from training text.
SHARED_BYTES, OWN_BYTES, SEGMENT, RUN = 32 << 10, 1 << 10, 24, 6
#: Toxic documents that a word must be in, and how many times as often as in ordinary ones, to train the toxic dictionary.
LEAST_DOCS, RATIO = 3, 10.0
#: Bytes gained that make a window toxic, from which the calibration chooses.
STEPS = (1, 2, 3, 4, 5, 6)
SCHEMA = "doc_id long, score double, predicted int, windows int, toxic_windows int"


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    step: int  # bytes gained from which a window is toxic
    curve: np.ndarray  # of feature() and 1

    def compressors(self) -> tuple:
        import zstandard as zs

        p = zs.ZstdCompressionParameters(
            strategy=zs.STRATEGY_LAZY2, target_length=64, min_match=4, hash_log=16, chain_log=16, window_log=17, search_log=6,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS,
        )
        found = []
        for raw in (self.ordinary, self.toxic):
            d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            found.append(zs.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return tuple(found)

    def scores(self, hits: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(feature(hits, windows) * self.curve[0] + self.curve[1], -30, 30)))


def windows(text: str, stride: int = STRIDE) -> Iterator[bytes]:
    b = text.lower().encode()
    for at in range(0, max(1, len(b) - (WINDOW - stride)), stride):
        yield b[at : at + WINDOW]


def gains(text: str, ordinary, toxic) -> np.ndarray:
    """Of each window, how many bytes the toxic dictionary makes it shorter than the ordinary one."""
    return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in windows(text)), np.int64)


def feature(hits: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.log1p(100 * hits / many)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of x and 1, and the mean log loss."""
    x, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def dictionary(pieces: list[bytes], size: int) -> bytes:
    import zstandard as zs

    try:
        return zs.train_dictionary(size, pieces, k=SEGMENT, d=RUN).as_bytes()
    except zs.ZstdError:  # too little text to train on
        return b" ".join(dict.fromkeys(pieces))[:size]


def telling_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Of each toxic text, its words that mark toxic texts, in pieces of a window's size."""
    count = [Counter(w for t in texts for w in set(t.lower().encode().split())) for texts in (toxic, ordinary)]
    mark = {w for w, n in count[0].items() if n >= LEAST_DOCS and n / len(toxic) > RATIO * (count[1][w] + 0.5) / max(1, len(ordinary))}
    texts = [b" ".join(w for w in t.lower().encode().split() if w in mark) for t in toxic]
    return [t[i : i + WINDOW] for t in texts for i in range(0, len(t), WINDOW) if len(t) - i >= 8]


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """share: of toxic texts among all labelled ones, for the sample holds more of them. Where one kind has no text to calibrate with, every text scores the share."""
    cut_t, cut_o = 2 * len(toxic) // 3, len(ordinary) // 2
    plain = [w for t in ordinary[:cut_o] for w in windows(t, WINDOW)]
    shared = dictionary(plain[::2], SHARED_BYTES)
    model = Model(shared + dictionary(telling_words(toxic[:cut_t], ordinary[:cut_o]), OWN_BYTES), shared + dictionary(plain[1::2], OWN_BYTES), STEPS[0], np.array([0.0, -30.0 if share <= 0 else 30.0 if share >= 1 else np.log(share / (1 - share))]))
    own = model.compressors()
    rest_t, rest_o = toxic[cut_t:], ordinary[cut_o:]
    if rest_t and rest_o:
        found = [gains(t, *own) for t in [*rest_t, *rest_o]]
        y = np.array([1.0] * len(rest_t) + [0.0] * len(rest_o))
        many = np.array([len(d) for d in found])
        fits = [(logistic(feature(np.array([(d >= k).sum() for d in found]), many), y), k) for k in STEPS]
        (model.curve, _), model.step = min(fits, key=lambda f: f[0][1])
        model.curve[1] += np.log(share / (1 - share) * len(rest_o) / len(rest_t)) if 0 < share < 1 else 0.0
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic: int, most: int) -> list[str]:
    """Texts of at most `most` labelled documents of one kind, by a hash of their ids; the ids are few enough to broadcast."""
    ids = labels.where(F.col("toxic") == toxic).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(most)
    texts, chars = [], 0
    found = docs.join(F.broadcast(ids), "doc_id").where("text IS NOT NULL").select("doc_id", "text")
    for r in found.orderBy(F.xxhash64("doc_id", F.lit("order")), "text").toLocalIterator():
        if chars >= SAMPLE_CHARS:
            break
        texts.append(r[1])
        chars += len(r[1])
    return texts


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1); rows with a null among these teach nothing."""
    counts = dict(labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("toxic").count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(sample(docs, labels, 1, TOXIC), sample(docs, labels, 0, ORDINARY), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5), windows, toxic_windows for every row, from its whole text.

    Null and empty texts are scored as an empty window; repeated rows each get their row; other columns
    are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        own = model.compressors()
        for b in batches:
            found = [gains(t.as_py() or "", *own) for t in b.column("text")]
            many = np.array([len(d) for d in found], np.int64)
            hits = np.array([(d >= model.step).sum() for d in found], np.int64)
            p = model.scores(hits, many)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(hits.astype(np.int32))], names=["doc_id", "score", "predicted", "windows", "toxic_windows"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def held_out() -> F.Column:
    """A row without an id is not held out; labels do not reach it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score of all documents; nulls, empty texts, repeats and empty tables as there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels").where(~held_out()))).select("doc_id", held_out().alias("held_out"), "score", "predicted", "windows", "toxic_windows")
