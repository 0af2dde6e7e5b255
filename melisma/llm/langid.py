"""Language identification with string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, table
from .vectors import LOWER, Chunk, chunks, give_back, mix

_U = np.uint64
#: n-gram lengths in bytes, blended in one presence vector.
NGRAMS = (1, 2, 3, 4)
#: Bytes of text scored together.
BATCH_BYTES = 1 << 18
#: Presence bits; n-grams are hashed to them.
BITS = 1 << 13
#: Labelled texts learned from, for each language: the first by a hash of the id. This bounds what the driver holds.
SAMPLE_ROWS = 300
#: Languages whose shares, and whose sampled ids, are sent to all executors at most.
MOST_BROADCAST = 1000
#: Landmarks for each language, out of the sample.
LANDMARKS = 24
RIDGE = 1e-2
#: Sharpness with which one-versus-rest scores become shares of one.
SHARPNESS = 6.0

#: A text is rejected when its best language has less than this share of the score.
REJECT_BELOW = 0.3

UND = "und"


def presence(chunk: Chunk) -> np.ndarray:
    """(texts, BITS) 0/1: which hashed n-grams of lower-cased bytes occur in each whole text; none crosses texts."""
    n = len(chunk.offsets) - 1
    out = np.zeros((n, BITS), dtype=np.float32)
    data = LOWER[chunk.data].astype(np.uint64)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(chunk.offsets))
    rows, flat = doc * BITS, out.reshape(-1)
    code = np.zeros(len(data), dtype=np.uint64)
    for size in range(1, max(NGRAMS) + 1):
        last = len(data) - size + 1
        if last <= 0:
            break
        code = (code[:last] << _U(8)) | data[size - 1 :]
        if size in NGRAMS:
            slot = (mix(code + _U(size << 40)) & _U(BITS - 1)).astype(np.int64) + rows[:last]
            whole = doc[:last] == doc[size - 1 :]
            flat[slot[whole]] = 1
    return out


@dataclass
class Model:
    """languages, and weights so that scores are kernel values with the landmarks times weights."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, present: np.ndarray) -> np.ndarray:
        return _kernel(present, self.landmarks) @ self.weights


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised number of shared n-grams; 0 for a text without any."""
    left, right = np.sqrt(np.maximum(a.sum(1), 1)), np.sqrt(np.maximum(b.sum(1), 1))
    return (a @ b.T) / left[:, None] / right[None, :]


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression in the Nystroem space of some texts of each language."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, BITS), dtype=np.float32), np.zeros((0, 0)))
    column = pa.array(texts, type=pa.large_string())
    x = np.concatenate([presence(c) for c in chunks(column)])
    y = np.array([names.index(v) for v in languages])
    picked = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(names))])
    marks = x[picked]
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    z = _kernel(x, marks).astype(np.float64) @ root
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(y, minlength=len(names))[y]
    gram = z.T @ (z * share[:, None])
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)) * np.trace(gram) / len(gram), z.T @ (goal * share[:, None]))
    return Model(names, marks, (root @ solved).astype(np.float32))


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to `rows` rows of each language, the first by a hash of the id: the same ones however the table is stored.

    Ids whose hash is beyond four times the share wanted are left out before any sorting, so that a common language's rows
    don't meet in one task; then ids are ranked, and texts only within the sample.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy(place, "doc_id", "text")
    keys = Window.partitionBy("lang").orderBy(place, "doc_id")
    share = labelled.groupBy("lang").agg((F.lit(4.0 * rows) / F.count(F.lit(1))).alias("_share"))
    # one row a language: broadcast where they are few, so that the ids are thinned where they are read
    few = share.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    near = labelled.select("lang", "doc_id").join(F.broadcast(share) if few else share, "lang").where(place / F.lit(float(1 << 40)) <= F.col("_share"))
    ids = near.withColumn("_r", F.row_number().over(keys)).where(F.col("_r") <= rows).select("lang", "doc_id").distinct()
    own = labelled.join(F.broadcast(ids) if few and rows <= 10_000 else ids, ["lang", "doc_id"], "left_semi")
    return own.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rows).select("doc_id", "lang", "text")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from text and non-null lang of the rows that are not held out; at most `rows` of each language reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    found = sample(known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), rows).orderBy("lang", F.xxhash64("doc_id"), "doc_id", "text").collect()
    return fit([r["text"] for r in found], [r["lang"] for r in found])


def judge(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language of each text and its share among the one-versus-rest scores; `und` and 0 where no language was learned."""
    names, scores = [], []
    for chunk in chunks(texts, BATCH_BYTES):
        for a in range(0, len(chunk.offsets) - 1, 256):
            offs = chunk.offsets[a : a + 257]
            part = Chunk(0, offs - offs[0], chunk.data[offs[0] : offs[-1]])
            if not model.languages:
                names += [UND] * (len(offs) - 1)
                scores += [0.0] * (len(offs) - 1)
                continue
            raw = model.scores(presence(part)).astype(np.float64)
            names += [model.languages[i] for i in raw.argmax(1)]
            scores += (1 / np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True))).sum(1)).tolist()
    return names, scores


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch["letters"].to_pylist()
            names, scores = judge(model, batch["text"])
            names = [n if has else UND for n, has in zip(names, letters, strict=True)]
            scores = [s if has else 0.0 for has, s in zip(letters, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    return run


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that language ID rejects: those whose text is null or has no letter, and those in which the best
    learned language has less than REJECT_BELOW of the score. Without labelled rows only the former go."""
    model = train(docs)
    if not model.languages:
        return docs.where(has_letter("text"))

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        return pd.Series(judge(model, pa.array(texts, type=pa.large_string()))[1])

    return docs.where(has_letter("text")).where(share("text") >= REJECT_BELOW)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text alone.

    `und` and score 0 where the text is null or has no letter, or where no language was learned. The score is the predicted
    language's share among the one-versus-rest scores. Null ids stay, and count as the empty text for held_out; equal texts
    get equal predictions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"), has_letter("text").alias("letters"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
