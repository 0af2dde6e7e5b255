"""Document fingerprints by consistent weighted sampling of word counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import table
from .vectors import LOWER, Chunk, mix, word_hashes, words

SAMPLES = 64
#: Texts sampled together, in bytes: words that they share are drawn once.
BATCH_BYTES = 3 << 20
#: Neighbouring documents dealt to one unit, and units at most.
UNIT_ROWS, MOST_UNITS = 512, 200_000

_U = np.uint64
_LOW48 = _U((1 << 48) - 1)
_KEYS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent float32 draws in (0, 1) from each 64-bit hash."""
    half = np.float32(2.0**-32)
    high = ((h >> _U(32)).astype(np.float32) + np.float32(0.5)) * half
    low = ((h & _U(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * half
    return np.minimum(high, np.float32(1 - 2**-24)), np.minimum(low, np.float32(1 - 2**-24))


def _draws(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each weighted term and sample a 64-bit key: its rank value in the high half, the sample's identity in the low one.

    With r and c of Gamma(2, 1) and b uniform, all functions of term and sample alone, t = floor(ln w / r + b) and
    ln a = ln c - r (t - b) - r; a text's sample is the (term, t) of least a, which two texts share with the probability of
    their generalised Jaccard similarity.
    """
    h = mix(terms[:, None] ^ _KEYS[None, :])
    u1, u2 = _uniforms(h)
    r = -np.log(u1 * u2)
    h = mix(h + _U(0xA0761D6478BD642F))
    u3, u4 = _uniforms(h)
    ln_a = np.log(-np.log(u3 * u4))
    h = mix(h + _U(0xE7037ED1A0B428DB))
    b, _ = _uniforms(h)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    ln_a -= r * (t - b) + r
    rank = np.clip(ln_a + np.float32(256), np.float32(0), None).astype(np.float32).view(np.uint32).astype(np.uint64)
    identity = (h ^ (t.astype(np.int64).astype(np.uint64) * _U(0x9E3779B97F4A7C15))) & _U(0xFFFFFFFF)
    return (rank << _U(32)) | identity


def signatures(texts: list[bytes]) -> np.ndarray:
    """(len(texts), SAMPLES) 16-bit samples of each text's lower-cased word counts; a text without words has zeros."""
    out = np.zeros((len(texts), SAMPLES), dtype=np.uint16)
    if not texts:
        return out
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    chunk = Chunk(0, offsets, LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)])
    w = words(chunk)
    if not len(w.starts):
        return out
    hashes = word_hashes(chunk.data, w)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(w.first))
    keys = np.sort((doc << _U(48)) | (hashes >> _U(16)))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.concatenate((first, [len(keys)]))).astype(np.uint64)
    keys = keys[first]
    # a term and its count fit one number, by which texts share draws; terms of larger counts are drawn by themselves
    large = counts > _U(0xFFFF)
    terms, shared = keys & _LOW48, np.flatnonzero(~large)
    weighted, found = np.unique(terms[shared] | (counts[shared] << _U(48)), return_inverse=True)
    where = np.empty(len(keys), dtype=np.int64)
    where[shared], where[large] = found, len(weighted) + np.arange(np.count_nonzero(large))
    terms, weights = np.concatenate((weighted & _LOW48, terms[large])), np.concatenate((weighted >> _U(48), counts[large])).astype(np.int64)
    starts = np.searchsorted(keys >> _U(48), np.arange(len(texts) + 1, dtype=np.uint64))
    drawn = np.empty((len(terms), SAMPLES), dtype=np.uint64)
    for a in range(0, len(terms), 2048):
        drawn[a : a + 2048] = _draws(terms[a : a + 2048], weights[a : a + 2048])
    for d in np.flatnonzero(starts[1:] > starts[:-1]):
        least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for a in range(int(starts[d]), int(starts[d + 1]), 4096):
            np.minimum(least, drawn[where[a : min(a + 4096, int(starts[d + 1]))]].min(0), out=least)
        out[d] = (least & _U(0xFFFF)).astype(np.uint16)
    return out


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an unbiased estimate of generalised Jaccard similarity, but for 2^-16."""
    return float(np.mean(a == b))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row, in place: null texts count as empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts([(i, t or "") for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]):
                sigs = signatures([t.encode() for _, t in part])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in part], pa.int64()), "n_chars": pa.array([len(t) for _, t in part], pa.int64()), "fingerprint": [hexed(s) for s in sigs]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _parts(rows: list[tuple], most: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1])
        if size >= most or len(part) >= 16_384:
            yield part
            part, size = [], 0
    if part:
        yield part


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compare(run: list[tuple]) -> pa.RecordBatch:
    """Results for all but the last of neighbouring (doc_id, text)."""
    edited = []
    for (_, text), (_, after) in zip(run[:-1], run[1:], strict=True):
        cut = len(text) // 3
        edited.append((text[: len(text) - cut] + after[:cut]).encode())
    sigs = signatures([t.encode() for _, t in run] + edited)
    own, other = sigs[: len(run)], sigs[len(run) :]
    rows = [(i, len(t), hashlib.sha256(e).hexdigest(), hexed(own[k]), hexed(other[k]), likeness(own[k], other[k]), likeness(own[k], own[k + 1])) for k, ((i, t), e) in enumerate(zip(run[:-1], edited, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=kind) for c, kind in enumerate(_TYPES)], names=_NAMES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (unit, ghost, place): each unit's documents in order, then the document after its last."""
    held, unit, size, ended = [], None, 0, False
    for batch in batches:
        for u, ghost, doc_id, text in zip(*(batch[c].to_pylist() for c in ("unit", "ghost", "doc_id", "text")), strict=True):
            if u != unit:
                held, unit, size, ended = [], u, 0, False
            if ended:
                continue  # another row with the id of the document after the last
            ended = bool(ghost)
            held.append((doc_id, text or ""))
            size += len(held[-1][1])
            if len(held) > 1 and (ended or size >= BATCH_BYTES or len(held) > 8192):
                yield _compare(held)
                held, size = held[-1:], 0


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document: columns as op10's.

    Documents go by descending id, equal ids by text, null ids last; after the last comes the first, which may be the same.
    They are cut at quantiles of the id into units; each unit also gets the document after its last, so that texts are
    shuffled once. Only the cuts and each unit's first id, MOST_UNITS numbers at most, are sent to all executors. An empty
    text (null too) has a fingerprint of zeros and likeness 1 to another empty one. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = rows.withColumn("place", place)
    total = docs.count()
    units = max(1, min(MOST_UNITS, total // unit_rows))
    cuts = np.unique(np.array(rows.select("place").stat.approxQuantile("place", [i / units for i in range(1, units)], 0.2 / units) if units > 1 and total else [], dtype=np.float64))
    lows = cuts.tolist()

    def unit_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(lows), places.to_numpy().astype(np.float64), "left"))

    unit_udf = F.pandas_udf(unit_of, LongType())
    heads = {r["unit"]: r["head"] for r in rows.select("place").withColumn("unit", unit_udf("place")).groupBy("unit").agg(F.max("place").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    # the head of each unit also goes to the unit above, the highest head to the lowest unit
    after = {heads[u]: order[i - 1] for i, u in enumerate(order)}

    def ghost_of(places: pd.Series) -> pd.Series:
        return places.map(after).fillna(-1).astype("int64")

    dealt = rows.withColumn("unit", unit_udf("place")).withColumn("extra", F.pandas_udf(ghost_of, LongType())("place"))
    own = F.struct(F.col("unit").alias("unit"), F.lit(0).alias("ghost"))
    extra = F.struct(F.col("extra").alias("unit"), F.lit(1).alias("ghost"))
    dealt = dealt.select("doc_id", "text", "place", F.explode(F.when(F.col("extra") >= 0, F.array(own, extra)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.unit", "to.ghost", "place", "doc_id", "text").repartition(max(1, units // 4), "unit")
    ordered = dealt.sortWithinPartitions("unit", "ghost", F.desc("place"), "text")
    return ordered.select("unit", "ghost", "doc_id", "text").mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
