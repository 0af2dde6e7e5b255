"""Rhythm evidence: novelty of a sound, tempi by folding, their metrical relatives, and the sounding part of a window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import adapters
from .decoders import spread

#: Fixed values of the analysis: samples a second, samples between frames, samples in a frame.
RATE, HOP, SIZE = 11025, 110, 1024
#: Frames that one task turns into spectra at once.
CHUNK = 2048
#: Ratios of tempi that are told apart badly.
RATIOS = [1 / 3, 1 / 2, 2 / 3, 4 / 3, 3 / 2, 2, 3]


def novelty(blocks: DataFrame) -> DataFrame:
    """SG2 over blocks (song_id, first, xs) of samples at RATE: .7 of the spectral flux and .3 of that from 35 to 250 Hz, each
    above its mean of 101 frames, in units of its 95th percentile, at most 4. One row a frame.

    A block goes to the one or two chunks of frames that need it; no task holds more than a chunk. Samples that no block
    covers are silent.
    """
    last = F.max(F.col("first") + F.size("xs")).over(Window.partitionBy("song_id"))
    span = CHUNK * HOP
    # the frame before a chunk is needed for its first difference
    low = F.floor((F.col("first") - SIZE // 2) / span).cast("long")
    high = F.floor((F.col("first") + F.size("xs") - 1 + SIZE // 2 + HOP) / span).cast("long")
    dealt = blocks.where(F.size("xs") > 0).withColumn("samples", last).withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.floor(F.col("samples") / span).cast("long")))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        song, chunk = key
        first = int(chunk) * CHUNK
        count = min(CHUNK, int(rows["samples"].iloc[0]) // HOP + 1 - first)
        if count <= 0:
            return pd.DataFrame({"song_id": [], "frame": [], "flux": [], "low": []})
        start = (first - 1) * HOP - SIZE // 2
        y = np.zeros((count + 1) * HOP + SIZE)
        for at, xs in zip(rows["first"], rows["xs"], strict=True):
            a, b = max(start, at), min(start + len(y), at + len(xs))
            if a < b:
                y[a - start : b - start] = np.asarray(xs, dtype=float)[a - at : b - at]
        frames = np.lib.stride_tricks.sliding_window_view(y, SIZE)[::HOP][: count + 1]
        levels = np.log1p(20 * np.abs(np.fft.rfft(frames * np.hanning(SIZE))))
        if first == 0:
            levels[0] = levels[1]
        rise = np.maximum(0, np.diff(levels, axis=0))
        hz = np.fft.rfftfreq(SIZE, 1 / RATE)
        return pd.DataFrame({"song_id": song, "frame": np.arange(first, first + count), "flux": rise.mean(1), "low": rise[:, (hz >= 35) & (hz <= 250)].mean(1)})

    found = dealt.groupBy("song_id", "chunk").applyInPandas(run, "song_id long, frame long, flux double, low double")
    around = Window.partitionBy("song_id").orderBy("frame").rowsBetween(-50, 50)
    above = found.select("song_id", "frame", *[F.greatest(F.lit(0.0), F.col(c) - F.sum(c).over(around) / 101).alias(c) for c in ("flux", "low")])
    song = Window.partitionBy("song_id")
    part = {c: F.least(F.lit(4.0), F.col(c) / F.greatest(F.percentile(c, F.lit(0.95)).over(song), F.lit(1e-8))) for c in ("flux", "low")}
    return above.select("song_id", "frame", F.round(0.7 * part["flux"] + 0.3 * part["low"], 6).alias("strength"))


def _peaks(x: np.ndarray, distance: int) -> list[int]:
    """Local maxima, highest first, none nearer to a higher one than distance."""
    inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    kept: list[int] = []
    for i in inner[np.argsort(-x[inner], kind="stable")].tolist():
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    return kept


def _folded(x: np.ndarray, step: float, periods: np.ndarray) -> np.ndarray:
    """For each period the median over pieces of 24 s of how far its fullest phase stands out. Periods of as many phases fold together;
    frames without strength add nothing."""
    piece = round(24 / step)
    parts = [p for p in (x[start : start + piece] for start in range(0, len(x), piece)) if len(p) >= 3 / step]
    if not parts:
        return np.zeros(len(periods))
    struck = [np.flatnonzero(p) for p in parts]
    time, part = np.concatenate(struck) * step, np.repeat(np.arange(len(parts)), [len(at) for at in struck])
    weight = np.concatenate([p[at] for p, at in zip(parts, struck, strict=True)])
    phases, found = np.array([max(8, round(p / step)) for p in periods]), np.empty((len(periods), len(parts)))
    for n in np.unique(phases).tolist():
        own = np.flatnonzero(phases == n)
        place = np.floor(time / periods[own, None] * n).astype(int) % n + (np.arange(len(own))[:, None] * len(parts) + part) * n
        sums = np.bincount(place.ravel(), weights=np.tile(weight, len(own)), minlength=len(own) * len(parts) * n).reshape(-1, n)
        around = np.concatenate([sums[:, -1:], sums, sums[:, :1]], axis=1)
        smooth = 0.6 * sums + 0.2 * (around[:, :-2] + around[:, 2:])
        found[own] = (smooth.max(1) / np.maximum(smooth.mean(1), 1e-8)).reshape(-1, len(parts))
    return np.median(found, axis=1)


def tempo_candidates(onsets: DataFrame, frame_s: float, most: int = 16) -> DataFrame:
    """SG3, K5, SG4 over (song_id, frame, strength): tempi of the highest autocorrelations, each refined by folding and weighed
    towards 95; of tempi within 2 the better stays, then relatives by RATIOS between 40 and 240 that are more than 1 from all
    others join with .82 of the score. Songs under 3 s or without strength give no row."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(int(rows["frame"].max()) + 1)
        np.add.at(x, rows["frame"].to_numpy(), rows["strength"].to_numpy(float))
        none = pd.DataFrame({"song_id": [], "rank": [], "bpm": [], "score": [], "derived_from": []})
        if len(x) * frame_s < 3 or x.max() < 1e-5:
            return none
        spectrum = np.fft.rfft(x - x.mean(), 2 * len(x))
        same = np.fft.irfft(spectrum * np.conj(spectrum))[: len(x)]
        low, high = max(1, round(60 / 220 / frame_s)), round(60 / 45 / frame_s)
        lags = [p + low for p in _peaks(same[low:high], 3)[:12]] or [int(same[low:high].argmax()) + low]
        lag = np.repeat(lags, 17)
        period = np.concatenate([np.linspace(p - 1, p + 1, 17) for p in lags]) * frame_s
        lag, period = lag[period > 0], period[period > 0]
        sure = {p: max(same[p] / max(same[0], 1e-8), 0.01) ** 0.25 for p in lags}
        value = np.array([f * sure[p] * np.exp(-0.3 * np.log2(60 / t / 95) ** 2) for f, p, t in zip(_folded(x, frame_s, period), lag, period, strict=True)])
        order = np.argsort(-value, kind="stable")
        best = order[np.sort(np.unique(lag[order], return_index=True)[1])]
        kept: list[tuple[float, float, float | None]] = []
        for bpm, value in zip((60 / period[best]).round(2).tolist(), value[best].round(3).tolist(), strict=True):
            if all(abs(bpm - other) > 2 for other, _, _ in kept):
                kept.append((bpm, value, None))
        for source, value, _ in kept[:6]:
            for bpm in (round(source * r, 2) for r in RATIOS):
                if 40 <= bpm <= 240 and all(abs(bpm - other) > 1 for other, _, _ in kept):
                    kept.append((bpm, round(value * 0.82, 3), source))
        kept = sorted(kept, key=lambda c: -c[1])[:most]
        return pd.DataFrame([(key[0], i + 1, float(b), float(v), s) for i, (b, v, s) in enumerate(kept)], columns=none.columns)

    return spread(onsets, "song_id").groupBy("song_id").applyInPandas(run, "song_id long, rank long, bpm double, score double, derived_from double")


def sounding_part(frames: DataFrame, hop_s: float = 0.08, window_s: float = 30.0) -> DataFrame:
    """ST2 over (song_id, frame, rms): of each window the part to decode. An edge goes where more than 2 s of it lie before or
    after all runs of three sounding frames (a 1.5 % of the window's loudest, .0005 at least); .6 s of it stay. Windows without
    such a run give no row."""
    t = F.col("frame") * hop_s
    x = frames.select("song_id", "frame", "rms", F.floor(t / window_s).cast("long").alias("window_index"))
    own = Window.partitionBy("song_id", "window_index")
    loud = F.col("rms") >= F.greatest(F.lit(0.0005), F.max("rms").over(own) * 0.015)
    next_two = own.orderBy("frame")
    run = F.col("loud") & F.coalesce(F.lead("loud", 1).over(next_two), F.lit(False)) & F.coalesce(F.lead("loud", 2).over(next_two), F.lit(False))
    runs = x.withColumn("loud", loud).withColumn("run", run).groupBy("song_id", "window_index").agg(F.min(F.when(F.col("run"), F.col("frame"))).alias("a"), F.max(F.when(F.col("run"), F.col("frame"))).alias("b"), F.max("frame").alias("z")).where("a IS NOT NULL")
    start, end = F.col("window_index") * window_s, F.least((F.col("window_index") + 1) * window_s, (F.col("z") + 1) * hop_s)
    first, last = F.col("a") * hop_s, F.least(end, (F.col("b") + 3) * hop_s)
    return runs.select("song_id", "window_index", F.round(F.when(first - start > 2, F.greatest(start, first - 0.6)).otherwise(start), 4).alias("low"), F.round(F.when(end - last > 2, F.least(end, last + 0.6)).otherwise(end), 4).alias("high"))


def _sound(spark, sf_dir):
    """A tone for each vector, one component after the other: 64 samples a component."""
    e = adapters.view(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    xs = F.flatten(F.transform("embedding", lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(v.cast("double"), F.lit(0.0)) * F.sin(i * 0.7))))
    place = F.row_number().over(Window.partitionBy("song_id").orderBy("vec_id")) - 1
    return e.select((F.col("vec_id") % 20).cast("long").alias("song_id"), "vec_id", xs.alias("xs")).withColumn("first", place.cast("long") * F.size("xs")).select("song_id", "first", "xs")


def _strengths(spark, sf_dir):
    return adapters.view(spark, sf_dir, "note_events").selectExpr("song_id", "CAST(floor(start_s / 0.02) AS BIGINT) AS frame", "confidence AS strength")


def _levels(spark, sf_dir):
    e = adapters.view(spark, sf_dir, "note_events")
    heard = e.selectExpr("song_id", "explode(sequence(CAST(floor(start_s / 0.08) AS BIGINT), CAST(floor(end_s / 0.08) AS BIGINT))) AS frame", "confidence AS rms")
    return heard.groupBy("song_id", "frame").agg(F.max("rms").alias("rms"))


QUERIES = {
    "novelty": lambda s, d: novelty(_sound(s, d)),
    "tempo_candidates": lambda s, d: tempo_candidates(_strengths(s, d), 0.02),
    "sounding_part": lambda s, d: sounding_part(_levels(s, d)),
}
