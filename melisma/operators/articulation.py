"""Articulation: how a sound's spectrum changes, and notes of one pitch that it parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import adapters
from .cores import DIP, STEP
from .decoders import spread

#: Fixed values of the analysis: samples a second and between frames, bands from 150 Hz to 6 kHz, seconds compared on each side.
RATE, HOP, BANDS = 16_000, 256, 24
REACH = max(1, round(0.04 * RATE / HOP))
SIZE = round(0.064 * RATE) + round(0.064 * RATE) % 2
#: Frames whose spectra one task takes at once.
CHUNK = 2048


def spectral_changes(blocks: DataFrame, xs: Column | None = None) -> DataFrame:
    """SG9 over blocks (song_id, first, xs) of samples at RATE: (song_id, frame, change), one less the likeness of the spectral
    shapes REACH frames before and after; 0 at both ends. Loudness doesn't matter.

    A block goes to the chunks of frames that need it; no task holds more than a chunk. Samples that no block covers are silent.
    Where a block's samples follow from its other columns, blocks have their number as size, and xs is the expression of them:
    it is evaluated in the chunks, so that only what it needs is shuffled and sorted.
    """
    if xs is None:
        blocks, xs = blocks.withColumn("size", F.size("xs")), F.col("xs")
    samples = F.max(F.col("first") + F.col("size")).over(Window.partitionBy("song_id"))
    span, before = CHUNK * HOP, REACH * HOP + SIZE // 2
    low = F.greatest(F.lit(0), F.floor((F.col("first") - before) / span)).cast("long")
    high = F.least(F.floor((F.col("first") + F.col("size") - 1 + before) / span), F.floor(F.col("samples") / span)).cast("long")
    dealt = blocks.where(F.col("size") > 0).withColumn("samples", samples).withColumn("chunk", F.explode(F.sequence(low, high)))
    met = spread(dealt, "song_id", "chunk").sortWithinPartitions("song_id", "chunk").select("song_id", "chunk", "samples", "first", xs.alias("xs"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        song, chunk = key
        first, frames = int(chunk) * CHUNK, int(rows["samples"].iloc[0]) // HOP + 1
        count = min(CHUNK, frames - first)
        start = (first - REACH) * HOP - SIZE // 2
        y = np.zeros((count + 2 * REACH - 1) * HOP + SIZE)
        for at, xs in zip(rows["first"], rows["xs"], strict=True):
            a, b = max(start, at), min(start + len(y), at + len(xs))
            if a < b:
                y[a - start : b - start] = np.asarray(xs, dtype=float)[a - at : b - at]
        windows = np.lib.stride_tricks.sliding_window_view(y, SIZE)[::HOP][: count + 2 * REACH]
        power = np.abs(np.fft.rfft(windows * np.hanning(SIZE))) ** 2
        hz, edges = np.fft.rfftfreq(SIZE, 1 / RATE), np.geomspace(150, min(6000, RATE * 0.48), BANDS + 1)
        shapes = np.sqrt(np.stack([power[:, (hz >= a) & (hz < b)].sum(1) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1))
        shapes /= np.linalg.norm(shapes, axis=1, keepdims=True) + 1e-12
        change = np.maximum(0, 1 - (shapes[:count] * shapes[2 * REACH : count + 2 * REACH]).sum(1))
        number = np.arange(first, first + count)
        change[(number < REACH) | (number >= frames - REACH)] = 0
        return pd.DataFrame({"song_id": song, "frame": number, "change": np.round(change, 9)})

    return met.groupBy("song_id", "chunk").applyInPandas(run, "song_id long, frame long, change double")


PIECES = "song_id long, event_a long, kind string, start_s double, end_s double, midi long, core_start_s double, core_end_s double, uncertain boolean, boundary_s double, change double, attack_s double"
#: Frames before an event in which an attack may lie; least frames on each side of a boundary.
AHEAD, SIDE = round(0.24 / STEP), max(3, round(0.12 / STEP))


def _local(x: np.ndarray, k: int) -> bool:
    return x[k] >= x[k - 1] and x[k] > x[k + 1]


def _attack(e, sound: dict) -> tuple | None:
    """An attack before a core that voicing left out: evidence only, no note is made of it."""
    a, b, low = e.a, e.b, max(0, e.a - AHEAD)
    change, first = sound["change"], sound["first"]
    peaks = [k for k in range(low + 3, min(b - 3, a + round(0.08 / STEP))) if change[k - first] >= 0.6 and _local(change, k - first)]
    for k in sorted(peaks, key=lambda k: -change[k - first]):
        attacks = [i for i in sound["onsets"] if low <= i < k and 0.08 - 1e-9 <= (k - i) * STEP <= 0.22 + 1e-9]
        if not attacks:
            continue
        at = max(attacks)
        held = slice(at - first, k - first)
        heard = sound["pitch"][held]
        heard = heard[np.isfinite(heard)]
        if (sound["energy"][held] >= e.quiet).mean() < 0.8 or (b - k) * STEP < 0.12 - 1e-9 or e.before_b > at + 0.5:
            continue
        if len(heard) >= 3 and (np.abs(heard - e.midi) <= 0.6).mean() >= 0.7:
            return at, k, float(change[k - first])
    return None


def _parts(e, sound: dict) -> list[tuple[int, int, int, int, int | None, float | None]]:
    """(a, b, core_a, core_b, boundary, change) of an event cut where its spectrum turns at an attack with a dip or dropout."""
    change, first, energy, pitch, voiced = (sound[c] for c in ("change", "first", "energy", "pitch", "voiced"))
    out, start, core, mark = [], e.a, e.core_a, (None, None)
    radius = max(3, round(0.08 / STEP))
    for k in range(e.a + SIDE, e.b - SIDE):
        j = k - first
        if change[j] < 0.35 or not _local(change, j) or not any(abs(i - k) * STEP <= 0.05 for i in sound["onsets"]):
            continue
        left, right = max(start, k - radius), min(e.b, k + radius)
        sides = [x[np.isfinite(x)] for x in (pitch[left - first : j], pitch[j : right - first])]
        if any(len(x) < 3 or abs(np.median(x) - e.midi) > 0.5 for x in sides):
            continue
        near = slice(max(start, k - 2) - first, min(e.b, k + 3) - first)
        peak = max(energy[left - first : j].max(), energy[j : right - first].max())
        if peak < e.quiet or not (energy[near].min() < DIP * peak or (~voiced[near]).sum() >= 2):
            continue
        if (min(e.core_b, k) - core) * STEP < 0.048 - 1e-9 or (e.core_b - max(core, k)) * STEP < 0.048 - 1e-9:
            continue
        out.append((start, k, core, min(e.core_b, k), k, float(change[j])))
        start, core, mark = k, max(core, k), (k, float(change[j]))
    return [*out, (start, e.b, core, e.core_b, *mark)]


def _pieces(batches):
    for rows in batches:
        out = []
        for e in rows.itertuples():
            second = lambda i: None if i is None else round(i * STEP, 4)
            plain = (e.song_id, e.a, "note", second(e.a), second(e.b), e.midi)
            if e.uncertain or pd.isna(e.core_a) or not len(e.sound):
                cores_ = (None, None) if pd.isna(e.core_a) else (second(int(e.core_a)), second(int(e.core_b)))
                out.append((*plain, *cores_, e.uncertain, None, None, None))
                continue
            e = e._replace(core_a=int(e.core_a), core_b=int(e.core_b))
            s = sorted(e.sound, key=lambda r: r["i"])
            sound = {"first": s[0]["i"], "onsets": [r["i"] for r in s if r["onset"]], "voiced": np.array([bool(r["voiced"]) for r in s])}
            sound |= {c: np.array([np.nan if r[c] is None else r[c] for r in s], dtype=float) for c in ("pitch", "energy", "change")}
            sound["change"] = np.append(np.nan_to_num(sound["change"]), 0.0)
            found = _attack(e, sound)
            if found:
                out.append((e.song_id, e.a, "attack", second(found[0]), second(found[1]), e.midi, None, None, True, second(found[1]), round(found[2], 3), second(found[0])))
            for a, b, x, y, k, change in _parts(e._replace(b=min(e.b, s[-1]["i"] + 1)), sound):
                end = e.b if b == min(e.b, s[-1]["i"] + 1) else b
                out.append((e.song_id, e.a, "note" if k is None else "articulated", second(a), second(end), e.midi, second(x), second(y), False, second(k), None if change is None else round(change, 3), None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_articulations(events: DataFrame, sound: DataFrame) -> DataFrame:
    """SG9 over events (song_id, a, b, midi, core_a, core_b, uncertain) in frames and sound (song_id, i, pitch, voiced, energy, onset,
    change): PIECES. A certain event is cut into articulated pieces where spectrum, attack and a dip of energy or voicing
    agree and both cores keep 48 ms; an unvoiced attack before it is a row of kind attack, evidence that makes and moves no note.
    Other events stay as they are. A row holds the frames of one event."""
    order = Window.partitionBy("song_id").orderBy("a", "b")
    quiet = sound.groupBy("song_id").agg(F.greatest(F.lit(8e-4), F.max("energy") * 0.025).alias("quiet"))
    own = events.select("song_id", "a", "b", "midi", "core_a", "core_b", "uncertain").withColumn("before_b", F.coalesce(F.lag("b").over(order), F.lit(-1))).join(quiet, "song_id", "left")
    wanted = own.where("NOT uncertain AND core_a IS NOT NULL").select("song_id", "a", F.explode(F.sequence(F.greatest(F.col("a") - AHEAD, F.lit(0)), F.col("b"))).alias("i"))
    heard = wanted.join(sound, ["song_id", "i"]).groupBy("song_id", "a").agg(F.collect_list(F.struct("i", "pitch", "voiced", "energy", "onset", "change")).alias("sound"))
    none = F.array().cast("array<struct<i:bigint,pitch:double,voiced:boolean,energy:double,onset:boolean,change:double>>")
    return own.join(heard, ["song_id", "a"], "left").withColumn("sound", F.coalesce("sound", none)).mapInPandas(_pieces, PIECES)


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose spectrum turns where they are struck, from the frames of the test tables."""
    f = adapters.view(spark, sf_dir, "frames_of_cores")
    return f.select("song_id", "i", "pitch", "voiced", "energy", "onset", F.when(F.col("onset"), 0.7).otherwise(F.col("i") % 5 * 0.02).alias("change"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """A tone of 512 samples for each event, one after the other."""
    e = adapters.view(spark, sf_dir, "note_events").selectExpr("song_id", "row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) - 1 AS r", "midi")
    tone = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.sin(2 * np.pi * 220 * F.pow(F.lit(2.0), (F.col("midi") - 57) / 12) * i / RATE))
    return e.select("song_id", (F.col("r") * 512).alias("first"), F.lit(512).alias("size"), "midi"), tone


QUERIES = {
    "spectral_changes": lambda s, d: spectral_changes(*_blocks(s, d)),
    "articulation_splits": lambda s, d: split_articulations(adapters.view(s, d, "core_events"), _sound(s, d)),
}
