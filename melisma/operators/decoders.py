"""Sequential decoders: one Arrow/pandas group for each song or pair, bounded in size, numpy inside.

A group larger than its guard is refused with an error, as an alignment of that size could not be meant; groups are spread by
their keys. Every function sorts by explicit keys first, so results don't depend on how rows arrive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import SCALE
from ..sources import adapters

MOST_CELLS = 8_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions: groups of few bytes and much work would else be put into one task. One partition
    more, as Spark drops a repartitioning like the one it follows, and then joins the small partitions of that."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys)


def trace(steps: np.ndarray, i: int, j: int, stop: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs on the way back from cell (i, j): step 1 goes to both before, 2 to the row before, 3 to the column before."""
    pairs = []
    while not stop(i, j):
        if steps[i, j] == 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif steps[i, j] == 2:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def sweep(gain: np.ndarray, gap: float, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best totals of an alignment, cell by cell along antidiagonals; ties go to both, then row, then column."""
    n, m = gain.shape
    if (n + 1) * (m + 1) > MOST_CELLS:
        raise ValueError(f"an alignment of {n} by {m} is over {MOST_CELLS} cells: cut the input to sections")
    best, steps = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), dtype=np.int8)
    if not local:
        best[:, 0], best[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
        steps[1:, 0], steps[0, 1:] = 2, 3
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        options = np.stack([best[i - 1, j - 1] + gain[i - 1, j - 1], best[i - 1, j] + gap, best[i, j - 1] + gap])
        which = options.argmax(0)
        value = options[which, np.arange(len(i))]
        steps[i, j] = which + 1
        if local:
            steps[i, j] = np.where(value > 0, which + 1, 0)
            value = np.maximum(value, 0)
        best[i, j] = value
    return best, steps


def batches_of(sizes: list[tuple[int, int]], most: int = 400_000) -> list[list[int]]:
    """Places of pairs of like size (rows, columns) that are aligned together: of one batch, `most` cells of an antidiagonal at most."""
    like = [int(3 * np.log2(n)) for n, _ in sizes]
    out: list[list[int]] = []
    wide = 0
    for k in sorted(range(len(sizes)), key=lambda k: (like[k], sizes[k][1])):
        wide = max(wide, sizes[k][0] + 1)
        if not out or like[k] != like[out[-1][0]] or sizes[k][1] > 1.3 * sizes[out[-1][0]][1] + 8 or (len(out[-1]) + 1) * wide > most:
            out.append([])
            wide = sizes[k][0] + 1
        out[-1].append(k)
    return out


def sweep_together(sizes: list[tuple[int, int]], gain: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]], gap, local: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """What sweep() and trace() tell of many pairs, along their common antidiagonals: best totals (local: the highest cell), and of
    the pairs on each way back how many have each trait; ties go as in sweep().

    gain(i, j) has, for all pairs, what cells (i, j) earn and their traits; local: cells beyond a pair's own must earn less than nothing. Counts go forward with the ways, so that three
    antidiagonals are held, whatever the texts' length."""
    if any((n + 1) * (m + 1) > MOST_CELLS for n, m in sizes):
        raise ValueError(f"an alignment is over {MOST_CELLS} cells: cut the input to sections")
    n, m = np.array(sizes).T
    wide, high = int(n.max()), int(m.max())
    kind = np.asarray(gap).dtype
    before = last = np.zeros((len(n), wide + 1), dtype=kind)
    counts_before = counts_last = None
    total, traits = np.zeros(len(n), dtype=kind), None
    for s in range(wide + high + 1):
        i = np.arange(max(0, s - high), min(wide, s) + 1)
        now = np.zeros_like(last)
        if not local:
            now[:, 0] = gap * s
            if s <= wide:
                now[:, s] = gap * s
        inner = i[(i > 0) & (i < s)]
        counts = None
        if len(inner):
            a, b = int(inner[0]), int(inner[-1]) + 1
            earned, found = gain(inner - 1, s - inner - 1)
            both, row, column = before[:, a - 1 : b - 1] + earned, last[:, a - 1 : b - 1] + gap, last[:, a:b] + gap
            aside = np.maximum(row, column)
            value = np.maximum(both, aside)
            now[:, a:b] = np.maximum(value, 0) if local else value
            if not local:
                which, up = both >= aside, row >= column
                counts = [np.zeros((len(n), wide + 1), dtype=np.int32) for _ in found]
                for k, trait in enumerate(found):
                    x = counts_before[k][:, a - 1 : b - 1] + trait if counts_before else trait.astype(np.int32)
                    y, z = (counts_last[k][:, a - 1 : b - 1], counts_last[k][:, a:b]) if counts_last else (0, 0)
                    counts[k][:, a:b] = np.where(which, x, np.where(up, y, z))
                traits = traits or [np.zeros(len(n), dtype=np.int64) for _ in found]
            else:
                total = np.maximum(total, now[:, a:b].max(1))
        ends = np.flatnonzero(n + m == s)
        if len(ends) and not local:
            total[ends] = now[ends, n[ends]]
            for k, c in enumerate(counts or ()):
                traits[k][ends] = c[ends, n[ends]]
        before, last, counts_before, counts_last = last, now, counts_last, counts
    return total, traits or []


def _padded(rows: list[np.ndarray], fill) -> np.ndarray:
    out = np.full((len(rows), max(len(r) for r in rows)), fill)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def align_globally(gain: np.ndarray, gap: float) -> tuple[float, list[tuple[int, int]]]:
    best, steps = sweep(gain, gap, local=False)
    return float(best[-1, -1]), trace(steps, *gain.shape, lambda i, j: i == 0 and j == 0)


def align_locally(gain: np.ndarray, gap: float) -> tuple[float, list[tuple[int, int]]]:
    best, steps = sweep(gain, gap, local=True)
    i, j = np.unravel_index(int(best.argmax()), best.shape)
    return float(best[i, j]), trace(steps, int(i), int(j), lambda i, j: steps[i, j] == 0)


def _letters(text: str | None) -> np.ndarray:
    return np.array([ord(c) for c in (text or "") if c.isalnum()], dtype=np.int64)


def correct_text(pairs: DataFrame, most: float = 0.6) -> DataFrame:
    """DP1, DP2 over (pair_id, heard, correct): edit distance, whether it is close enough, characters that keep their time, and the local
    score. Of a text without letters all characters differ. A pair over MOST_CELLS is refused: no figures, and the reason `size`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        texts, places = [], []
        for r in rows.itertuples():
            a, b = _letters(r.heard), _letters(r.correct)
            if (len(a) + 1) * (len(b) + 1) > MOST_CELLS:
                out.append((r.pair_id, None, None, None, None, "size"))
            elif not len(a) or not len(b):
                out.append((r.pair_id, max(len(a), len(b)), False, 0, 0.0, None))
            else:
                places.append(len(out))
                texts.append((a, b))
                out.append((r.pair_id,))
        sizes = [(len(a), len(b)) for a, b in texts]
        for batch in batches_of(sizes):
            x, y = _padded([texts[k][0] for k in batch], -1).astype(np.int32), _padded([texts[k][1] for k in batch], -2).astype(np.int32)
            own = [sizes[k] for k in batch]

            def edits(i, j):
                same = x[:, i] == y[:, j]  # noqa: B023
                return np.where(same, np.int32(0), np.int32(-1)), [same]

            total, (kept,) = sweep_together(own, edits, np.int32(-1))
            # tenths: 2 for the same letter, -1.1 for another, -0.8 for a gap
            local, _ = sweep_together(own, lambda i, j: (np.where(x[:, i] == y[:, j], np.int32(20), np.int32(-11)), []), np.int32(-8), local=True)  # noqa: B023
            for k, cost, held, best in zip(batch, (-total).tolist(), kept.tolist(), local.tolist(), strict=True):
                out[places[k]] = (*out[places[k]], cost, cost / max(sizes[k]) <= most, held, round(best / 10, 4), None)
        found = pd.DataFrame(out, columns=["pair_id", "distance", "accepted", "kept", "local_score", "refused"])
        return found.astype({"distance": "Int64", "kept": "Int64", "accepted": "boolean", "local_score": "Float64"})

    schema = "pair_id long, distance long, accepted boolean, kept long, local_score double, refused string"
    # the window that made the pairs may have left them in few partitions
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(lambda batches: (run(b) for b in batches), schema)


def compare_scores(notes: DataFrame) -> DataFrame:
    """DP3 over (pair_id, side, place, midi, ticks): matched, different and unmatched notes of each pair of scores."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        scores, places = [], []
        for r in rows.itertuples():
            a, b = np.asarray(r.left, dtype=float).reshape(-1, 2), np.asarray(r.right, dtype=float).reshape(-1, 2)
            if not len(a) or not len(b):
                out.append((r.pair_id, 0, 0, len(a), len(b), 2.0 * max(len(a), len(b))))
            else:
                places.append(len(out))
                scores.append((a, b))
                out.append((r.pair_id,))
        sizes = [(len(a), len(b)) for a, b in scores]
        for batch in batches_of(sizes):
            (x, u), (y, v) = ([_padded([scores[k][side][:, c] for k in batch], 1.0) for c in (0, 1)] for side in (0, 1))

            def costs(i, j):
                p, q = x[:, i], y[:, j]  # noqa: B023
                pitch = np.where(np.isnan(p) != np.isnan(q), 3.0, np.minimum(2.5, 0.35 * np.abs(np.nan_to_num(p) - np.nan_to_num(q))))
                length = np.abs(np.log2(u[:, i] / v[:, j]))  # noqa: B023
                return -(pitch + np.minimum(1.0, 0.4 * length)), [np.ones(p.shape, dtype=bool), (pitch > 0) | (length > 1e-7)]

            total, (matched, different) = sweep_together([sizes[k] for k in batch], costs, -2.0)
            for k, cost, both, other in zip(batch, total.tolist(), matched.tolist(), different.tolist(), strict=True):
                out[places[k]] = (*out[places[k]], both, other, sizes[k][0] - both, sizes[k][1] - both, round(-cost, 6))
        return pd.DataFrame(out, columns=["pair_id", "matched", "different", "left_only", "right_only", "cost"])

    nan = F.lit(float("nan"))
    order = F.struct("place", F.coalesce("midi", nan).cast("double").alias("midi"), F.col("ticks").cast("double").alias("ticks"))
    sides = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, order))), lambda n: F.array(n["midi"], n["ticks"]))).alias(name) for s, name in enumerate(("left", "right"))]
    return spread(notes.groupBy("pair_id").agg(*sides), "pair_id").mapInPandas(lambda batches: (run(b) for b in batches), "pair_id long, matched long, different long, left_only long, right_only long, cost double")


def increasing_chain(points: DataFrame) -> DataFrame:
    """DP4 over (pair_id, left_at, right_at, weight): the heaviest chain that rises on both sides."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["left_at", "right_at"])
        x, y, w = (rows[c].to_numpy() for c in ("left_at", "right_at", "weight"))
        best, before = w.astype(float).copy(), np.full(len(w), -1)
        for i in range(1, len(w)):
            ok = np.flatnonzero((x[:i] < x[i]) & (y[:i] < y[i]))
            if len(ok) and best[at := ok[best[ok].argmax()]] > 0:
                best[i], before[i] = best[at] + w[i], at
        at, chain = int(best.argmax()), []
        while at >= 0:
            chain.append(at)
            at = int(before[at])
        return pd.DataFrame({"pair_id": key[0], "left_at": x[chain[::-1]], "right_at": y[chain[::-1]]})

    return points.groupBy("pair_id").applyInPandas(run, "pair_id long, left_at long, right_at long")


def quantize_onsets(events: DataFrame) -> DataFrame:
    """DP5 over (song_id, event_id, unit, weight): strictly rising grid units near the observed ones, odd gaps slightly dearer.

    Where no unit is left for an event, the heavier of it and the one before stays.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["unit", "event_id"])
        # a state: (unit, cost, chain); chains share their tails
        states: list[tuple[float, float, tuple | None]] = [(-np.inf, 0.0, None)]
        for event_id, seen, weight in rows[["event_id", "unit", "weight"]].itertuples(index=False):
            options = sorted({max(0, int(np.floor(seen))), max(0, int(np.ceil(seen)))})
            fresh = []
            for unit in options:
                reached = [(cost + (unit - seen) ** 2 + (0.08 if np.isfinite(u) and unit - u > 1 and (unit - u) % 2 == 1 else 0.0), chain) for u, cost, chain in states if u < unit]
                if reached:
                    cost, chain = min(reached, key=lambda r: r[0])
                    fresh.append((unit, cost, ((event_id, unit, weight), chain)))
            if fresh:
                states = fresh
                continue
            u, cost, chain = min(states, key=lambda s: s[1])
            (_, _, held), tail = chain
            before = tail[0][1] if tail else -np.inf
            nearest = max(0, int(np.floor(seen + 0.5)))
            states = [(nearest, cost, ((event_id, nearest, weight), tail))] if weight > held and nearest > before else [(u, cost, chain)]
        out, chain = [], min(states, key=lambda s: s[1])[2]
        while chain:
            out.append(chain[0][:2])
            chain = chain[1]
        return pd.DataFrame([(key[0], *o) for o in out[::-1]], columns=["song_id", "event_id", "unit"])

    return events.groupBy("song_id").applyInPandas(run, "song_id long, event_id long, unit long")


def track_beats(onsets: DataFrame, lag: int) -> DataFrame:
    """DP7 over (song_id, frame, strength): frames of a pulse near the lag that collects most strength."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        strength = np.zeros(int(rows["frame"].max()) + 1)
        np.add.at(strength, rows["frame"].to_numpy(), rows["strength"].to_numpy())
        apart = np.arange(max(1, round(0.65 * lag)), round(1.45 * lag) + 1)
        price = -25 * np.log(apart / lag) ** 2
        total, link = strength.copy(), np.full(len(strength), -1)
        for t in range(int(apart[0]), len(strength)):
            back = apart[apart <= t]
            reached = total[t - back] + price[: len(back)]
            if reached.max() > 0:
                at = int(reached.argmax())
                total[t], link[t] = strength[t] + reached[at], t - back[at]
        first = max(0, len(total) - 2 * lag)
        at, beats = first + int(total[first:].argmax()), []
        while at >= 0:
            beats.append(at)
            at = int(link[at])
        return pd.DataFrame({"song_id": key[0], "beat": range(len(beats)), "frame": beats[::-1]})

    return onsets.groupBy("song_id").applyInPandas(run, "song_id long, beat long, frame long")


#: Chord kinds and their intervals.
CHORDS = {"": [0, 4, 7], "m": [0, 3, 7], "7": [0, 4, 7, 10], "maj7": [0, 4, 7, 11], "m7": [0, 3, 7, 10]}


def chord_templates() -> np.ndarray:
    """Unit vectors of the 60 chords: 1 for chord notes, -.18 for others."""
    rows = []
    for root in range(12):
        for intervals in CHORDS.values():
            t = np.full(12, -0.18)
            t[[(root + i) % 12 for i in intervals]] = 1
            rows.append(t / np.linalg.norm(t))
    return np.array(rows)


def decode_chords(windows: DataFrame, switch: float = 0.12) -> DataFrame:
    """DP8, SG6, J17 over (song_id, window, chroma): the chord of each window, changes costing `switch`."""
    templates = chord_templates()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window")
        v = np.stack(rows["chroma"].to_numpy()).astype(float)
        fit = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ templates.T
        total, back = fit[0].copy(), []
        for row in fit[1:]:
            other = int(total.argmax())
            stay = total >= total[other] - switch
            back.append(np.where(stay, np.arange(len(total)), other))
            total = np.where(stay, total, total[other] - switch) + row
        path = [int(total.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return pd.DataFrame({"song_id": key[0], "window": rows["window"].to_numpy(), "root": [p // 5 for p in path], "kind": [list(CHORDS)[p % 5] for p in path], "score": np.round(fit[np.arange(len(path)), path], 6)})

    return windows.groupBy("song_id").applyInPandas(run, "song_id long, window long, root int, kind string, score double")


def lead_path(candidates: DataFrame) -> DataFrame:
    """DP14 over (song_id, step, midi, weight): one pitch a step, leaps costing .16 a semitone up to 24."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["step", "midi"])
        steps = [g for _, g in rows.groupby("step")]
        total, back = steps[0]["weight"].to_numpy(float), []
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            leap = 0.16 * np.minimum(24, np.abs(b["midi"].to_numpy()[:, None] - a["midi"].to_numpy()[None, :]))
            reached = total[None, :] - leap
            back.append(reached.argmax(1))
            total = reached.max(1) + b["weight"].to_numpy(float)
        path = [int(total.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return pd.DataFrame({"song_id": key[0], "step": [int(g["step"].iat[0]) for g in steps], "midi": [int(g["midi"].iat[p]) for g, p in zip(steps, path, strict=True)]})

    return candidates.groupBy("song_id").applyInPandas(run, "song_id long, step long, midi long")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def segment_events(frames: DataFrame, step: float, seed: float = 0.65, follow: float = 0.35) -> DataFrame:
    """SG10, W1, W11, W12 over (song_id, frame, pitch, confidence, energy): note events from frames.

    A run of followable frames with a sure one in it is labelled by its rounded pitches; labels without a sure frame go. A short
    excursion between equal neighbours is smoothed, a short dropout of sustained energy filled, each seeing the passes before it.
    Where frames have `onset`, a note is cut at those before which its energy dips.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        pitch, sure, energy = (rows[c].to_numpy(float) for c in ("pitch", "confidence", "energy"))
        label = np.zeros(len(pitch), dtype=int)
        usable = np.isfinite(pitch) & (sure >= follow)
        for a, b in _runs(usable):
            if usable[a] and (sure[a:b] >= seed).any():
                label[a:b] = np.rint(pitch[a:b])
        for a, b in _runs(label):
            if label[a] and not (sure[a:b] >= seed).any():
                label[a:b] = 0
        for a, b in _runs(label):
            if 0 < a and b < len(label) and label[a] and label[a - 1] and label[a - 1] == label[b]:
                longest, leap = (0.12 if sure[a:b].mean() < 0.8 else 0.064), abs(label[a] - label[b])
                if (b - a) * step <= longest and (leap <= 2 or leap == 12):
                    label[a:b] = label[b]
        for a, b in _runs(label):
            if 0 < a and b < len(label) and not label[a] and label[b] and label[a - 1] == label[b] and (b - a) * step <= 0.096:
                edge = min(energy[a - 1], energy[b])
                if edge > 0 and energy[a:b].min() >= 0.45 * edge:
                    label[a:b] = label[b]
        struck = np.flatnonzero(rows["onset"].to_numpy(dtype=bool)).tolist() if "onset" in rows else []
        found = []
        for first, last in _runs(label):
            if not label[first] or (last - first) * step < 0.075:
                continue
            cuts = [first]
            for k in struck:
                if first < k < last and k - cuts[-1] >= round(0.12 / step) and last - k >= round(0.09 / step) and k + 2 < len(energy):
                    before, after = energy[max(first, k - round(0.09 / step)) : k], energy[k : min(last, k + round(0.08 / step))]
                    if before.min() < 0.65 * after.max():
                        cuts.append(k)
            found += [(key[0], round(a * step, 4), round(b * step, 4), int(label[a]), round(float(sure[a:b].mean()), 3)) for a, b in zip(cuts, [*cuts[1:], last], strict=True)]
        return pd.DataFrame(found, columns=["song_id", "start_s", "end_s", "midi", "confidence"])

    return frames.groupBy("song_id").applyInPandas(run, "song_id long, start_s double, end_s double, midi int, confidence double")


def spaced_cuts(onsets: DataFrame, least: float) -> DataFrame:
    """W21, W19, K5 over (song_id, at): onsets at least `least` after the last one kept."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], -np.inf
        for t in np.sort(rows["at"].to_numpy(float)):
            if t - last >= least:
                kept.append(t)
                last = t
        return pd.DataFrame({"song_id": key[0], "at": kept})

    return onsets.groupBy("song_id").applyInPandas(run, "song_id long, at double")


def pack_rows(measures: DataFrame, most: int = 4, width: float = 1180.0) -> DataFrame:
    """W18 over (score_id, m_idx, width, break_before): rows of up to `most` measures, of one less when they are too wide."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("m_idx")
        row, held, wide, out = 0, 0, 0.0, []
        for w, fresh in rows[["width", "break_before"]].itertuples(index=False):
            full = held >= most or (held >= most - 1 and wide + w > width)
            if held and (fresh or full):
                row, held, wide = row + 1, 0, 0.0
            held, wide = held + 1, wide + w
            out.append(row)
        return pd.DataFrame({"score_id": key[0], "m_idx": rows["m_idx"].to_numpy(), "page_row": out})

    return measures.groupBy("score_id").applyInPandas(run, "score_id long, m_idx long, page_row long")


def tempo(onsets: DataFrame, frame_s: float) -> DataFrame:
    """SG1 over (song_id, frame, strength): tempo of the strongest autocorrelation, tempi near 120 preferred."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(int(rows["frame"].max()) + 1)
        np.add.at(x, rows["frame"].to_numpy(), rows["strength"].to_numpy())
        x = x - x.mean()
        spectrum = np.fft.rfft(x, 2 * len(x))
        same = np.fft.irfft(spectrum * np.conj(spectrum))[: len(x)]
        lags = np.arange(1, len(x) // 2)
        if not len(lags):
            return pd.DataFrame({"song_id": [key[0]], "bpm": [None]}).astype({"bpm": "float64"})
        bpm = 60 / (lags * frame_s)
        score = same[lags] * np.exp(-0.5 * (np.log2(bpm / 120)) ** 2)
        return pd.DataFrame({"song_id": [key[0]], "bpm": [round(float(bpm[score.argmax()]), 4)]})

    return onsets.groupBy("song_id").applyInPandas(run, "song_id long, bpm double")


def spectrum(samples: DataFrame, size: int = 64) -> DataFrame:
    """SC20 over (song_id, place, x): decibels of each frequency of Hann windows that overlap by half."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("place")["x"].to_numpy(float)
        x = np.pad(x, (0, max(0, size - len(x))))
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2] * np.hanning(size)
        power = 20 * np.log10(np.maximum(np.abs(np.fft.rfft(frames)), 1e-9))
        at, bin_ = np.indices(power.shape)
        return pd.DataFrame({"song_id": key[0], "window": at.ravel(), "bin": bin_.ravel(), "db": np.round(power.ravel(), 4)})

    return samples.groupBy("song_id").applyInPandas(run, "song_id long, window long, bin int, db double")


def group_cores(cores: DataFrame, span: float = 0.45, price: float = 0.7, reach: int = 24) -> DataFrame:
    """DP6 over (song_id, place, center, length): neighbouring stable cores in groups of nearly one pitch.

    A group costs `price` plus 8 times its weighted variance, spans `span` semitones and `reach` cores at most.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x, w = rows["center"].to_numpy(float), rows["length"].to_numpy(float)
        sums = [np.concatenate(([0.0], np.cumsum(v))) for v in (w, w * x, w * x * x)]
        cost, start = np.full(len(x) + 1, np.inf), np.zeros(len(x) + 1, dtype=int)
        cost[0] = 0
        for end in range(1, len(x) + 1):
            first = np.arange(max(0, end - reach), end)
            back = x[first[0] : end][::-1]
            wide = (np.maximum.accumulate(back) - np.minimum.accumulate(back))[::-1]
            first = first[wide <= span]
            total, mean, square = (s[end] - s[first] for s in sums)
            offered = cost[first] + price + 8 * np.maximum(0, square / total - (mean / total) ** 2)
            start[end] = first[offered.argmin()]
            cost[end] = offered.min()
        bounds, end = [], len(x)
        while end:
            bounds.append((start[end], end))
            end = start[end]
        group = np.repeat(np.arange(len(bounds)), [b - a for a, b in bounds[::-1]])
        return pd.DataFrame({"song_id": key[0], "place": rows["place"].to_numpy(), "core_group": group})

    return cores.groupBy("song_id").applyInPandas(run, "song_id long, place long, core_group long")


def align_phrases(lines: DataFrame, blank: int = 0) -> DataFrame:
    """DP11 over (line_id, frame, log_probs, tokens): frames of each token of a short phrase, which may begin and end anywhere.

    The usual expansion with blanks between tokens; a line for which no path holds all tokens has no rows.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        tokens = list(rows["tokens"].iat[0])
        states = np.full(2 * len(tokens) + 1, blank)
        states[1::2] = tokens
        fit = np.stack(rows["log_probs"].to_numpy())[:, states]
        skip = np.zeros(len(states), dtype=bool)
        skip[3::2] = states[3::2] != states[1:-2:2]
        total, moves = np.full(len(states), -np.inf), np.zeros(fit.shape, dtype=np.int8)
        total[0], ends = 0.0, []
        for t, row in enumerate(fit):
            options = np.full((3, len(states)), -np.inf)
            options[0], options[1, 1:] = total, total[:-1]
            options[2, 2:] = np.where(skip[2:], total[:-2], -np.inf)
            moves[t] = options.argmax(0)
            total = options.max(0) + row
            total[0] = 0.0  # a phrase may begin after any frame
            ends += [(total[-1], t, len(states) - 1), (total[-2], t, len(states) - 2)] if tokens else []
        best, t, s = max(ends, default=(-np.inf, 0, 0), key=lambda e: e[0])
        held: list[list[int]] = [[] for _ in tokens]
        while np.isfinite(best) and t >= 0 and s > 0:
            if s % 2:
                held[s // 2].append(t)
            s, t = s - int(moves[t, s]), t - 1
        rows_out = [(key[0], i, min(f), max(f) + 1, round(float(np.exp(fit[f, 2 * i + 1].mean())), 6)) for i, f in enumerate(held) if f] if all(held) else []
        return pd.DataFrame(rows_out, columns=["line_id", "token_place", "frame_from", "frame_to", "probability"])

    return lines.groupBy("line_id").applyInPandas(run, "line_id long, token_place long, frame_from long, frame_to long, probability double")


#: Open strings of a guitar from low to high, and the shapes that players know.
STRINGS = [40, 45, 50, 55, 59, 64]
SHAPES = {
    "C": [-1, 3, 2, 0, 1, 0], "Cm": [-1, 3, 5, 5, 4, 3], "D": [-1, -1, 0, 2, 3, 2], "Dm": [-1, -1, 0, 2, 3, 1], "E": [0, 2, 2, 1, 0, 0], "Em": [0, 2, 2, 0, 0, 0], "F": [1, 3, 3, 2, 1, 1], "G": [3, 2, 0, 0, 0, 3],
    "A": [-1, 0, 2, 2, 2, 0], "Am": [-1, 0, 2, 2, 1, 0], "B7": [-1, 2, 1, 2, 0, 2], "C7": [-1, 3, 2, 3, 1, 0], "D7": [-1, -1, 0, 2, 1, 2], "E7": [0, 2, 0, 1, 0, 0], "G7": [3, 2, 0, 0, 0, 1], "A7": [-1, 0, 2, 0, 2, 0],
    "Am7": [-1, 0, 2, 0, 1, 0], "Dm7": [-1, -1, 0, 2, 1, 1], "Bm": [-1, 2, 4, 4, 3, 2], "Bdim": [-1, 2, 3, 4, 3, -1], "F#dim": [-1, -1, 4, 2, 1, 2], "Gmaj7": [3, 2, 0, 0, 0, 2], "Bm7": [-1, 2, 4, 2, 3, 2], "Gbm": [2, 4, 4, 2, 2, 2],
    "Gbm7": [2, 4, 2, 2, 2, 2], "Dmaj7": [-1, -1, 0, 2, 2, 2], "Cadd9": [-1, 3, 2, 0, 3, 3], "Fadd9": [-1, -1, 3, 2, 1, 3], "Dadd9": [-1, 5, 4, 2, 5, -1], "Cmaj9": [-1, 3, 2, 4, 3, -1], "Dm9": [-1, 5, 3, 5, 5, -1], "G13": [3, -1, 3, 4, 5, -1],
    "D13": [-1, 5, -1, 5, 7, 7], "Am9": [-1, 0, 5, 5, 0, 0], "Cmaj7": [-1, 3, 2, 0, 0, 0], "Fmaj7": [-1, -1, 3, 2, 1, 0], "Em7": [0, 2, 0, 0, 0, 0],
}
_LABEL = re.compile(r"([A-G])([#b]?)((?:m|maj|dim|aug|sus2|sus4|sus|add9|madd9)?(?:7|9|11|13)?)(?:/([A-G])([#b]?))?")
_LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


@dataclass(frozen=True)
class Voicing:
    """Pitch classes a chord may sound and those it must, its root, and the bass it names."""

    root: int
    may: frozenset[int]
    must: frozenset[int]
    bass: int | None


def voicing(label: str) -> Voicing | None:
    """SC18: what a label asks of a hand; extended chords may leave fifths and inner extensions out. None of an unknown label."""
    m = _LABEL.fullmatch(label)
    if not m:
        return None
    pc = lambda letter, sign: (_LETTERS[letter] + {"#": 1, "b": -1}.get(sign, 0)) % 12
    root, kind = pc(m[1], m[2]), m[3]
    minor, dim = kind.startswith("m") and not kind.startswith("maj"), kind.startswith("dim")
    third = 2 if kind.startswith("sus2") else 5 if kind.startswith("sus") else 3 if dim or minor else 4
    steps = [0, third, 6 if dim else 8 if kind.startswith("aug") else 7]
    number = re.search(r"(7|9|11|13)$", kind)
    added, high = "add" in kind, int(number[1]) if number else 0
    seventh = 11 if kind.startswith("maj") else 9 if dim else 10
    steps += [seventh] * (high > 0 and not added) + [2] * (high >= 9) + [5] * (high >= 11) + [9] * (high >= 13)
    must = steps
    if high >= 9:
        must = [0, third] + [seventh] * (not added) + [{9: 2, 11: 5, 13: 9}[high]]
    elif high == 7:
        must = [0, third, seventh]
    of = lambda xs: frozenset((root + x) % 12 for x in xs)
    return Voicing(root, of(steps), of(must), pc(m[4], m[5]) if m[4] else None)


def fingering(label: str) -> list[int]:
    """SC18: the frets (-1: muted) of a label: the shape that players know, if it does, else the easiest within four frets; what is
    easy is stated in `price`. Empty for a label that is none or that no hand can reach."""
    chord = voicing(label)
    if chord is None:
        return []
    grids = [np.array([SHAPES[label]])] if label in SHAPES else []
    best = _easiest(grids, chord) if grids else []
    if best:
        return best
    for base in range(1, 10):
        choices = [[-1] + [f for f in sorted({0, *range(base, base + 4)}) if (s + f) % 12 in chord.may] for s in STRINGS]
        grids.append(np.stack([g.ravel() for g in np.meshgrid(*choices, indexing="ij")], 1))
    return _easiest(grids, chord)


def _easiest(grids: list[np.ndarray], chord: Voicing) -> list[int]:
    frets = np.unique(np.concatenate(grids), axis=0)
    sounds = frets >= 0
    pitch = np.where(sounds, frets + np.array(STRINGS), 999)
    pressed = np.where(frets > 0, frets, 99).min(1)
    span = np.where(frets.max(1) > 0, frets.max(1) - np.minimum(pressed, frets.max(1)), 0)
    complete = np.all([((pitch % 12 == p) & sounds).any(1) for p in chord.must], axis=0) & (np.isin(pitch % 12, list(chord.may)) | ~sounds).all(1)
    first = (frets == pressed[:, None]) & (frets > 0)
    # a bar is laid where the lowest fret stands twice and nothing between its ends sounds below
    low, high = first.argmax(1), 5 - first[:, ::-1].argmax(1)
    between = (np.arange(6) >= low[:, None]) & (np.arange(6) <= high[:, None])
    barred = (first.sum(1) >= 2) & ~(between & sounds & (frets < pressed[:, None])).any(1)
    fingers = (frets > 0).sum(1) - np.where(barred, first.sum(1) - 1, 0)
    bass = chord.root if chord.bass is None else chord.bass
    fits = complete & (pitch.min(1) % 12 == bass) & (sounds.sum(1) >= 3) & (span <= 3) & (fingers <= 4)
    price = 0.7 * (~sounds).sum(1) + 0.5 * span + 0.12 * frets.max(1) + 0.8 * barred + 0.6 * (pitch.min(1) % 12 != chord.root)
    return frets[fits][np.round(price[fits], 9).argmin()].tolist() if fits.any() else []


def fingerings(chords: DataFrame) -> DataFrame:
    """SC18 over (score_id, measure_id, label): each chord with the frets of its label. A label is searched once, however often it
    stands, in Arrow batches of the distinct labels; unknown labels have no frets."""
    labels = chords.select("label").where("label IS NOT NULL").distinct()

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"label": rows["label"], "frets": [fingering(x) for x in rows["label"]]})

    return chords.select("score_id", "measure_id", "label").join(labels.mapInPandas(run, "label string, frets array<int>"), "label", "left")


# --- the decoders on the driver's tables --------------------------------------------------------------------------------


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets of each song in sixteenths of 120 beats a minute, and on frames as long."""
    e = adapters.view(spark, sf_dir, "note_events")
    first = e.groupBy("song_id").agg(F.min("start_s").alias("first"))
    return e.join(first, "song_id").select("song_id", "event_id", "midi", "pitch_center", "confidence", F.floor((F.col("start_s") - F.col("first")) / 0.125).cast("long").alias("frame"), ((F.col("start_s") - F.col("first")) / 0.125).alias("unit"), F.col("confidence").alias("strength"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line and the next of its conversation."""
    lines = adapters.view(spark, sf_dir, "lines")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return lines.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("heard"), after.alias("correct")).where("correct IS NOT NULL")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = adapters.view(spark, sf_dir, "notes")
    scale = F.element_at(F.array(*[F.lit(v) for v in SCALE]), F.greatest(F.col("degree"), F.lit(1)).cast("int"))
    midi = F.when(F.col("degree") > 0, 60 + scale + 12 * F.col("octave") + F.col("accidental"))
    ticks = F.lit(64.0) / F.col("base") * F.when(F.col("dots") == 1, 1.5).otherwise(1.0)
    return n.select((F.floor(F.col("score_id") / 2)).alias("pair_id"), (F.col("score_id") % 2).alias("side"), (F.col("m_idx") * 1000 + F.col("n_idx")).alias("place"), midi.cast("double").alias("midi"), ticks.alias("ticks"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.view(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 20).cast("long").alias("song_id"), F.col("vec_id").cast("long").alias("window"), F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _onsets(spark, sf_dir)
    order = "row_number() OVER (PARTITION BY song_id ORDER BY unit, event_id)"
    return e.withColumn("place", F.expr(order)).select("song_id", F.explode(F.sequence(F.col("place") * 4, F.col("place") * 4 + 3)).alias("frame"), (F.col("pitch_center") - F.col("midi") % 5).alias("pitch"), "confidence", F.col("confidence").alias("energy"))


QUERIES = {
    "text_correction": lambda s, d: correct_text(_pairs(s, d)),
    "score_comparison": lambda s, d: compare_scores(_written(s, d)),
    "monotone_chain": lambda s, d: increasing_chain(_onsets(s, d).select(F.col("song_id").alias("pair_id"), F.col("frame").alias("left_at"), F.col("midi").alias("right_at"), F.lit(1).alias("weight"))),
    "onset_quantization": lambda s, d: quantize_onsets(_onsets(s, d).select("song_id", "event_id", "unit", F.col("strength").alias("weight"))),
    "beat_tracking": lambda s, d: track_beats(_onsets(s, d), 8),
    "chord_decoding": lambda s, d: decode_chords(_windows(s, d)),
    "lead_path": lambda s, d: lead_path(_onsets(s, d).groupBy("song_id", F.floor(F.col("frame") / 24).alias("step"), "midi").agg(F.sum("strength").alias("weight"))),
    "event_segmentation": lambda s, d: segment_events(_frames(s, d), 0.016),
    "spaced_cuts": lambda s, d: spaced_cuts(_onsets(s, d).select("song_id", F.col("unit").alias("at")), 6.0),
    "row_packing": lambda s, d: pack_rows(adapters.view(s, d, "notes").groupBy("score_id", "m_idx").agg((F.count(F.lit(1)) * 90.0).alias("width"), (F.col("m_idx") % 8 == 0).alias("break_before"))),
    "tempo_autocorrelation": lambda s, d: tempo(_onsets(s, d), 0.125),
    "core_groups": lambda s, d: group_cores(_onsets(s, d).select("song_id", F.col("event_id").alias("place"), F.col("pitch_center").alias("center"), F.col("confidence").alias("length"))),
    "guitar_fingerings": lambda s, d: fingerings(adapters.view(s, d, "chords")),
    "hann_spectrum": lambda s, d: spectrum(_onsets(s, d).select("song_id", F.expr("row_number() OVER (PARTITION BY song_id ORDER BY unit, event_id)").alias("place"), F.col("pitch_center").alias("x"))),
}
