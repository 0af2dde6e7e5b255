"""Harmony of a written melody: tone weights of half measures as joins and windows, then one beam for each score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import KEY_NAMES, SCALE
from ..sources import adapters
from .decoders import spread

#: Degrees of common progressions; kinds of chords on the degrees of the scale, plain and with sevenths; intervals.
PROGRESSIONS = [[4, 5, 3, 6], [4, 5, 3, 6, 2, 5, 1], [1, 5, 6, 4], [6, 4, 1, 5], [1, 6, 4, 5], [1, 6, 2, 5], [2, 5, 1], [1, 5, 6, 3, 4, 1, 4, 5]]
TRIADS = ["", "m", "m", "", "", "m", "dim"]
SEVENTHS = ["maj7", "m7", "m7", "maj7", "7", "m7"]
KINDS = {"": [0, 4, 7], "m": [0, 3, 7], "dim": [0, 3, 6], "7": [0, 4, 7, 10], "maj7": [0, 4, 7, 11], "m7": [0, 3, 7, 10]}
EXTENSIONS = {"9": [2], "11": [2, 5], "13": [2, 5, 9]}
#: How many paths a step keeps, and how far below a window's best a chord may lie.
BEAM, NEAR = 48, 0.18
#: Scores whose beams go on together.
TOGETHER = 128
_NEXT = {pair for p in PROGRESSIONS for pair in zip(p[:-1], p[1:], strict=True)}


@dataclass(frozen=True)
class Chord:
    """A chord on a degree (1 to 7) of the scale; tones are half tones above Do."""

    degree: int
    kind: str
    tones: tuple[int, ...]
    seventh: int | None = None
    extensions: tuple[int, ...] = ()

    def label(self, do_pc: int) -> str:
        return KEY_NAMES[(do_pc + SCALE[self.degree - 1]) % 12] + self.kind


def palette(color: bool) -> list[Chord]:
    """The chords that may be chosen: of the scale, with sevenths, and with extensions inside the scale where these are asked for."""
    made = []
    for kinds in (TRIADS, SEVENTHS):
        for degree, kind in enumerate(kinds, 1):
            tones = tuple((SCALE[degree - 1] + i) % 12 for i in KINDS[kind])
            made.append(Chord(degree, kind, tones, tones[3] if len(tones) > 3 else None))
    if color:
        for c in [c for c in made if c.seventh is not None]:
            for name, more in EXTENSIONS.items():
                extra = tuple((SCALE[c.degree - 1] + i) % 12 for i in more)
                if set(c.tones + extra) <= set(SCALE):
                    made.append(Chord(c.degree, c.kind.replace("7", name), c.tones + extra, c.seventh, extra))
    return made


def tone_weights(notes: DataFrame, scores: DataFrame, halves: bool = True) -> DataFrame:
    """(score_id, do_pc, m_idx, from_tick, to_tick, tones) of every measure or half measure: ticks that each half tone above Do sounds
    in it, half as much again for notes that begin with it. notes: (score_id, m_idx, n_idx, degree, accidental, ticks), degree 0
    for a rest; scores: (score_id, do_pc, capacity)."""
    own = Window.partitionBy("score_id", "m_idx")
    end = F.sum("ticks").over(own.orderBy("n_idx").rowsBetween(Window.unboundedPreceding, 0))
    placed = notes.join(scores, "score_id").withColumn("z", end).withColumn("a", F.col("z") - F.col("ticks")).withColumn("length", F.greatest("capacity", F.sum("ticks").over(own)))
    scale = F.element_at(F.array(*[F.lit(v) for v in SCALE]), F.greatest(F.col("degree"), F.lit(1)).cast("int"))
    pc = F.when(F.col("degree") > 0, F.pmod(scale + F.col("accidental"), F.lit(12)))
    cut = placed.withColumn("pc", pc).withColumn("step", F.col("length") / (2 if halves else 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(1 if halves else 0))))
    low, high = F.col("part") * F.col("step"), (F.col("part") + 1) * F.col("step")
    over = F.least(high, F.col("z")) - F.greatest(low, F.col("a"))
    weight = F.when(over > 0, over * F.when(F.abs(F.col("a") - low) < 1e-6, 1.5).otherwise(1.0)).otherwise(0.0)
    tones = F.array(*[F.sum(F.when(F.col("pc") == i, F.col("weight")).otherwise(0.0)) for i in range(12)])
    return cut.select("score_id", "do_pc", "m_idx", low.alias("from_tick"), high.alias("to_tick"), "pc", weight.alias("weight")).groupBy("score_id", "do_pc", "m_idx", "from_tick", "to_tick").agg(tones.alias("tones"))


class Fits(NamedTuple):
    """Of each window and chord: whether it may be chosen, how much of the melody it holds, how much of it is the seventh, its worth."""

    fit: np.ndarray
    support: np.ndarray
    seventh: np.ndarray
    value: np.ndarray


def _total(parts: list[np.ndarray]) -> np.ndarray:
    """The sum with its rounding errors put back, as sum() does with single numbers."""
    total, lost = np.zeros_like(parts[0]), np.zeros_like(parts[0])
    for x in parts:
        t = total + x
        lost += np.where(np.abs(total) >= np.abs(x), (total - t) + x, (x - t) + total)
        total = t
    return total + lost


def fits(tones: np.ndarray, chords: list[Chord], color: float) -> Fits:
    """Of windows (n, 12) and chords."""
    total = _total(list(tones.T))[:, None]
    heard = np.maximum(total, 1e-300)
    share = lambda of: np.stack([_total([tones[:, p] for p in set(of(c))]) if of(c) else np.zeros(len(tones)) for c in chords], 1) / heard
    support, seventh = share(lambda c: c.tones), share(lambda c: () if c.seventh is None else (c.seventh,))
    has7, dim, extended = (np.array(x) for x in ([c.seventh is not None for c in chords], [c.kind == "dim" for c in chords], [bool(c.extensions) for c in chords]))
    fit = (total > 0) & ~(has7 & (seventh < 0.2))
    if extended.any():
        fit &= ~(extended & (share(lambda c: c.extensions) < 0.2))
    return Fits(fit, support, seventh, support - 0.12 * dim - 0.04 * (1 - color) * extended)


def _moved(degrees: tuple[int, ...], last: int, same: bool, degree: int) -> float:
    """What going on to a degree is worth besides its fit; last is 0 after a silence."""
    degrees = (*degrees, degree)
    worth = 0.03 * ((last, degree) in _NEXT) + (0.015 if same else -0.04) if last else 0.0
    whole = [len(p) for p in PROGRESSIONS if degrees[-len(p) :] == tuple(p)]
    if whole:
        return worth + min(0.15, 0.025 * max(whole))
    return worth + 0.01 * any(len(p) > 3 and degrees[-3:] == tuple(p[:3]) for p in PROGRESSIONS)


@lru_cache(maxsize=2)
def _moves(color: bool) -> tuple[np.ndarray, np.ndarray]:
    """Worth (state, last chord + 1, chord) and next state (state, chord): a state is how much of a progression the degrees end with."""
    chords = palette(color)
    states = sorted({tuple(p[:i]) for p in PROGRESSIONS for i in range(len(p) + 1)}, key=len)
    index = {s: i for i, s in enumerate(states)}
    worth, goes = np.zeros((len(states), len(chords) + 1, len(chords))), np.zeros((len(states), len(chords)), dtype=np.int64)
    for i, s in enumerate(states):
        for j, c in enumerate(chords):
            on = (*s, c.degree)
            goes[i, j] = next(index[on[k:]] for k in range(len(on) + 1) if on[k:] in index)
            for k, last in enumerate([None, *chords]):
                worth[i, k, j] = _moved(s, last.degree if last else 0, last is c, c.degree)
    return worth, goes


def best_paths(found: Fits, lengths: np.ndarray, chords: list[Chord], sevenths: float, color: float) -> np.ndarray:
    """The chord of each window, -1 where none fits; windows of several scores follow each other, lengths tells how many each has.

    One beam for each score, which also keeps the best plain path of every number of sevenths; the beams go on together, one window
    with notes at a time.
    """
    worth, goes = _moves(any(c.extensions for c in chords))
    n_chords, wanted = len(chords), min(0.4, color)
    extends, sevens = np.array([bool(c.extensions) for c in chords]), np.array([c.seventh is not None and not c.extensions for c in chords])
    plains = np.array([c.seventh is None for c in chords])
    heard = found.fit.any(1)
    chosen_chord = np.full(len(heard), -1, dtype=np.int64)
    at = np.flatnonzero(heard)
    if not len(at):
        return chosen_chord
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = (np.cumsum(lengths) - lengths)[owner[at]]
    rest = np.ones(len(heard), dtype=bool)  # whether a silence, or the beginning, is just before
    rest[1:] = ~heard[:-1]
    rest = rest[at] | (at == first)
    value = np.where(found.fit[at], found.value[at], -np.inf)
    top = value.max(1, keepdims=True)
    near = found.fit[at] & (top - value <= NEAR + 1e-9)
    plain = np.where(plains, value, -np.inf)
    has = plain.max(1) > -np.inf
    near[np.flatnonzero(has), plain.argmax(1)[has]] = True
    # scores with most windows first: those that go on are the first ones
    size = np.bincount(owner[at], minlength=len(lengths))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    size, begin = size[order], (np.cumsum(size) - size)[order]
    n = len(order)
    points = np.zeros((n, 1))
    extended, held, state, last = (np.zeros((n, 1), dtype=np.int64) for _ in range(4))
    steps = []
    for h in range(size[0]):
        n = int(np.searchsorted(-size, -h, side="left"))  # scores with more than h windows
        own = begin[:n] + h
        points, extended, held, state, last = (x[:n] for x in (points, extended, held, state, last))
        quiet = rest[own][:, None]
        state, last = np.where(quiet, 0, state), np.where(quiet, 0, last)
        width = int(near[own].sum(1).max())
        opt = np.argsort(~near[own], axis=1, kind="stable")[:, :width]
        gain = np.where(np.take_along_axis(near[own], opt, 1), np.take_along_axis(value[own], opt, 1), -np.inf)
        o, done, ahead = opt[:, None, :], h + 1, (size[:n] - h - 1)[:, None, None]
        total = points[:, :, None] + gain[:, None, :] + worth.ravel().take(((state * (n_chords + 1) + last) * n_chords)[:, :, None] + o)
        sevenths_held = held[:, :, None] + sevens[o]
        if extends.any():
            more = extended[:, :, None] + extends[o]
            over = np.maximum(0.0, more - wanted * done) - np.maximum(0.0, extended - wanted * h)[:, :, None]
            total = total - 0.2 * np.where(more > 0, over, 0.0)
            bad = (extends[o] & (more / done > 0.4 + 1e-9)) | (sevenths_held > np.floor(sevenths * (done - more + ahead) + 1e-9))
        else:
            more = np.broadcast_to(extended[:, :, None], total.shape)
            bad = sevenths_held > np.floor(sevenths * (done + ahead) + 1e-9)
        total = np.where(bad, -np.inf, total).reshape(n, -1)
        ranked = np.argsort(-total, axis=1, kind="stable")
        best = ranked[:, :BEAM]
        sevenths_held, more = sevenths_held.reshape(n, -1), more.reshape(n, -1)
        if ranked.shape[1] > BEAM:
            # the first path below the beam of each number of sevenths that the beam has not
            most = int(sevenths_held.max()) + 1
            rows, none = np.arange(n)[:, None], ranked.shape[1]
            place = np.full((n, most + 1), none)
            tail = ranked[:, :BEAM - 1:-1]
            open_ = (np.take_along_axis(total, tail, 1) > -np.inf) & (np.take_along_axis(more, tail, 1) == 0)
            # of several writes to one cell the last stays: from the worst path to the best
            place[np.broadcast_to(rows, tail.shape), np.where(open_, np.take_along_axis(sevenths_held, tail, 1), most)] = np.arange(none - 1, BEAM - 1, -1)
            known = (np.take_along_axis(total, best, 1) > -np.inf) & (np.take_along_axis(more, best, 1) == 0)
            place[np.broadcast_to(rows, best.shape), np.where(known, np.take_along_axis(sevenths_held, best, 1), most)] = none
            place = np.sort(place[:, :most], axis=1)
            place = place[:, : int((place < none).sum(1).max())]
            spare = np.take_along_axis(ranked, np.minimum(place, none - 1), 1)
            best = np.concatenate((best, spare), 1)
            points = np.concatenate((np.take_along_axis(total, best[:, :BEAM], 1), np.where(place < none, np.take_along_axis(total, spare, 1), -np.inf)), 1)
        else:
            points = np.take_along_axis(total, best, 1)
        prior, which = best // width, np.take_along_axis(opt, best % width, 1)
        extended, held = np.take_along_axis(more, best, 1), np.take_along_axis(sevenths_held, best, 1)
        state, last = goes[np.take_along_axis(state, prior, 1), which], which + 1
        steps.append((prior.astype(np.int16), which.astype(np.int8)))
    back = np.zeros(len(order), dtype=np.int64)
    for h in range(len(steps) - 1, -1, -1):
        prior, which = steps[h]
        rows = np.arange(len(prior))
        chosen_chord[at[begin[: len(prior)] + h]] = which[rows, back[: len(prior)]]
        back[: len(prior)] = prior[rows, back[: len(prior)]]
    return chosen_chord


def _merged(marks: list[dict]) -> list[dict]:
    """Neighbours of one chord in one measure become one mark, their support weighed by length."""
    out: list[dict] = []
    for m in marks:
        last = out[-1] if out else None
        if last and last["m_idx"] == m["m_idx"] and last["chord"] == m["chord"] and abs(last["to_tick"] - m["from_tick"]) < 1e-6:
            a, b = last["to_tick"] - last["from_tick"], m["to_tick"] - m["from_tick"]
            last.update(support=(a * last["support"] + b * m["support"]) / (a + b), to_tick=m["to_tick"])
        else:
            out.append(dict(m))
    return out


def _limited(marks: list[dict], limit: float) -> list[dict]:
    """Marks of one score, of which at most so large a share of the plain ones has a seventh: the least supported go back to triads."""
    marks = _merged(marks)
    while True:
        high = [m for m in marks if m["seventh"]]
        if len(high) <= np.floor(limit * sum(not m["extended"] for m in marks) + 1e-9):
            return marks
        m = min(high, key=lambda m: m["share"])
        m.update(simplified_from=m["chord"], chord=m["plain"], seventh=False, support=max(0.0, m["support"] - m["share"]))
        marks = _merged(marks)


def _alternatives(found: Fits, marks: pd.DataFrame, m_first: np.ndarray, m_size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each mark the chords that lie within .12 in every window it meets in its measure, and hold half of the melody: (the two
    best, whether there are so many)."""
    near = found.fit & (np.where(found.fit, found.value, -np.inf).max(1, keepdims=True) - found.value <= 0.12 + 1e-9)
    a, z = marks["from_tick"].to_numpy(), marks["to_tick"].to_numpy()
    ok, values, supports, lengths = np.ones((len(marks), near.shape[1]), dtype=bool), [], [], []
    for i in range(int(m_size.max())):
        w = np.minimum(m_first + i, len(low) - 1)
        inside = (i < m_size) & (low[w] < z) & (high[w] > a)
        ok &= near[w] | ~inside[:, None]
        length = np.where(inside, high[w] - low[w], 0.0)
        lengths.append(length)
        values.append(found.value[w] * length[:, None])
        supports.append(found.support[w] * length[:, None])
    length = _total(lengths)[:, None]
    value, support = _total(values) / length, _total(supports) / length
    top = np.where(ok, value, -np.inf).max(1, keepdims=True)
    ok &= (np.arange(near.shape[1]) != marks["chord"].to_numpy()[:, None]) & (support >= 0.5) & (top - value <= 0.12 + 1e-9)
    return np.argsort(np.where(ok, -value, np.inf), axis=1, kind="stable")[:, :2], np.minimum(ok.sum(1), 2)


def _marked(score: np.ndarray, lengths: np.ndarray, columns: dict[str, np.ndarray], chords: list[Chord], limit: float, wish: float) -> pa.RecordBatch:
    """Marks of several scores; the windows of each are in order."""
    found = fits(columns["tones"], chords, wish)
    chord = best_paths(found, lengths, chords, limit, wish)
    owner, at = np.repeat(np.arange(len(lengths)), lengths), np.flatnonzero(chord >= 0)
    c = chord[at]
    sevens, extends = np.array([x.seventh is not None and not x.extensions for x in chords]), np.array([bool(x.extensions) for x in chords])
    plain = np.array([x.degree - 1 for x in chords])  # the triads come first
    marks = pd.DataFrame({"owner": owner[at], **{n: columns[n][at] for n in ("m_idx", "from_tick", "to_tick")}, "chord": c, "support": found.support[at, c], "seventh": sevens[c], "extended": extends[c], "share": found.seventh[at, c], "simplified_from": -1, "plain": plain[c]})
    # scores that hold a chord over two windows of a measure, or too many sevenths, are merged one by one
    same = (marks["owner"] == marks["owner"].shift()) & (marks["m_idx"] == marks["m_idx"].shift()) & (marks["chord"] == marks["chord"].shift()) & ((marks["to_tick"].shift() - marks["from_tick"]).abs() < 1e-6)
    run = (~same).cumsum().to_numpy()
    head = marks[~same].copy()
    place = np.arange(len(marks)) - np.flatnonzero(~same.to_numpy())[run - 1]
    support, start, end = head["support"].to_numpy().copy(), head["from_tick"].to_numpy(), head["to_tick"].to_numpy().copy()
    for i in range(1, int(place.max(initial=0)) + 1):
        more = marks[place == i]
        to = run[place == i] - 1
        a, b = end[to] - start[to], (more["to_tick"] - more["from_tick"]).to_numpy()
        support[to], end[to] = (a * support[to] + b * more["support"].to_numpy()) / (a + b), more["to_tick"].to_numpy()
    head["support"], head["to_tick"] = support, end
    n = len(lengths)
    high, low = (np.bincount(head["owner"][m], minlength=n) for m in (head["seventh"], ~head["extended"]))
    many = (high > np.floor(limit * low + 1e-9))[head["owner"].to_numpy()]
    if many.any():
        changed = [m for _, own in head[many].groupby("owner") for m in _limited(own.to_dict("records"), limit)]
        head = pd.concat([head[~many], pd.DataFrame(changed, columns=head.columns)]).sort_values("owner", kind="stable")
    # each mark's windows of its measure
    measure = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (columns["m_idx"][1:] != columns["m_idx"][:-1])))) if len(owner) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(measure, len(owner)))
    known = pd.DataFrame({"owner": owner[measure], "m_idx": columns["m_idx"][measure], "first": measure, "size": sizes})
    head = head.merge(known, on=["owner", "m_idx"], how="left", sort=False)
    names = np.array([[x.label(pc) for x in chords] for pc in range(12)], dtype=object)
    do_pc = columns["do_pc"][(np.cumsum(lengths) - lengths)[head["owner"].to_numpy()]] % 12
    if len(head):
        two, count = _alternatives(found, head, head["first"].to_numpy(), head["size"].to_numpy(), columns["from_tick"], columns["to_tick"])
    else:
        two, count = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
    simple = head["simplified_from"].to_numpy().astype(np.int64)
    shown = np.arange(2) < count[:, None]
    return pa.RecordBatch.from_arrays([
        pa.array(score[head["owner"].to_numpy()]), *[pa.array(head[n].to_numpy(), t) for n, t in (("m_idx", pa.int64()), ("from_tick", pa.float64()), ("to_tick", pa.float64()))],
        pa.array(names[do_pc, head["chord"].to_numpy().astype(np.int64)], pa.string()), pa.array(np.round(head["support"].to_numpy().astype(float), 6)), pa.array(head["seventh"].to_numpy().astype(bool)), pa.array(head["extended"].to_numpy().astype(bool)),
        pa.array(names[do_pc, simple], pa.string(), mask=simple < 0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(names[np.repeat(do_pc, count), two[shown]], pa.string())),
    ], names=["score_id", "m_idx", "from_tick", "to_tick", "label", "support", "seventh", "extended", "simplified_from", "alternatives"])


def harmonized(weights: DataFrame, seventh_limit: float = 30, color: float = 0) -> DataFrame:
    """DP10, K2 over tone_weights: chord marks of each score, with at most two alternatives that lie within .12 in every window.

    At most seventh_limit percent (0 to 60) of the plain marks shown have a seventh: where merging raises the share, the least
    supported ones go back to triads. color (0 to 60) asks for extensions, 40 % at most. Windows without notes get no chord and
    part progressions. Every chord is taken to be playable. One score is one row; the beams of TOGETHER scores go on together.
    """
    limit, wish = max(0, min(60, seventh_limit)) / 100, max(0, min(60, color)) / 100
    chords = palette(wish > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                windows = part["windows"]
                rows = windows.flatten()
                columns = {n: rows.field(n).to_numpy(zero_copy_only=False) for n in ("m_idx", "from_tick", "to_tick", "do_pc")}
                columns["tones"] = rows.field("tones").flatten().to_numpy(zero_copy_only=False).reshape(-1, 12)
                yield _marked(part["score_id"].to_numpy(zero_copy_only=False), np.diff(windows.offsets.to_numpy()), columns, chords, limit, wish)

    schema = "score_id long, m_idx long, from_tick double, to_tick double, label string, support double, seventh boolean, extended boolean, simplified_from string, alternatives array<string>"
    window = F.struct(F.col("m_idx").cast("long").alias("m_idx"), F.col("from_tick").cast("double").alias("from_tick"), F.col("to_tick").cast("double").alias("to_tick"), F.col("do_pc").cast("long").alias("do_pc"), F.col("tones").cast("array<double>").alias("tones"))
    return spread(weights, "score_id").groupBy("score_id").agg(F.array_sort(F.collect_list(window)).alias("windows")).select(F.col("score_id").cast("long").alias("score_id"), "windows").mapInArrow(run, schema)


def _tables(spark, sf_dir):
    ticks = F.lit(64.0) / F.col("base") * F.when(F.col("dots") == 1, 1.5).otherwise(1.0)
    notes = adapters.view(spark, sf_dir, "notes").select("score_id", "m_idx", "n_idx", "degree", "accidental", ticks.alias("ticks"))
    do_pc = F.array_position(F.array(*[F.lit(n) for n in KEY_NAMES]), F.col("score_key")).cast("int") - 1
    return notes, adapters.view(spark, sf_dir, "scores").select("score_id", do_pc.alias("do_pc"), (F.col("meter") * 16.0).alias("capacity"))


QUERIES = {"melody_harmony": lambda s, d: harmonized(tone_weights(*_tables(s, d)))}
