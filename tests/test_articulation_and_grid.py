"""Spectral changes, notes parted by them, and the fixed grid: literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.operators import articulation, grid

EVENTS = "song_id long, a long, b long, midi long, core_a long, core_b long, uncertain boolean"
SOUND = "song_id long, i long, pitch double, voiced boolean, energy double, onset boolean, change double"


def split(spark, event=(19, 49, 55, 19, 49, False), pitch=55.0, voiced=False, energy=None, changes=None, onsets=(10,), before=()):
    energy = [0.0] * 10 + [0.08] * 70 if energy is None else energy
    changes = {17: 0.85} if changes is None else changes
    pitches = pitch if isinstance(pitch, list) else [pitch] * 80
    sound = spark.createDataFrame([(1, i, pitches[i], voiced, energy[i], i in onsets, changes.get(i, 0.0)) for i in range(80)], SOUND)
    return articulation.split_articulations(spark.createDataFrame([(1, *e) for e in (*before, event)], EVENTS), sound).orderBy("start_s", "kind").collect()


def kinds(rows):
    return [r["kind"] for r in rows]


def test_unvoiced_attack_is_evidence_and_moves_no_note(spark):
    attack, note = split(spark)
    assert (attack["kind"], attack["start_s"], attack["end_s"], attack["midi"]) == ("attack", 0.16, 0.272, 55)
    assert (note["kind"], note["start_s"], note["end_s"], note["core_start_s"]) == ("note", 0.304, 0.784, 0.304)


def test_change_alone_quiet_or_another_pitch_is_no_attack(spark):
    assert kinds(split(spark, onsets=())) == ["note"]
    assert kinds(split(spark, changes={17: 0.1})) == ["note"]
    assert kinds(split(spark, energy=[0.0] * 18 + [0.08] * 62)) == ["note"]
    assert kinds(split(spark, pitch=[60.0] * 18 + [55.0] * 62)) == ["note"]
    assert kinds(split(spark, before=[(10, 19, 55, None, None, True)])) == ["note", "note"]


def test_repeat_inside_needs_spectrum_and_reattack(spark):
    whole = (0, 49, 55, 0, 49, False)
    dip = [0.02 if 30 <= i < 33 else 0.08 for i in range(80)]
    first, second = split(spark, event=whole, energy=dip, changes={32: 0.7}, onsets=(32,))
    assert (first["end_s"], first["core_end_s"], second["start_s"], second["core_start_s"], second["end_s"]) == (0.512, 0.512, 0.512, 0.512, 0.784)
    assert first["kind"] == second["kind"] == "articulated"
    assert kinds(split(spark, event=whole, energy=[0.08] * 80, changes={32: 0.7}, onsets=(32,), voiced=True)) == ["note"]
    assert kinds(split(spark, event=whole, energy=dip, changes={}, onsets=(32,))) == ["note"]


def test_two_attacks_make_three_pieces(spark):
    dip = [0.02 if i in (20, 40) else 0.08 for i in range(80)]
    got = split(spark, event=(0, 60, 55, 0, 60, False), energy=dip, changes={21: 0.7, 41: 0.6}, onsets=(21, 41), voiced=True)
    assert [(round(r["start_s"] / 0.016), round(r["end_s"] / 0.016)) for r in got] == [(0, 21), (21, 41), (41, 60)]


def test_spectral_shape_does_not_depend_on_loudness_or_chunks(spark, monkeypatch):
    y = np.sin(2 * np.pi * 196 * np.arange(16_000) / 16_000)
    y[8_000:] = np.sin(2 * np.pi * 900 * np.arange(8_000) / 16_000)
    rows = [(song, at, (y[at : at + 700] * loud).tolist()) for song, loud in ((1, 1.0), (2, 0.1)) for at in range(0, 16_000, 700)]
    blocks = spark.createDataFrame(rows, "song_id long, first long, xs array<double>")
    monkeypatch.setattr(articulation, "CHUNK", 7)
    found = {(r["song_id"], r["frame"]): r["change"] for r in articulation.spectral_changes(blocks).collect()}
    one = np.array([found[1, k] for k in range(63)])
    assert np.abs(one - [found[2, k] for k in range(63)]).max() < 1e-8
    assert one[8:24].max() < 0.01 and int(one.argmax()) in (30, 31, 32) and one.max() > 0.9 and (one[:2] == 0).all() and (one[-2:] == 0).all()
    monkeypatch.setattr(articulation, "CHUNK", 2048)
    again = {(r["song_id"], r["frame"]): r["change"] for r in articulation.spectral_changes(blocks).collect()}
    assert again == pytest.approx(found, abs=1e-9)


def test_samples_that_follow_from_other_columns_are_made_after_the_shuffle_and_sort(spark):
    tone = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.sin(i * F.col("pitch") / 100))
    small = spark.createDataFrame([(song, at * 512, 512, 3.0 + (at + song) % 5) for song in (1, 2) for at in range(9)], "song_id long, first long, size int, pitch double")
    lazy = articulation.spectral_changes(small, tone)
    whole = articulation.spectral_changes(small.select("song_id", "first", tone.alias("xs")))
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, whole.collect()))
    below = lazy._jdf.queryExecution().sparkPlan().toString()
    assert "SIN(" in below and "SIN(" not in below[below.index("Sort ["):]


def test_fixed_grid_of_a_long_song(spark):
    rng = np.random.default_rng(7)
    period = 60 / 79
    at = 1.2 + np.arange(320) * period + rng.normal(0, 0.02, 320)
    at[110:115] += 0.16
    beats = spark.createDataFrame([(1, float(t)) for t in at] + [(2, float(t)) for t in np.delete(at, [7, 8, 90])] + [(3, float(t)) for t in range(5)], "song_id long, beat_s double")
    tempi = spark.createDataFrame([(s, k, b, v, 4) for s in (1, 2, 3) for k, (b, v) in enumerate([(79.0, 1.0), (158.0, 0.5)])], "song_id long, rank int, bpm double, score double, meter int")
    got = {r["song_id"]: r for r in grid.fits(beats, tempi).collect()}
    assert set(got) == {1, 2}
    for r in got.values():  # missed beats are whole steps
        assert r["fit_measures"] >= 20 and abs(r["period"] * 4 - period * 4) < 0.001 and abs(r["period"] - period) * 320 < 0.06
    bass = spark.createDataFrame([(1, round(t / 0.01), 1.0, 5.0 if k % 4 == 2 else 0.05) for k, t in enumerate(at)], "song_id long, frame long, pulse double, bass double")
    none = spark.createDataFrame([], "song_id long, beat_s double")
    chosen = grid.stable_grid(beats, tempi, none, bass).where("song_id = 1 AND chosen").first()
    base = got[1]["base"]
    assert round((chosen["anchor"] - 1.2) / period) % 4 == 2 and abs(chosen["anchor"] - base - chosen["phase"] * got[1]["period"]) < 1e-4
    marks = spark.createDataFrame([(1, float(t)) for t in at[1::4]], "song_id long, beat_s double")
    chosen = grid.stable_grid(beats, tempi, marks, bass).where("song_id = 1 AND chosen").first()
    assert round((chosen["anchor"] - 1.2) / period) % 4 == 1
