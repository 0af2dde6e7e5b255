"""Stable cores, their second lane and passes: what goes in and what must come out."""

import numpy as np
import pytest

from melisma.operators import cores
from melisma.sources import adapters

FRAMES = "song_id long, frame long, pitch double, voiced boolean, confidence double, energy double, onset boolean"
NONE = float("nan")


def decoded(spark, songs):
    """The events of each song of {name: dict(pitch, energy, onsets, confidence, voiced)}."""
    rows = []
    for n, song in enumerate(songs.values()):
        pitch = [None if p != p else float(p) for p in song["pitch"]]
        size = len(pitch)
        energy = song.get("energy", [None] * size)
        energy = [1.0] * size if energy == 1 else energy
        prob, onsets = song.get("confidence", [0.9] * size), {round(t / cores.STEP) for t in song.get("onsets", ())}
        rows += [(n, i, p, song.get("voiced", p is not None), prob[i], None if energy[i] is None else float(energy[i]), i in onsets) for i, p in enumerate(pitch)]
    found = {name: [] for name in songs}
    for r in cores.stable_events(spark.createDataFrame(rows, FRAMES)).orderBy("song_id", "start_s").collect():
        found[list(songs)[r["song_id"]]].append(r)
    return found


def line(a, b, n):
    return np.linspace(a, b, n).tolist()


SCOOP = [58.2] * 5 + [58.4, 58.6, 58.9, 59.1] + [59.3] * 14
CREST = [56.998, 57.498, 57.798, 57.898, 58.098, 58.098, 57.898, 57.598, 57.398, 57.198, 57.198, 57.098, 57.098, 57.098, 56.998, 56.998, 56.998, 56.898, 56.698, 56.498, 56.198]


def dipped(size, a, b, level=0.2):
    return [level if a <= i < b else 1.0 for i in range(size)]


SONGS = {
    "scoop": dict(pitch=line(60, 64, 18) + [64] * 30),
    "crest": dict(pitch=CREST, energy=1),
    "spike": dict(pitch=[57] * 4 + [58.1] + [57] * 25, energy=1),
    "legato": dict(pitch=[60] * 16 + [61] * 8 + [73] * 16),
    "short": dict(pitch=[60] * 16 + [62] * 5 + [64] * 16),
    "peak": dict(pitch=[57.1] * 20 + [59.4] * 12 + [NONE] * 8 + [59.05] * 12 + [57] * 20, energy=1),
    "intonation": dict(pitch=[57] * 20 + [59.2] * 12 + [59.05] * 12 + [57] * 20),
    "plateau": dict(pitch=SCOOP, energy=1, onsets=[0.032]),
    "step": dict(pitch=[58.2] * 5 + [59.3] * 14),
    "reattack": dict(pitch=SCOOP, energy=dipped(23, 4, 6), onsets=[0.096]),
    "weak first": dict(pitch=[59] * 20 + [57] * 20 + [60] * 20, energy=1, confidence=[0.08] * 20 + [0.9] * 40, onsets=[0]),
    "weak first without onset": dict(pitch=[59] * 20 + [57] * 20 + [60] * 20, energy=1, confidence=[0.08] * 20 + [0.9] * 40),
    "vibrato": dict(pitch=(60 + 0.6 * np.sin(2 * np.pi * 6 * np.arange(80) * 0.016)).tolist()),
    "glide": dict(pitch=line(60, 70, 45)),
    "missing but sounding": dict(pitch=[60] * 16 + [NONE] * 4 + [60] * 16, energy=1),
    "silence": dict(pitch=[60] * 16 + [NONE] * 4 + [60] * 16, energy=dipped(36, 16, 20, 0.0)),
    "struck again": dict(pitch=[60] * 40, energy=dipped(40, 16, 20, 0.3), onsets=[0.32]),
    "between": dict(pitch=[60.49] * 30),
    "low going on": dict(pitch=[60] * 30, confidence=[0.9] * 10 + [0.4] * 20),
    "unvoiced": dict(pitch=[60] * 30, confidence=[0.95] * 30, voiced=False),
    "tuned": dict(pitch=[n + 0.2 for n in (60, 62, 64, 65, 67) for _ in range(100)], confidence=[0.95] * 500),
    "one note": dict(pitch=[60.2] * 500),
    "weak inside": dict(pitch=[60] * 20 + [62] * 30 + [64] * 20, energy=1, confidence=[0.9] * 20 + [0.08] * 30 + [0.9] * 20),
    "weak but silent": dict(pitch=[55] * 20 + [60] * 20 + [62] * 30 + [64] * 20, energy=dipped(90, 40, 70, 0.0), confidence=[0.08] * 20 + [0.9] * 20 + [0.08] * 30 + [0.9] * 20),
    "gated": dict(pitch=[55] * 20 + [60] * 20 + [62] * 30 + [64] * 20, energy=1, confidence=[0.08] * 20 + [0.9] * 20 + [0.0] * 30 + [0.9] * 20),
    "weak glide": dict(pitch=[60] * 20 + line(61, 70, 20) + [72] * 20, energy=1, confidence=[0.9] * 20 + [0.08] * 20 + [0.9] * 20),
    "around a strict one": dict(pitch=[60] * 16 + [62] * 45 + [64] * 16, energy=1, confidence=[0.9] * 16 + [0.08] * 20 + [0.9] * 5 + [0.08] * 20 + [0.9] * 16),
    "tail": dict(pitch=[64] * 20 + [64.1] * 10 + [62] * 20, energy=1, confidence=[0.9] * 20 + [0.03] * 10 + [0.9] * 20),
    "struck tail": dict(pitch=[64] * 34 + [62] * 20, energy=dipped(54, 17, 20), confidence=[0.9] * 20 + [0.03] * 14 + [0.9] * 20, onsets=[0.32]),
}


@pytest.fixture(scope="module")
def events(spark):
    return decoded(spark, SONGS)


@pytest.mark.parametrize("name, midi", {
    "scoop": [64], "crest": [58, 57], "legato": [60, 61, 73], "short": [60, 62, 64], "peak": [57, 60, 59, 57], "plateau": [59], "step": [58, 59], "reattack": [58, 59], "weak first": [59, 57, 60], "weak first without onset": [57, 60],
    "vibrato": [60], "missing but sounding": [60], "silence": [60, 60], "struck again": [60, 60], "between": [60], "low going on": [60], "unvoiced": [], "tuned": [60, 62, 64, 65, 67], "one note": [60], "weak inside": [60, 62, 64],
    "weak but silent": [60, 64], "gated": [60, 64], "weak glide": [60, 72], "tail": [64, 62], "struck tail": [64, 64, 62],
}.items())
def test_pitches(events, name, midi):
    assert [e["midi"] for e in events[name]] == midi


def test_scoop_belongs_to_its_destination(events):
    assert events["scoop"][0]["start_s"] == 0 and events["scoop"][0]["core_start_s"] > 0.2


def test_crest_is_uncertain_and_leaves_the_core_alone(events):
    short, main = events["crest"]
    assert short["crest"] and short["uncertain"] and short["core_start_s"] is None and short["end_s"] == main["start_s"] == 0.112 and main["core_start_s"] == 0.144
    assert not any(e["crest"] for e in events["spike"])


def test_flat_peak_is_proposed_higher_and_stays_uncertain(events):
    peak = events["peak"][1]
    assert peak["uncertain"] and peak["nearest_midi"] == 59 and abs(peak["center"] - 59.4) < 1e-6
    assert 60 not in [e["midi"] for e in events["intonation"]]


def test_weak_notes_are_recovered_but_not_trusted(events):
    for name, k in (("weak first", 0), ("weak inside", 1)):
        assert events[name][k]["uncertain"] and events[name][k]["recovered"]
    found = events["around a strict one"]
    assert any(not e["recovered"] and e["midi"] == 62 for e in found) and all(a["end_s"] <= b["start_s"] for a, b in zip(found, found[1:]))


def test_weak_tail_goes_on_but_no_core(events):
    first = events["tail"][0]
    assert first["end_s"] == 0.48 and first["core_end_s"] == 0.32 and first["tails"] == 1 and events["struck tail"][0]["tails"] == 0


def test_one_event_of_a_glide_and_of_an_unclear_pitch(events):
    assert len(events["glide"]) == 1 and events["glide"][0]["uncertain"] and events["glide"][0]["core_start_s"] is None
    assert events["between"][0]["uncertain"] and events["low going on"][0]["end_s"] == 0.48


def test_tuning_and_its_reasons(spark):
    rows = [(n, i, float(p), True, 0.95, None, False) for n, name in enumerate(("tuned", "one note", "short")) for i, p in enumerate(SONGS[name]["pitch"])]
    got = {r["song_id"]: r for r in cores.tuning(spark.createDataFrame(rows, FRAMES)).collect()}
    assert abs(got[0]["cents"] - 20) < 2 and [got[k]["reason"] for k in range(3)] == ["reliable-consensus", "too-few-distinct-notes", "insufficient-evidence"]


EVENTS = "song_id long, a long, b long, midi long, center double, core_a long, core_b long, spread double, voicing double, uncertain boolean, recovered boolean, scoop_b long, fall_a long, crest boolean"
SOUND = "song_id long, i long, pitch double, voiced boolean, confidence double, energy double, onset boolean, quiet double, valid boolean"


def absorbed(spark, event_rows, energy, onsets=()):
    sound = spark.createDataFrame([(1, i, 60.0, True, 0.9, float(e), i in onsets, max(8e-4, max(energy) * 0.025), True) for i, e in enumerate(energy)], SOUND)
    return [tuple(r) for r in cores.noise(spark.createDataFrame(event_rows, EVENTS), sound).orderBy("a").select("a", "b", "midi", "center", "core_b", "absorbed").collect()]


MAIN = (1, 0, 25, 60, 60.1, 2, 23, 1.0, 0.9, False, False, None, None, False)
NOISE = (1, 25, 30, 63, 63.4, None, None, 40.0, 0.4, True, False, None, None, False)


def test_noise_goes_to_the_note_that_it_touches(spark):
    assert absorbed(spark, [MAIN, NOISE], [1.0] * 40) == [(0, 30, 60, 60.1, 23, 1)]
    assert len(absorbed(spark, [MAIN, NOISE], dipped(40, 23, 25), [25])) == 2  # struck
    assert len(absorbed(spark, [MAIN, NOISE], dipped(40, 24, 25, 0.0))) == 2  # silent
    assert len(absorbed(spark, [MAIN, (*NOISE[:5], 26, 29, *NOISE[7:])], [1.0] * 40)) == 2  # has a core
    assert len(absorbed(spark, [MAIN, (*NOISE[:13], True)], [1.0] * 40)) == 2  # a crest
    # a chain goes to the left, its end to the nearer side; this needs what the fragment before it became
    right = (1, 35, 60, 64, 64.0, 36, 58, 1.0, 0.9, False, False, None, None, False)
    second = (1, 30, 35, 64, 63.8, None, None, 40.0, 0.4, True, False, None, None, False)
    assert absorbed(spark, [MAIN, NOISE, second, right], [1.0] * 70) == [(0, 30, 60, 60.1, 23, 1), (30, 60, 64, 64.0, 58, 1)]
    assert absorbed(spark, [MAIN, NOISE, (*second[:4], 61.0, *second[5:]), right], [1.0] * 70) == [(0, 35, 60, 60.1, 23, 2), (35, 60, 64, 64.0, 58, 0)]


def test_baseline_cuts_a_note_that_is_struck_again(spark):
    from melisma.operators import decoders

    energy = dipped(40, 16, 20, 0.3)
    frames = lambda at: spark.createDataFrame([(1, i, 60.0, 0.9, energy[i], i in at) for i in range(40)], "song_id long, frame long, pitch double, confidence double, energy double, onset boolean")
    found = lambda at: [(r["start_s"], r["end_s"]) for r in decoders.segment_events(frames(at), cores.STEP).orderBy("start_s").collect()]
    assert found({20}) == [(0.0, 0.32), (0.32, 0.64)] and found(set()) == found({33}) == found({3}) == [(0.0, 0.64)]


def test_empty_frames(spark):
    assert cores.stable_events(spark.createDataFrame([], FRAMES)).count() == 0


def test_decoders_replayed_on_the_same_frames(spark):
    pitch = SONGS["peak"]["pitch"] + [None] * 10
    rows = [(1, i, None if p is None or p != p else float(p), p is not None and p == p, 0.9, 1.0, False) for i, p in enumerate([None] * 100 + pitch)] + [(2, i, 60.0, True, 0.9, None, False) for i in range(130)]
    frames = spark.createDataFrame(rows, FRAMES)
    events = cores.replayed(frames, after=1.6)
    got = {(r["song_id"], r["decoder"]): [] for r in events.collect()}
    for r in events.orderBy("start_s").collect():
        got[r["song_id"], r["decoder"]].append((r["start_s"], r["midi"]))
    assert [m for _, m in got[1, "stable cores"]] == [57, 60, 59, 57] and got[1, "stable cores"][0][0] == 0 and [m for _, m in got[1, "baseline"]] == [57, 59, 59, 57]
    assert [m for _, m in got[2, "baseline"]] == [m for _, m in got[2, "stable cores"]] == [60]
    found = {r["song_id"]: tuple(r)[1:] for r in cores.compared(events, frames).collect()}
    assert found == {1: (4, 4, 1, 3, None), 2: (1, 1, 0, 1, "energy")}


def test_stored_events_are_not_broadcast(spark, sf_dir):
    """what is stored grows with the songs, and the driver must not hold it."""
    assert "BroadcastHashJoin" not in cores.stable_events(adapters.view(spark, sf_dir, "frames").where("song_id < 2"))._jdf.queryExecution().sparkPlan().toString()
