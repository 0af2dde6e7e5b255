"""Energy in events, deviation in cores, metrical levels, bar anchors and keys: literal cases."""

import pytest

from melisma.operators import levels

EVENTS = "song_id long, a long, b long, midi long, center double, core_a long, core_b long"
SOUND = "song_id long, i long, pitch double, voiced boolean, energy double"
SUNG = "song_id long, event_id long, start_s double, midi long"
GRID = "song_id long, bpm int, confirmed boolean"


def test_energy_sums_to_one_over_its_parts(spark):
    events = spark.createDataFrame([(1, 0, 4, 60, 60.0, 0, 4), (1, 10, 74, 60, 60.0, 10, 74), (1, 80, 84, 60, 60.0, 80, 84)], EVENTS)
    energy = {0: 1.0, 1: 2.0, 2: float("nan"), 3: -1.0} | {i: 1.0 for i in range(10, 74)} | {i: 0.0 for i in range(80, 84)}
    got = {}
    for r in levels.energy(events, spark.createDataFrame([(1, i, 60.0, True, e) for i, e in energy.items()], SOUND)).collect():
        got.setdefault(r["a"], {})[r["slot"]] = r["weight"]
    assert got == {0: {0: 0.2, 1: 0.8, 2: 0.0, 3: 0.0}, 10: {k: 0.03125 for k in range(32)}}


def test_deviation_of_the_core(spark):
    events = spark.createDataFrame([(1, 0, 20, 60, 60.1, 5, 15), (2, 0, 20, 60, None, 5, 15), (2, 20, 30, 60, None, None, None)], EVENTS)
    sound = spark.createDataFrame([(s, i, 60 + i * 0.01, i != 7, 1.0) for s in (1, 2) for i in range(20)] + [(2, 20, 99.0, True, 1.0)], SOUND)
    got = {(r["song_id"], r["a"]): tuple(r)[2:] for r in levels.deviation(events, sound, spark.createDataFrame([(1, 20.0), (2, None)], "song_id long, cents double")).collect()}
    assert got[1, 0] == (30.0, 10.0, 5.0, 14.0, 9, "center and tuning")
    assert got[2, 0] == (10.0, None, 5.0, 14.0, 9, "core frames") and got[2, 20] == (None, None, None, None, 0, "insufficient")


@pytest.mark.parametrize("bpm, half, starts, marks, confirmed, want", [
    (130, 65.0, 24, [], False, (65.0, "dense opening")), (130, 65.0, 24, [], True, (130.0, "kept")), (130, 60.0, 24, [], False, (130.0, "kept")), (130, 65.0, 12, [], False, (130.0, "kept")), (160, 80.0, 24, [], False, (160.0, "kept")), (90, 45.0, 24, [], False, (90.0, "slow")),
    (160, 40.0, 8, [k * 3.0 for k in range(6)], False, (80.0, "double bars")), (160, 40.0, 8, [k * 1.5 for k in range(6)], False, (160.0, "kept")),
])
def test_metrical_level(spark, bpm, half, starts, marks, confirmed, want):
    bar = 240 / bpm
    sung = spark.createDataFrame([(1, i, 5 + i * 4 * bar / starts, 60) for i in range(starts)], SUNG)
    got = levels.level(sung, spark.createDataFrame([(1, bpm, confirmed)], GRID), spark.createDataFrame([(1, half)], "song_id long, bpm double"), spark.createDataFrame([(1, float(t)) for t in marks], "song_id long, beat_s double")).first()
    assert (got["bpm"], got["reason"]) == want


def test_bars_begin_where_marks_agree(spark):
    grids = spark.createDataFrame([(s, 120, False) for s in (1, 2)], GRID)
    sung = spark.createDataFrame([(1, 1, 10.5, 60), (2, 1, 10.5, 60)], SUNG)
    # an intro in another phase, then a run; song 2 has too few
    marks = spark.createDataFrame([(1, t) for t in (1.0, 7.0, 8.2, 10.2, 12.2, 14.2)] + [(2, 3.0), (2, 9.0)], "song_id long, beat_s double")
    assert {r["song_id"]: (r["anchor"], r["supported"]) for r in levels.anchor(sung, grids, marks).collect()} == {1: (10.2, True), 2: (3.0, False)}


def test_key_maps(spark):
    good = dict(version=1, status="confirmed", do_pc=7, key_pc=7, reference_midi=67, locked=True, mode="major", tonic_pc=None, tuning_cents=0.0)
    cases = [({}, None), ({"version": 2}, "state"), ({"status": "suggested"}, "state"), ({"do_pc": 8}, "state"), ({"reference_midi": 60}, "state"), ({"do_pc": None}, "state"), ({"mode": "dorian"}, "tonic"), ({"tonic_pc": 12}, "tonic"), ({"tuning_cents": float("nan")}, "record"), ({}, "anchor"), ({}, "record")]
    rows = [(i, *(good | change).values()) for i, (change, _) in enumerate(cases)]
    maps = spark.createDataFrame(rows, "score_id long, version int, status string, do_pc int, key_pc int, reference_midi int, locked boolean, mode string, tonic_pc int, tuning_cents double")
    anchors = [(0, 0.0, 1.0, 1, 0, 60.0, 0), (9, 1.0, 1.0, 1, 0, 60.0, 0)] + [(10, 0.0, 1.0, 1, 0, 60.0, 0)] * 65
    got = {r["score_id"]: r["reason"] for r in levels.maps(maps, spark.createDataFrame(anchors, "score_id long, start_s double, end_s double, degree int, accidental int, midi double, do_pc int")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_the_same_pitch_under_another_do(spark):
    kind = "score_id long, measure_id long, m_idx long, n_idx long, note_id long, degree long, base int, octave long, dots long, accidental long, tie boolean, source_s double"
    notes = spark.createDataFrame([(1, 0, 0, i, i, d, 4, o, 0, a, False, None) for i, (d, o, a) in enumerate([(1, 0, 0), (3, 0, 0), (0, 0, 0), (7, 2, 1), (6, 0, -1)])], kind)
    scores = spark.createDataFrame([(1, "C", 120, 4, 0)], "score_id long, score_key string, bpm int, meter int, capo int")
    keys = lambda do, flat: spark.createDataFrame([(1, do, flat)], "score_id long, do_midi int, flat boolean")
    of = lambda do, flat: {r["note_id"]: (r["midi"], r["degree"], r["octave"], r["accidental"], r["refused"]) for r in levels.relabelled(notes, scores, keys(do, flat)).collect()}
    got = of(65, True)  # F
    assert got[0] == (60, 5, -1, 0, None) and got[1] == (64, 7, -1, 0, None) and got[2] == (None, 0, None, 0, None) and got[4] == (68, 3, 0, -1, None)
    assert of(67, False)[4] == (68, 1, 0, 1, None) and of(40, False)[3] == (96, None, None, 1, "octave")
