"""Timelines of a score and MIDI files: literal cases at 120 beats a minute, a sixteenth being .125 s."""

import struct

import pytest

from melisma.operators import playback

NOTES = "score_id long, m_idx long, n_idx long, note_id long, degree long, base int, octave long, dots long, accidental long, tie boolean, grace_degree long, grace_octave long, grid_start double, grid_end double, source_s double, source_end double, manual_ticks int"
PLAYS = "score_id long, bpm int, meter int, do_midi int, start_measure int, clip_start double"


def note(i, degree, base=4, m=0, octave=0, dots=0, accidental=0, tie=False, grace=None, grid=(None, None), source=(None, None), manual=None):
    return (1, m, i, i, degree, base, octave, dots, accidental, tie, grace, 0 if grace else None, *[None if t is None else float(t) for t in (*grid, *source)], manual)


@pytest.fixture
def tables(spark):
    def made(rows, do=60, start=0, clip=0.0, bpm=120):
        return spark.createDataFrame(rows, NOTES), spark.createDataFrame([(1, bpm, 4, do, start, float(clip))], PLAYS)

    return made


def kind(df, name):
    return [(r["note_id"], r["midi"], r["start_s"], r["end_s"]) for r in df.where(f"kind = '{name}'").orderBy("start_s", "note_id").collect()]


def test_written_pitch_octave_and_sign(tables):
    got = playback.timeline(*tables([note(0, 1), note(1, 3, 8, octave=1, dots=1, accidental=-1), note(2, 0, 8)], do=67))
    assert kind(got, "note") == [(0, 67, 0.0, 0.5), (1, 82, 0.5, 0.875)] and [m[0] for m in kind(got, "mark")] == [0, 1, 2]


def test_ties_join_and_bars_keep_their_silence(tables):
    rows = [note(0, 1, 2, tie=True), note(1, 1), note(2, 0), note(3, 2, m=1)]
    assert kind(playback.timeline(*tables(rows)), "note") == [(0, 60, 0.0, 1.5), (3, 62, 2.0, 2.5)]
    rows[0] = note(0, 1, 2)
    assert len(kind(playback.timeline(*tables(rows)), "note")) == 3
    assert kind(playback.timeline(*tables(rows, start=1)), "note") == [(3, 62, 0.0, 0.5)]
    # an empty measure between, and one of a length of its own
    assert kind(playback.timeline(*tables([note(0, 1), note(1, 2, m=2)])), "note")[1][2] == 4.0
    assert kind(playback.timeline(*tables([note(0, 1, manual=16), note(1, 2, m=1)])), "note")[1][2] == 0.5


def test_ties_over_bars_and_grace_notes(tables):
    assert kind(playback.timeline(*tables([note(0, 1, 1, tie=True), note(1, 1, m=1)])), "note") == [(0, 60, 0.0, 2.5)]
    got = playback.timeline(*tables([note(0, 1, 1, grace=2), note(1, 3, 16, m=1, grace=1)], do=67))
    assert kind(got, "grace") == [(0, 69, 0.0, 0.125), (1, 67, 2.0, 2.03125)] and kind(got, "note")[0] == (0, 67, 0.125, 2.0)


def spans(df):
    return {r["note_id"]: (r["timing"], r["start_s"], r["end_s"]) for r in df.collect()}


def test_recorded_time_is_shared_by_written_length(tables):
    rows = [note(0, 1, 2, source=(1, 4)), note(1, 1, 4, m=1, source=(1, 4)), note(2, 2, source=(5, None), m=2), note(3, 3, m=2, source=(5.2, 6))]
    assert spans(playback.segments(*tables(rows))) == {0: ("recorded", 1.0, 3.0), 1: ("recorded", 3.0, 4.0), 2: ("recorded", 5.0, 5.2), 3: ("recorded", 5.2, 6.0)}


def test_rests_fill_the_silence_but_unrecorded_notes_do_not(tables):
    rows = [note(0, 1, source=(0, 1)), note(1, 0), note(2, 0, 8), note(3, 2, source=(2.5, 3))]
    assert spans(playback.segments(*tables(rows)))[1] == ("rest", 1.0, 2.0) and spans(playback.segments(*tables(rows)))[2] == ("rest", 2.0, 2.5)
    rows[1] = note(1, 3)
    assert set(spans(playback.segments(*tables(rows)))) == {0, 3}


def test_what_was_never_recorded_is_estimated_outward(tables):
    rows = [note(0, 3, m=0), note(1, 1, m=2, source=(2, 3)), note(2, 5, m=2), note(3, 0, m=3)]
    got = spans(playback.segments(*tables(rows, clip=30)))
    assert got == {0: ("estimated-prefix", -2.0, -1.5), 1: ("recorded", 2.0, 3.0), 2: ("estimated-suffix", 3.0, 3.5), 3: ("estimated-suffix", 4.5, 5.0)}
    assert 0 not in spans(playback.segments(*tables(rows, clip=0))) and spans(playback.segments(*tables(rows, clip=1.75)))[0] == ("estimated-prefix", -1.75, -1.5)
    grid = [note(0, 0, grid=(30, 30.5)), note(1, 1, 8, grid=(30.5, 31), source=(30.55, 31)), note(2, 2, m=1, source=(32, 33))]
    assert spans(playback.segments(*tables(grid)))[1] == ("recorded", 30.5, 31.0)
    assert playback.segments(*tables([note(0, 1)])).count() == 0


def test_position_at_a_moment(spark):
    s = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 2, 2.0, 7.0), (2, 3, 0.0, 1.0)], "score_id long, note_id long, start_s double, end_s double")
    m = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 1.5, 2.0, 6.5, 7.0)] + [(1, 1.5)], "score_id long, moment double")
    assert {r["moment"]: (r["note_id"], r["share"]) for r in playback.positions(s, m).collect()} == {0.5: (None, None), 1.0: (1, 0.0), 1.5: (1, 0.5), 2.0: (2, 0.0), 6.5: (2, 0.9), 7.0: (None, None)}


def test_midi_file(spark, tables):
    assert playback.variable_length(0) == b"\x00" and playback.variable_length(128) == b"\x81\x00" and playback.variable_length(480) == b"\x83\x60"
    marks = playback.timeline(*tables([note(0, 1), note(1, 1)], do=67, bpm=160))
    heads = spark.createDataFrame([(1, 160, 4, 4, 1.5), (2, 90, 6, 8, 0.0)], "score_id long, bpm int, beats int, beat_unit int, duration_s double")
    got = {r["score_id"]: bytes(r["midi"]) for r in playback.midi_files(marks, heads).collect()}
    data = got[1]
    assert data[:4] == b"MThd" and data[8:14] == bytes([0, 0, 0, 1, 1, 224]) and struct.unpack(">I", data[18:22])[0] == len(data) - 22
    assert data.count(bytes([144, 67, 88])) == 2 and data.index(bytes([128, 67, 0])) < data.rindex(bytes([144, 67, 88])) and data.endswith(b"\xff\x2f\x00")
    assert bytes([255, 81, 3]) + (375_000).to_bytes(3, "big") in data and bytes([255, 88, 4, 6, 3, 36, 8]) in got[2]


def test_only_a_few_scores_at_once_are_python_objects(spark, monkeypatch):
    seen = []
    heads = spark.createDataFrame([(1, 60, 4, 4, 1.0)], "score_id long, bpm long, beats long, beat_unit long, duration_s double")
    monkeypatch.setattr(type(heads), "mapInArrow", lambda df, run, schema: seen.append(run))
    playback.midi_files(spark.createDataFrame([], "score_id long, kind string, midi long, start_s double, end_s double"), heads)
    n = 3 * playback.TOGETHER + 1
    kind = playback.pa.list_(playback.pa.struct([("start_s", playback.pa.float64()), ("end_s", playback.pa.float64()), ("midi", playback.pa.int64())]))
    events = playback.pa.array([None if i % 2 else [{"start_s": 0.0, "end_s": 0.5, "midi": 60 + i % 12}] for i in range(n)], kind)
    batch = playback.pa.RecordBatch.from_arrays([playback.pa.array(x) for x in (list(range(n)), [60] * n, [4] * n, [4] * n, [1.0] * n)] + [events], names=["score_id", "bpm", "beats", "beat_unit", "duration_s", "events"])
    got = list(seen[0]([batch]))
    assert [b.num_rows for b in got] == [playback.TOGETHER] * 3 + [1]
    assert [x for b in got for x in b["midi"].to_pylist()] == [playback.midi_bytes([] if i % 2 else [(60 + i % 12, 0.0, 0.5)], 60.0, (4, 4), 1.0) for i in range(n)]
