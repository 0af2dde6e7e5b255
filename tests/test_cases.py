"""Operators against literal cases: what goes in and what must come out, written down by hand."""

import pytest

from melisma.operators import aggregates, evidence, joins, quality, sequences

EVENTS = "song_id long, event_id long, start_s double, end_s double, midi long, pitch_center double, confidence double, uncertain boolean, core_start double, core_end double, performance_end double, pitch_reliability double, recovery_reason string"
NOTES = "score_id long, measure_id long, m_idx long, n_idx long, note_id long, degree long, base int, octave long, dots long, accidental long, tie boolean, source_s double"
CHARACTERS = "song_id long, char_id long, line_id long, text string, start_s double, end_s double, manual boolean"


def event(i, midi, start, length=0.6, uncertain=False, performance_end=None, recovery=None, confidence=1.0, center=None):
    return (1, i, float(start), float(start) + length, midi, float(midi if center is None else center), confidence, uncertain, None, None, performance_end, None, recovery)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def note(i, degree, base=4, tie=False, measure=0, dots=0, source=None):
    return (1, measure, measure, i, i, degree, base, 0, dots, 0, tie, source)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def phrases_of(notes, phrases):
    found, t, i = [], 0.0, 0
    for _ in range(phrases):
        for midi in notes:
            found.append(event(i, midi, round(t, 6)))
            t, i = t + 0.6, i + 1
        t += 0.6
    return found, t


def test_phrase_endings_decide_do(spark):
    found, t = phrases_of([64, 65, 67, 69, 72], 6)
    df = events(spark, [*found, event(99, 67, round(t, 6))])
    assert [(r["midi"], round(r["weight"], 6)) for r in sequences.phrases(df).collect()] == [(72, 0.6)] * 6
    best = aggregates.do_ranking(df).where("rank = 1").first()
    assert best["key_name"] == "C"
    assert aggregates.do_ranking(df).where("cadence > 0.04 or cadence + phrase_score > 0.16").count() == 0


def test_no_silence_out_of_rejected_events_and_overlaps(spark):
    df = events(spark, [event(0, 60, 0), event(1, 61, 0.6, 0.5, uncertain=True), event(2, 62, 1.2), event(3, 64, 2.5, performance_end=4.0), event(4, 65, 3.8)])
    assert [r["midi"] for r in sequences.phrases(df).collect()] == [62]


def test_minor_ending_supports_relative_major(spark):
    found, _ = phrases_of([69, 72, 74, 76, 77, 76, 69], 5)
    best = aggregates.do_ranking(events(spark, found)).where("rank = 1").first()
    assert best["key_name"] == "C" and best["cadence"] == 0.032 and best["phrase_score"] > 0


def test_main_classes_leave_uncertain_and_recovered_out(spark):
    df = events(spark, [event(0, 56, 0, 2), event(1, 68, 2, 1), event(2, 59, 3, 1), event(3, 60, 4, 10, uncertain=True), event(4, 61, 14, 10, recovery="recovered")])
    assert [(r["pc"], r["share"], r["midi"]) for r in aggregates.main_classes(df).orderBy("rank").collect()] == [(8, 0.75, 56), (11, 0.25, 59)]
    assert aggregates.main_classes(events(spark, [event(i, 60 + i, i) for i in range(12)])).count() == 7


def test_chord_labels(spark):
    labels = ["C", "Am7", "F#maj7", "Bbdim", "Cadd9", "G9", "Dm11", "E13", "H"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "score_id long, measure_id long, label string")
    got = {r["label"]: (r["root"], r["pcs"], r["seventh_pc"], r["extended"]) for r in evidence.labels(df).collect()}
    assert got["C"] == (0, "0-4-7", None, False) and got["Am7"] == (9, "9-0-4-7", 7, False) and got["F#maj7"] == (6, "6-10-1-5", 5, False)
    assert got["Bbdim"] == (10, "10-1-4", None, False) and got["Cadd9"] == (0, "0-4-7-2", None, True) and got["G9"] == (7, "7-11-2-5-9", 5, True)
    assert got["Dm11"] == (2, "2-5-9-0-4-7", 0, True) and got["E13"] == (4, "4-8-11-2-6-9-1", 2, True) and got["H"][0] is None


def test_chords_move_with_their_bass(spark):
    labels = spark.createDataFrame([(1, 0, "C"), (1, 1, "G7"), (1, 2, "Am7"), (1, 3, "F#maj7"), (1, 4, "Bb/D"), (1, 5, "?")], "score_id long, measure_id long, label string")
    score = spark.createDataFrame([(1, "D", 120, 4, 2)], "score_id long, score_key string, bpm long, meter long, capo long")
    assert [r["shape_label"] for r in evidence.transposed(labels, score).orderBy("measure_id").collect()] == ["Bb", "F7", "Gm7", "Emaj7", "Ab/C"]


def test_capo(spark):
    score = spark.createDataFrame([(1, "D", 120, 4, 2), (2, "F", 120, 4, 0), (3, "G", 120, 4, 0)], "score_id long, score_key string, bpm long, meter long, capo long")
    got = {(r["score_id"], r["shape"]): (r["capo"], r["easiest"]) for r in evidence.capo(score).collect()}
    assert got[1, "C"] == (2, True) and got[1, "G"] == (-5, False) and got[2, "C"] == (5, True) and got[2, "G"] == (-2, False) and got[3, "G"] == (0, True)
    assert rows(evidence.guitar(score)) == [(1, 2, 4), (2, 5, 5), (3, 7, 7)]


def test_lyric_text(spark):
    texts = ["你好，世界！", "two  words", "word", "，你", "see https://x.y", "Guitar: 我", "ab你", "\u3000你好\u3000世界\r\n"]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert [r["tokens"] for r in evidence.tokens(df).orderBy("turn").collect()][:4] == ["你¦好，¦世¦界！", "two¦words", "word", "，¦你"] and evidence.tokens(df).where("turn = 7").first()["tokens"] == "你好¦世界"
    assert [r["cleaned"] for r in evidence.cleaned(df).orderBy("turn").collect()] == ["你好世界", "twowords", "word", "你", None, "吉他我", "ab你", "你好世界"]
    assert [r["width"] for r in evidence.width(df).orderBy("turn").collect()] == [108, 90, 36, 36, 135, 9 * 8 + 18, 36, 18 * 6 + 9 * 2]


def test_glyphs(spark):
    df = spark.createDataFrame([(1, 0, "user", "%zI8l0")], "conv_id long, turn long, role string, text string")
    assert [(r["place"], r["digit"]) for r in evidence.aliases(df).orderBy("place").collect()] == [(0, 6), (1, 7), (2, 1), (4, 1), (5, 0)]


def test_ties_join_and_repeats_stay(spark):
    df = spark.createDataFrame([note(1, 1, tie=True), note(2, 1), note(3, 1), note(4, 2, tie=True), note(5, 3)], NOTES)
    assert [(r["first_note"], r["notes"], r["ticks"]) for r in sequences.tied(df).orderBy("first_note").collect()] == [(1, 2, 32.0), (3, 1, 16.0), (4, 1, 16.0), (5, 1, 16.0)]
    assert [r["note_id"] for r in joins.ties(df).orderBy("note_id").collect()] == [1, 3, 4]
    assert [r["end_note_id"] for r in evidence.melisma_ends(df).orderBy("note_id").collect()] == [2, 2, 3, 5, 5]


@pytest.mark.parametrize(("start", "units", "parts"), [(0, 16, [(0, 16)]), (0, 15, [(0, 12), (0, 3)]), (12, 7, [(0, 4), (1, 3)]), (1, 40, [(0, 12), (0, 3), (1, 16), (2, 8), (2, 1)]), (0, 5, [(0, 4), (0, 1)])])
def test_durations_fall_into_spellable_parts(spark, start, units, parts):
    df = events(spark, [event(0, 60, start * 0.125, units * 0.125 / 4)])
    assert [(r["bar"], r["amount"]) for r in quality.decomposed(df).orderBy("bar", "part").collect()] == parts


def test_characters_go_to_the_nearest_note(spark):
    found = events(spark, [event(1, 60, 1, 0.5), event(2, 62, 2, 0.5), event(3, 64, 9, 0.5)])
    chars = spark.createDataFrame([(1, i, 0, t, s - 0.1, s + 0.1, False) for i, t, s in [(1, "a", 1.2), (2, "b", 1.4), (3, "c", 1.75), (4, "d", 2.9), (5, "e", 5.0), (6, "f", 7.9)]], CHARACTERS)
    assert [(r["event_id"], r["text"]) for r in evidence.placed(found, chars).orderBy("event_id").collect()] == [(1, "abc"), (2, "d"), (3, "f")]
    assert [r["text"] for r in evidence.unplaced(found, chars).collect()] == ["e"]


def test_manual_characters_replace_the_nearest_equal_one(spark):
    chars = spark.createDataFrame([(1, 1, 0, "a", 10.0, 10.2, True), (1, 2, 0, "a", 12.0, 12.2, False), (1, 3, 0, "a", 9.0, 9.2, False), (1, 4, 0, "b", 10.0, 10.2, False), (1, 5, 0, "a", 15.0, 15.2, False)], CHARACTERS)
    assert [r["char_id"] for r in evidence.preserved(chars).orderBy("char_id").collect()] == [1, 2, 4, 5]


def test_nearest_event_within_bound(spark):
    df = events(spark, [event(1, 60, 1.0), event(2, 61, 2.0, uncertain=True), event(3, 62, 3.0), event(4, 63, 6.0, uncertain=True)])
    assert rows(joins.nearest(df)) == [(1, 2, 1, 1.0)]


def test_zero_intro(spark):
    df = spark.createDataFrame([note(1, 0, 4), note(2, 3, 4, source=9.0)], NOTES)
    score = spark.createDataFrame([(1, "C", 120, 4, 0)], "score_id long, score_key string, bpm long, meter long, capo long")
    assert rows(evidence.intro_range(df, score)) == [(1, 8.5, True)]
    bars = rows(evidence.intro(df, score), "bar", "beat")
    assert len(bars) == 16 and bars[0][3] == 0.0 and bars[-1][4] == 8.5


def test_windows_own_by_middle(spark):
    got = rows(sequences.windows(events(spark, [event(1, 60, 29.0, 1.8), event(2, 60, 29.9, 0.4), event(3, 60, 64.0)])), "window_index")
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in got] == [(0.0, 30.0, 0.0, 31.5, 1), (30.0, 60.0, 28.5, 61.5, 1), (60.0, 64.6, 58.5, 64.6, 1)]


def test_twelve_rotations_have_twelve_keys(spark):
    scale = {0: 3.0, 2: 1.5, 4: 2.0, 5: 1.5, 7: 2.5, 9: 1.5, 11: 1.0}
    found = []
    for song in range(12):
        t = 0.0
        for pc, length in scale.items():
            found.append((song, song * 100 + pc, t, t + length, 60 + (pc + song) % 12, float(60 + (pc + song) % 12), 1.0, False, None, None, None, None, None))
            t += 0.8
    best = evidence.key_votes(events(spark, found)).where("rank = 1").orderBy("song_id").collect()
    assert [(r["do_pc"], r["suggested"]) for r in best] == [(i, True) for i in range(12)]


def test_cancelling_channels(spark):
    df = events(spark, [(s, s * 10 + i, float(i), i + 0.5, 60, 62.0 + i, 1.0, False, None, None, None, None, None) for s in (1, 3) for i in range(4)])
    assert [(r["song_id"], r["channel"]) for r in evidence.mono(df).orderBy("song_id").collect()] == [(1, "mean"), (3, "channel-1")]


def test_starts_three_milliseconds_apart(spark):
    df = events(spark, [event(1, 60, 1.0), event(2, 61, 1.002), event(3, 62, 1.0049), event(4, 63, 1.02)])
    notes = spark.createDataFrame([(1, 10, 1.001), (1, 20, 1.0205), (1, 30, 1.0249), (2, 40, 1.0), (1, 50, None), (1, 60, 0.9979)], "song_id long, note_id long, source_s double")
    assert rows(quality.provenance(df, notes)) == [(1, 1, 10), (1, 1, 60), (1, 2, 10), (1, 4, 20)]


def test_nearest_segment_however_far(spark):
    from melisma.operators import scores

    df = events(spark, [event(1, 60, 0, 1), event(2, 60, 500, 40), event(3, 60, 505, 1), event(10, 60, 200, uncertain=True), event(11, 60, 300, uncertain=True), event(12, 60, 505.5, uncertain=True), event(13, 60, 9000, uncertain=True), event(14, 60, 250.5, uncertain=True), event(15, 60, 540, uncertain=True)])
    got = {r["event_id"]: (r["segment"], r["gap"]) for r in scores.containing(df).collect()}
    assert got == {10: (1, 199.0), 11: (2, 200.0), 12: (2, 0.0), 13: (2, 8460.0), 14: (1, 249.5), 15: (2, 0.0)}
    assert scores.containing(df.where("uncertain")).count() == 0


def test_gap_pitch_follows_the_song_key(spark):
    rows_ = [event(1, 60, 0, 1), event(2, 61, 1.2, 0.1, uncertain=True), event(3, 61, 1.4, 0.1, uncertain=True), event(4, 60, 2, 1)]
    key = lambda pc: spark.createDataFrame([(1, pc)], "song_id long, do_pc int")
    assert [r["midi"] for r in evidence.gap_votes(events(spark, rows_), key(1)).collect()] == [61]
    assert evidence.gap_votes(events(spark, rows_), key(0)).count() == 0


def test_projects_are_listed_by_time(spark):
    rows_ = [(1, 1, 5, "F", 1.0, "a", "2024-01-01"), (1, 2, 6, "F", 1.0, "b", "2024-03-01"), (2, 1, 7, "F", 1.0, "c", "2024-05-01"), (3, 9, 8, "F", None, "d", "2025-01-01"), (4, 1, 9, "F", 2.0, "e", "2024-02-01")]
    df = spark.createDataFrame(rows_, "project_id long, revision long, score_id long, status string, audio_offset double, title string, published_at string")
    assert [(r["project_id"], r["revision"]) for r in evidence.listed(df).collect()] == [(2, 1), (1, 2), (4, 1)]


def test_projects_have_their_places(spark):
    rows_ = [(1, 2, 6, "F", 1.0, "b", "2024-03-01"), (65, 5, 7, "F", 1.0, "c", "2024-05-01"), (3, 9, 8, "F", None, "d", "2025-01-01"), (4, 1, 9, "F", 2.0, "e", "2024-03-01"), (5, 1, 9, "F", 2.0, "e", None)]
    df = spark.createDataFrame(rows_, "project_id long, revision long, score_id long, status string, audio_offset double, title string, published_at string")
    assert [(r["project_id"], r["place"], r["list_place"]) for r in evidence.projects(df).orderBy("list_place").collect()] == [(65, 1, 1), (1, 2, 2), (4, 1, 3), (5, 1, 4)]
