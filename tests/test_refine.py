"""Second thoughts about pitches and syllables: literal cases. A frame is 16 ms."""

from melisma.operators import refine

EVENTS = "song_id long, a long, b long, midi long, center double, core_a long, core_b long, spread double, voicing double, uncertain boolean, recovered boolean, scoop_b long, fall_a long, crest boolean"
SOUND = "song_id long, i long, pitch double, voiced boolean, confidence double, energy double, onset boolean, quiet double, valid boolean"
KEYS = "song_id long, do_pc int"
NOTES = "score_id long, measure_id long, m_idx long, n_idx long, note_id long, degree long, base int, octave long, dots long, accidental long, tie boolean, source_s double"


def event(a, b, midi, center=None, core=None, spread=10.0, uncertain=False, scoop=None, recovered=False):
    return (1, a, b, midi, float(midi if center is None else center), *(core or (a, b)), spread, 0.8, uncertain, recovered, scoop, None, False)


def corrected(spark, events, pitches=None, do=7):
    sound = [(1, i, p, p is not None, 0.9, 1.0, False, 0.025, p is not None) for i, p in (pitches or {0: 60.0}).items()]
    got = refine.corrections(spark.createDataFrame(events, EVENTS), spark.createDataFrame(sound, SOUND), spark.createDataFrame([(1, do)], KEYS)).collect()
    return {r["a"]: (r["target_midi"], r["reason"], r["destination_a"]) for r in got}


def test_short_scoop_resolves_to_its_stable_destination(spark):
    events = [event(60, 65, 68, 67.7), event(68, 85, 69)]
    rising = {60: 67.8, 63: 67.7, 66: 68.5, 68: 69.2}
    assert corrected(spark, events, rising)[60] == (69, "slide-to-stable-diatonic", 68)
    falling = rising | {66: 67.0}
    assert corrected(spark, events, falling).get(60, (0, ""))[1] != "slide-to-stable-diatonic"  # goes back too far
    assert corrected(spark, [events[0], event(68, 85, 69, uncertain=True)], rising).get(60, (0, ""))[1] != "slide-to-stable-diatonic"


def test_stable_borrowed_and_halfway_pitches_stay(spark):
    assert 30 not in corrected(spark, [event(30, 50, 68)]) and corrected(spark, [event(0, 5, 68, 68.0)]) == {}  # as near to one as to the other
    assert corrected(spark, [event(0, 5, 68, 68.4)]) == {0: (69, "weak-pitch-diatonic-prior", None)}
    assert corrected(spark, [event(0, 5, 67, 67.4)]) == {}  # in the key
    # two stable repeats are stronger than the key
    assert 0 not in corrected(spark, [event(0, 5, 68, 68.4), event(20, 40, 68), event(60, 80, 68)])


def test_crest_for_review(spark):
    crest = [56.998, 57.498, 57.798, 57.898, 58.098, 58.098, 57.898, 57.598, 57.398] + [57.1] * 8
    sound = lambda xs: spark.createDataFrame([(1, i, p, True, 0.9, 1.0, False, 0.025, True) for i, p in enumerate(xs)], SOUND)
    main = event(0, 17, 57, 57.0983, core=(9, 17), scoop=9)
    found = lambda events, xs: [tuple(r) for r in refine.peaks(spark.createDataFrame([e[:13] for e in events], EVENTS.rsplit(",", 1)[0]), sound(xs)).collect()]
    assert found([main], crest) == [(1, 0, 2, 7, 58, 100.0, 5)]
    assert found([main], [57.1] * 17) == [] and found([main], [57 + i * 0.15 for i in range(9)] + [58.2] * 8) == [] and found([main], [57.1] * 4 + [58.1] + [57.1] * 12) == []
    assert found([(*main[:9], True, *main[10:])], crest) == [] and found([(*main[:11], None, *main[12:])], crest) == []
    assert found([event(-9, 4, 60, core=(-8, 3)), (1, 1, *main[2:])], crest) == []


def test_audition_from_a_moment(spark):
    e = spark.createDataFrame([(1, 1, 1.0, 3.0, 60), (1, 2, 3.0, 4.0, 62), (1, 3, 0.0, 0.5, 64)], "song_id long, event_id long, start_s double, end_s double, midi long")
    f = spark.createDataFrame([(1, 1, 11, 0, 16.0), (1, 1, 12, 1, 16.0)], "song_id long, event_id long, note_id long, place int, ticks double")
    got = refine.audition(e, f, spark.createDataFrame([(1, 1.5)], "song_id long, from_s double")).collect()
    assert sorted((r["kind"], r["id"], r["start_s"], r["end_s"]) for r in got) == [("event", 1, 0.0, 1.5), ("event", 2, 1.5, 2.5), ("mark", 11, 0.0, 0.5), ("mark", 12, 0.5, 1.5)]


def lyrics(spark, rows):
    return spark.createDataFrame([(1, n, v, t, float(x)) for n, v, t, x in rows], "score_id long, note_id long, verse int, text string, offset_x double")


def score(spark, degrees, ties=(), measures=4):
    return spark.createDataFrame([(1, i // measures, i // measures, i % measures, i, d, 4, 0, 0, 0, i in ties, None) for i, d in enumerate(degrees)], NOTES)


def test_tail_of_a_row_moves_together(spark):
    move = lambda delta: spark.createDataFrame([(1, 0, 1, 1, float(delta), 0, 0)], "score_id long, seq long, note_id long, verse int, delta double, first_m int, last_m int")
    rows = lyrics(spark, [(0, 1, "a", 0), (1, 1, "b", 5), (3, 1, "c", -1), (1, 2, "x", 0), (4, 1, "d", 0)])
    got = lambda delta: {(r["note_id"], r["verse"]): (r["offset_x"], r["state"]) for r in refine.tails(rows, score(spark, [1] * 8), move(delta)).collect()}
    assert got(10.26) == {(0, 1): (0.0, "stays"), (1, 1): (15.3, "moved"), (3, 1): (9.3, "moved"), (1, 2): (0.0, "stays"), (4, 1): (0.0, "stays")}
    assert got(1999)[1, 1] == (5.0, "too far") and got(1999)[3, 1] == (-1.0, "too far")


def test_suffix_makes_room(spark):
    where = lambda note, target, last=0: spark.createDataFrame([(1, note, 1, target, 0, last)], "score_id long, note_id long, verse int, target_id long, first_m int, last_m int")
    rows = lyrics(spark, [(0, 1, "a", 0), (1, 1, "b", 0), (2, 1, "c", 0), (4, 1, "d", 0), (0, 2, "x", 0)])
    got = lambda w, notes: {r["text"]: (r["note_id"], r["state"]) for r in refine.relocated(rows, notes, w).collect()}
    notes = score(spark, [1, 2, 3, 0, 5, 6, 7, 1])
    assert got(where(1, 4), notes) == {"a": (0, "stays"), "b": (4, "moved"), "c": (5, "moved"), "d": (6, "moved"), "x": (0, "stays")}
    assert got(where(1, 7), notes)["b"] == (1, "no room") and got(where(1, 3), notes)["b"] == (1, "stays")  # a rest is no target
    assert got(where(1, 4), score(spark, [1, 2, 3, 0, 5, 6, 7, 1], ties=(4,)))["c"] == (6, "moved")  # a held note is passed over
