"""Phrases, rhythm and recorded streams against literal cases."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from melisma.operators import anchored, harmony, phrases, rhythm
from melisma.plans import catalog
from melisma.sources import streams

CHARACTERS = "song_id long, char_id long, line_id long, text string, start_s double, end_s double, manual boolean"


@pytest.mark.parametrize("name", sorted(set(phrases.QUERIES) | set(rhythm.QUERIES) | set(harmony.QUERIES) | set(anchored.QUERIES) | set(streams.QUERIES)))
def test_queries_run_and_repeat(spark, sf_dir, name):
    first, again = (sorted(map(str, catalog.queries()[name](spark, sf_dir).collect())) for _ in range(2))
    assert first and first == again


def test_letters_and_likeness():
    assert phrases.letters("Ａｂ①, 你-好！") == "Ab1你好" and phrases.phrase_letters("这 Guitar 弹得") == "这吉他弹得" and phrases.letters(None) == ""
    assert phrases.likeness("abcd", "abxd") == 0.75 and phrases.likeness("abcd", "axbxc") == 0 and phrases.likeness("", "") == 0
    assert phrases.likeness("一二三四", "一二三四") == 1


def sung(spark, lines, text, times=None):
    left = spark.createDataFrame([(1, i, p) for i, p in enumerate(lines)], "song_id long, line_id long, phrase string")
    right = spark.createDataFrame([(1, i, c, float(t)) for i, (c, t) in enumerate(zip(text, times or range(len(text))))], "song_id long, place long, text string, at double")
    return left, right


def test_ordered_windows_leave_room_for_lines_between(spark):
    # the first line is sung again at the end: it must not take the later place
    got = {r["line_id"]: (r["start_s"], r["similarity"]) for r in phrases.phrase_windows(*sung(spark, ["天地人你", "春夏秋冬", None, "天地人你"], "天地人你春夏秋冬天地人你")).collect()}
    assert got == {0: (0.0, 1.0), 1: (4.0, 1.0), 3: (8.0, 1.0)}
    assert [r["line_id"] for r in phrases.phrase_windows(*sung(spark, ["春夏秋冬", "天地人你"], "天地人你春夏秋冬")).collect()] != [0, 1]


def test_windows_one_by_one_take_a_place_once(spark):
    got = {r["line_id"]: (r["start_s"], r["end_s"], list(r["places"])) for r in phrases.phrase_windows(*sung(spark, ["春夏秋冬", "天地人你", "天地人你"], "天地人你春夏秋冬"), ordered=False).collect()}
    assert got == {0: (4.0, 7.6, [0, 1, 2, 3]), 1: (0.0, 3.6, [0, 1, 2, 3])}


def test_missing_lines_are_searched_together(spark):
    chars = [(1, 10 * line + i, line, "a", t + i, t + i + 0.5, line in (0, 3)) for line, t in enumerate([1.0, 50.0, 60.0, 30.0]) for i in range(2)]
    got = [tuple(r)[1:] for r in phrases.line_groups(spark.createDataFrame(chars, CHARACTERS)).orderBy("first_line").collect()]
    assert got == [(0, 0, 2, 0.0, 5.0), (1, 2, 4, 2.0, 29.95), (3, 3, 2, 28.0, 34.0)]


def test_times_between_known_neighbours(spark):
    chars = [(1, 1, 0, "a", 1.0, 1.5, True), (1, 2, 0, "b", 9.0, 8.0, False), (1, 3, 0, "c", 0.1, 0.2, False), (1, 4, 0, "d", 3.5, 4.0, True)]
    got = [tuple(r)[1:] for r in phrases.restored(spark.createDataFrame(chars, CHARACTERS)).orderBy("char_id").collect()]
    assert got == [(2, 1.5, 2.3, False), (3, 2.5, 3.3, False)]


def test_lines_out_of_order_wait(spark):
    line = lambda k, t: [(1, 10 * k + i, k, t + i, t + i + 0.5, True, (k, i) == (1, 1)) for i in range(2)]
    df = spark.createDataFrame(line(0, 10.0) + line(1, 30.0) + line(2, 14.0) + [(1, 30, 3, None, None, False, False)], "song_id long, char_id long, line_id long, start_s double, end_s double, acoustic boolean, manual boolean")
    got = {r["char_id"]: (r["start_s"], r["observed_start"], r["pending"]) for r in phrases.ordered_lines(df).collect()}
    assert got == {0: (10.0, None, False), 1: (11.0, None, False), 10: (None, 30.0, True), 11: (31.0, None, True), 20: (14.0, None, False), 21: (15.0, None, False), 30: (None, None, False)}


@pytest.mark.parametrize("bpm", [79, 96, 120])
def test_tempo_of_pulses(spark, bpm):
    frames = [(1, int(round(i * 60 / bpm / 0.01)), 1.0) for i in range(int(32 * bpm / 60))]
    got = rhythm.tempo_candidates(spark.createDataFrame(frames, "song_id long, frame long, strength double"), 0.01).orderBy("rank").collect()
    assert abs(got[0]["bpm"] - bpm) < 1 and len(got) <= 16 and all(40 <= r["bpm"] <= 240 for r in got if r["derived_from"])
    own = [r["bpm"] for r in got if r["derived_from"] is None]
    assert all(abs(a - b) > 2 for i, a in enumerate(own) for b in own[:i])


def test_periods_fold_together_as_alone_and_songs_are_dealt_out(spark):
    x = np.random.default_rng(5).random(3100) * (np.arange(3100) % 7 < 2)
    periods = np.linspace(0.3, 1.4, 60)

    def alone(period):
        n, found = max(8, round(period / 0.02)), []
        for part in (x[:1200], x[1200:2400], x[2400:]):
            sums = np.bincount(np.floor(np.arange(len(part)) * 0.02 / period * n).astype(int) % n, weights=part, minlength=n)
            smooth = 0.6 * sums + 0.2 * (np.roll(sums, 1) + np.roll(sums, -1))
            found.append(smooth.max() / smooth.mean())
        return np.median(found)

    assert rhythm._folded(x, 0.02, periods).tolist() == [alone(p) for p in periods]
    songs = spark.range(4000).selectExpr("id % 40 AS song_id", "id AS frame", "1D AS strength")
    dealt = songs.withColumn("frame", F.row_number().over(Window.partitionBy("song_id").orderBy("frame")).cast("long"))
    assert rhythm.tempo_candidates(dealt, 0.02).rdd.getNumPartitions() > 1


def test_novelty_equals_one_pass_over_the_sound(spark):
    x = np.random.default_rng(1).normal(0, 0.01, 3 * rhythm.CHUNK * rhythm.HOP // 2)
    for at in range(2000, len(x) - 400, 5500):
        x[at : at + 400] += np.sin(np.arange(400) * 0.1)
    blocks = [(1, int(a), [float(v) for v in x[a : a + 7000]]) for a in range(0, len(x), 7000)]
    got = rhythm.novelty(spark.createDataFrame(blocks, "song_id long, first long, xs array<double>")).orderBy("frame").toPandas()
    y = np.pad(x, rhythm.SIZE // 2)
    levels = np.log1p(20 * np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, rhythm.SIZE)[:: rhythm.HOP] * np.hanning(rhythm.SIZE))))
    rise = np.maximum(0, np.diff(levels, axis=0, prepend=levels[:1]))
    hz = np.fft.rfftfreq(rhythm.SIZE, 1 / rhythm.RATE)
    want = 0.0
    for share, v in ((0.7, rise.mean(1)), (0.3, rise[:, (hz >= 35) & (hz <= 250)].mean(1))):
        v = np.maximum(0, v - np.convolve(v, np.ones(101) / 101, mode="same"))
        want = want + share * np.minimum(v / np.percentile(v, 95), 4)
    assert len(got) == len(want) and np.allclose(got["strength"], want, atol=2e-6)


def test_silent_edges_go(spark):
    frames = [(1, i, 0.5 if 100 <= i < 200 else 0.0001) for i in range(375)] + [(2, i, 0.0001) for i in range(10)]
    got = [tuple(r) for r in rhythm.sounding_part(spark.createDataFrame(frames, "song_id long, frame long, rms double")).collect()]
    assert got == [(1, 0, 7.4, 16.6)]


def test_recorded_event_lines(spark):
    good = "\n".join(map(json.dumps, [{"type": "started"}, {"type": "delta", "text": "a"}, {"type": "delta", "text": "b"}, {"type": "progress"}, {"type": "result", "n": 1}]))
    bodies = [(1, good + "\n\n"), (2, '{"type":"delta","text":"x"}'), (3, '{"type":"error","error":"busy"}'), (4, "{bad"), (5, None)]
    got = {r["stream_id"]: (r["delta_text"], r["progress"], r["problem"]) for r in streams.event_lines(spark.createDataFrame(bodies, "stream_id long, body string")).collect()}
    assert got == {1: ("ab", 2, None), 2: ("x", 0, "no result"), 3: ("", 0, "busy"), 4: ("", 0, "event"), 5: ("", 0, "no result")}


def test_recorded_sent_events(spark):
    part = lambda text, **more: "data: " + json.dumps({"candidates": [{"content": {"parts": [{"text": text, **more}]}}]})
    stop = 'data: {"candidates":[{"finishReason":"STOP"}]}'
    bodies = [(1, "\r\n\r\n".join([part("a"), part("no", thought=True), ": note", part("b"), stop, "data: [DONE]"])), (2, part("a")), (3, 'data: {"error":{"message":"quota"}}'), (4, 'data: {"promptFeedback":{"blockReason":"X"}}'), (5, stop), (6, None)]
    got = {r["stream_id"]: (r["text"], r["problem"]) for r in streams.sent_events(spark.createDataFrame(bodies, "stream_id long, body string")).collect()}
    assert got == {1: ("ab", None), 2: ("a", "finish"), 3: ("", "quota"), 4: ("", "blocked"), 5: ("", "empty"), 6: ("", "finish")}


def chords(spark, bars, key="C", halves=True, base=None, **more):
    notes = [(1, m, i, d, 0, 64.0 / (base or {}).get((m, i), 4)) for m, degrees in enumerate(bars) for i, d in enumerate(degrees)]
    score = spark.createDataFrame([(1, harmony.KEY_NAMES.index(key), 64.0)], "score_id long, do_pc int, capacity double")
    weights = harmony.tone_weights(spark.createDataFrame(notes, "score_id long, m_idx long, n_idx long, degree long, accidental long, ticks double"), score, halves)
    return harmony.harmonized(weights, **more).orderBy("m_idx", "from_tick").collect()


def test_chords_of_a_written_melody(spark):
    one = chords(spark, [[1, 3, 5, 1]])
    assert [(r["label"], r["from_tick"], r["to_tick"]) for r in one] == [("C", 0, 64)]
    assert [(r["label"], r["support"]) for r in chords(spark, [[2, 4, 6, 2]])] == [("Dm", 1)]
    assert chords(spark, [[1, 3, 5, 1]], key="G")[0]["label"] == "G"
    assert [r["m_idx"] for r in chords(spark, [[0, 0, 0, 0], [2, 4, 6, 2]])] == [1]
    two = chords(spark, [[1, 3, 2, 4]])
    assert [(r["from_tick"], r["to_tick"]) for r in two] == [(0, 32), (32, 64)] and two[0]["label"] != two[1]["label"]
    assert len(chords(spark, [[1, 3, 2, 4]], halves=False)) == 1


def test_progressions_decide_only_where_the_melody_does_not(spark):
    assert [r["label"] for r in chords(spark, [[4], [5], [3], [6]], halves=False)] == ["F", "G", "Em", "Am"]
    assert chords(spark, [[4], [5], [1, 3, 5, 1], [6]], halves=False)[2]["label"] == "C"
    assert [r["label"] for r in chords(spark, [[4], [5], [0], [3], [6]], halves=False)] != ["F", "G", "Em", "Am"]


@pytest.mark.parametrize(("bar", "label"), [([1, 3, 5, 7], "Cmaj7"), ([2, 4, 6, 1], "Dm7"), ([5, 7, 2, 4], "G7")])
def test_sevenths_are_limited(spark, bar, label):
    low, high = (chords(spark, [bar] * 10, halves=False, seventh_limit=n) for n in (30, 60))
    share = lambda marks: sum(r["seventh"] for r in marks) / len(marks)
    assert share(low) <= 0.3 and share(low) < share(high) <= 0.6 and label in {r["label"] for r in high}
    assert not any(r["seventh"] for r in chords(spark, [bar] * 10, seventh_limit=0)) and share(chords(spark, [bar] * 10)) <= 0.3
    assert not any(r["seventh"] for r in chords(spark, [bar], halves=False))


def test_short_sevenths_and_extensions(spark):
    assert chords(spark, [[5, 7, 2, 4]], halves=False, base={(0, 3): 16})[0]["label"] == "G"
    low, high = (chords(spark, [[1, 3, 7, 2]] * 10, halves=False, seventh_limit=60, color=n) for n in (0, 60))
    assert not any(r["extended"] for r in low) and 0 < sum(r["extended"] for r in high) <= 4


def test_lyrics_anchor_times(spark):
    text = "天地人你我他好春夏秋冬山水火"
    sung = [(1, i, c, 10.0 + 2 * i) for i, c in enumerate(text)]
    written = [(1, i, c, i, 0.5 * i) for i, c in enumerate(text)]
    a, b = spark.createDataFrame(sung, "pair_id long, place long, text string, at double"), spark.createDataFrame(written, "pair_id long, place long, text string, note_place long, position double")
    notes = spark.createDataFrame([(1, i, 0.5 * i, 0.5 * i + 0.5) for i in range(-1, 16)], "pair_id long, note_place long, start double, end double")
    got = {r["note_place"]: (r["start_s"], r["end_s"]) for r in anchored.anchored_times(a, b, notes).collect()}
    assert got == {i: (10.0 + 2 * i, 12.0 + 2 * i) for i in range(-1, 16)}
    assert anchored.anchored_times(a.limit(3), b, notes).count() == 0


def test_chains_rise_in_every_column():
    points = np.array([[0, 0, 0, 0], [1, 5, 9, 1], [2, 1, 1, 2], [3, 2, 2, 3]], dtype=float)
    assert anchored.heaviest_rise(points, np.array([3, 5, 3, 3])) == [0, 2, 3]
    assert anchored.thinned(np.array([0, 0.5, 2]), np.array([0, 1, 4.0]), np.array([3, 5, 3])) == [1, 2]


def test_reads_of_a_measure(spark):
    rows = [(1, 1, 0, 10.0, None), (1, 2, 0, 50.0, "a"), (1, 3, 1, 20.0, "b"), (1, 4, 1, 80.0, "c"), (1, 5, 1, 90.0, "d"), (1, 6, 1, 52.0, "e")]
    got = [tuple(r)[1:] for r in anchored.merged_reads(spark.createDataFrame(rows, "measure_id long, place long, second int, x double, lyric string")).orderBy("x").collect()]
    assert got == [(1, 10.0, "b", False), (2, 50.0, "a", False), (4, 80.0, "c", True)]


def test_rows_of_a_page(spark):
    rows = [(1, 1, 0.50, 0.04, False, True), (1, 2, 0.515, 0.04, False, True), (1, 3, 0.10, 0.04, False, True), (1, 4, 0.505, 0.04, True, False), (1, 5, 0.53, 0.04, False, True)]
    got = [r["page_row"] for r in anchored.baseline_rows(spark.createDataFrame(rows, "page_id long, place long, y double, height double, lyric boolean, music boolean")).orderBy("place").collect()]
    # the middle of two is the upper one, 0.515: near enough to the last, and below the lyric's
    assert got == [2, 2, 0, 1, 2]
    kind = "page_id long, place long, y double, height double, lyric boolean, music boolean, ys array<double>, heights array<double>"
    many = [(1, 1, 0.5, 0.04, False, True, [0.5] * 5, [0.04] * 5), (1, 2, 0.515, 0.04, False, True, [0.515], [0.04]), (1, 3, 0.53, 0.04, False, True, [0.53], [0.04])]
    got = [r["page_row"] for r in anchored.baseline_rows(spark.createDataFrame(many, kind)).orderBy("place").collect()]
    assert got == [0, 0, 1]  # glyphs weigh, not observations


def test_pages_are_rows_of_a_batch(spark):
    rows = [(p, i, y, 0.04, None if i == 2 else False, i != 1) for p in range(200) for i, y in enumerate((0.5, None, 0.9, 0.51 + p % 2))]
    found = anchored.baseline_rows(spark.createDataFrame(rows, "page_id long, place long, y double, height double, lyric boolean, music boolean"))
    got = {(r["page_id"], r["place"]): r["page_row"] for r in found.collect()}
    assert len(got) == 800 and all(got[p, 0] < got[p, 2] and (got[p, 3] == got[p, 0]) == (p % 2 == 0) for p in range(200))
    assert "MapInArrow" in (plan := found._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan
