"""Drafts of scores: literal cases."""

from melisma.operators import drafts

NOTES = "score_id long, note_id long, degree string, base string, octave string, dots string, accidental string, grace_degree string, grace_octave string, grace_base string"


def test_fields_of_notes(spark):
    rows = {
        1: ("5", "4", "1", "0", None, None, None, None), 2: ("8", None, "0", None, None, None, None, None), 3: ("8", "8", "2", "0", None, None, None, None), 4: ("9", "32", "1", "0", "1", "2", "0", "8"), 5: ("3", "7", "4", "3", "2", None, None, None),
        6: ("2", "16", "0", "1", "-1", "8", "0", "16"), 7: ("2", "4", "0", "0", "0", "3", "0", "4"), 8: ("0", "4", "2", "0", "1", "3", "0", "8"), 9: (None, "x", None, "0", None, None, None, None), 10: ("1.5", "4", "0", "0", None, None, None, None),
    }
    got = {r["note_id"]: tuple(r)[2:] for r in drafts.notes(spark.createDataFrame([(1, i, *r) for i, r in rows.items()], NOTES)).collect()}
    assert got == {
        1: (5, 4, 1, 0, None, None, None, None, "", ""), 2: (1, 4, 1, 0, None, None, None, None, "", "base_default octave_degree_normalized"), 3: (1, 8, 2, 0, None, None, None, None, "degree", ""),
        4: (0, 16, 0, 0, None, None, None, None, "degree", "duration_truncated"), 5: (3, 4, 0, 0, None, None, None, None, "base octave dots accidental", ""), 6: (2, 16, 0, 1, -1, 1, 1, 16, "", "grace_octave_normalized"),
        7: (2, 4, 0, 0, 0, None, None, None, "grace", ""), 8: (0, 4, 0, 0, None, None, None, None, "grace", ""), 9: (0, 4, 0, 0, None, None, None, None, "degree base", ""), 10: (0, 4, 0, 0, None, None, None, None, "degree", ""),
    }


def test_heads(spark):
    kind = "score_id long, title string, score_key string, meter string, tempo int, guitar_mode string, guitar_shape string, capo int"
    rows = [(1, "A", "B♭", " 6 / 8 ", 90, "fingering", "C", 3), (2, " ", "H", "5/4", 300, "other", "C", 0), (3, "x" * 201, None, None, None, None, None, None)]
    got = {r["score_id"]: tuple(r)[1:] for r in drafts.heads(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("A", "Bb", "6/8", 90, 3, "C", ""), 2: ("未命名视觉谱", "C", "4/4", None, None, None, "missing_title invalid_key invalid_meter pending_tempo pending_guitar"), 3: ("x" * 200, "C", "4/4", None, None, None, "title_truncated invalid_key invalid_meter")}


def test_lyrics_wait_with_a_reason(spark):
    notes = spark.createDataFrame([(1, 0, 0, 1, 5), (1, 0, 1, 2, 0), (1, 1, 0, 3, 6), (2, 0, 0, 4, 1)], "score_id long, m_idx long, n_idx long, note_id long, degree long")
    rows = [(0, 1, 1, "a", None, 3), (1, 1, 1, "b", None, None), (2, 2, 1, "c", None, None), (3, 9, 1, "d", None, None), (4, 3, 5, "e", None, None), (5, 3, 1, "  ", None, None), (6, 3, 1, "f", 3000.0, None), (7, 3, 1, "g", None, 1), (8, 3, 1, "h", None, 4), (9, 3, 1, "i", -5.0, 3), (10, 3, 2, "x" * 81, None, None)]
    got = {r["text"]: (r["measure"], r["reason"]) for r in drafts.lyrics(spark.createDataFrame(rows, "seq long, note_id long, verse int, text string, offset_x double, end_note_id long"), notes).collect()}
    assert got == {"a": (0, None), "b": (0, "twice"), "c": (0, "rest"), "d": (None, "no note"), "e": (1, "verse"), "  ": (1, "text"), "f": (1, "offset"), "g": (1, "end note"), "h": (1, "end note"), "i": (1, None), "x" * 81: (1, "text")}
