"""Edits of measures, edits carried over, and the project store: literal cases."""

import pytest

from melisma.operators import bars
from melisma.sources import projects

NOTES = "score_id long, measure_id long, m_idx long, n_idx long, note_id long, degree long, base int, octave long, dots long, accidental long, tie boolean, source_s double"
EDITS = "score_id long, seq long, kind string, note_id long, m_idx long"
SCORES = "score_id long, score_key string, bpm int, meter int, capo int"


def note(i, measure, base=4, degree=1, tie=False, dots=0, source=None):
    return (1, 100 + measure, measure, i, i, degree, base, 0, dots, 0, tie, source)


PIECE = [note(0, 0, 4, source=1.0), note(1, 0, 4, tie=True, source=1.5), note(2, 0, 2, source=2.0), note(3, 1, 1), note(4, 2, 8), note(5, 2, 8)]


def edited(spark, notes, *edits):
    e = spark.createDataFrame([(1, i, *x) for i, x in enumerate(edits)], EDITS)
    return bars.edited_bars(notes, e), {r["seq"]: r["refused"] for r in bars.refusals(notes, e).collect()}


def layout(df):
    out = {}
    for r in df.orderBy("m_idx", "n_idx").collect():
        out.setdefault((r["m_idx"], r["measure_id"]), []).append(r["note_id"])
    return list(out.items())


def test_line_inserted_then_deleted_gives_the_first_table_back(spark):
    first = spark.createDataFrame(PIECE, NOTES)
    more, refused = edited(spark, first, ("insert", 2, None))
    assert refused == {0: None} and layout(more) == [((0, 100), [0, 1]), ((1, -2), [2]), ((2, 101), [3]), ((3, 102), [4, 5])]
    assert {r["m_idx"]: r["measure_ticks"] for r in more.collect()} == {0: 32.0, 1: 32.0, 2: 64.0, 3: 16.0} and {r["m_idx"] for r in more.where("manual").collect()} == {1}
    back, _ = edited(spark, more.select(*first.columns), ("delete", None, 0))
    assert layout(back) == [((0, 100), [0, 1, 2]), ((1, 101), [3]), ((2, 102), [4, 5])]
    again = back.select("score_id", "measure_id", "m_idx", "note_id", "tie", "source_s", "base").orderBy("note_id").collect()
    assert again == first.select("score_id", "measure_id", "m_idx", "note_id", "tie", "source_s", "base").orderBy("note_id").collect()


def test_lines_move_within_their_two_measures(spark):
    first = spark.createDataFrame(PIECE, NOTES)
    moved, refused = edited(spark, first, ("move", 2, 0))
    assert refused == {0: None} and layout(moved) == [((0, 100), [0, 1]), ((1, -2), [2, 3]), ((2, 102), [4, 5])]
    _, refused = edited(spark, first, ("move", 5, 0), ("move", 0, 0), ("insert", 3, None), ("insert", 77, None), ("delete", None, 2), ("delete", None, 9))
    assert refused == {0: "beyond its measures", 1: "beyond its measures", 2: "begins a measure", 3: "no note", 4: "last line", 5: "no measure"}


def test_notes_that_a_line_cuts_become_tied_parts(spark):
    rows = [note(0, 0, 2, source=0.0), note(1, 0, 1, degree=5, source=2.0), note(2, 0, 2, degree=0, dots=1, source=6.0)]
    got = bars.rebarred(spark.createDataFrame(rows, NOTES), spark.createDataFrame([(1, "C", 60, 3, 0)], SCORES)).orderBy("m_idx", "n_idx").collect()
    assert [(r["m_idx"], r["note_id"], r["part"], r["part_ticks"], r["tie"], r["source_s"]) for r in got] == [
        (0, 0, 0, 32.0, False, 0.0), (0, 1, 0, 16.0, True, 2.0), (1, 1, 1, 48.0, False, 3.0), (2, 2, 0, 48.0, False, 6.0)]
    assert sum(r["part_ticks"] for r in got) == 32 + 64 + 48


def test_rests_fill_a_measure_or_are_refused(spark):
    rows = [note(0, 0, 8), note(1, 1, 1), note(2, 2, 16, dots=1)]
    got = bars.rests(spark.createDataFrame(rows, NOTES), spark.createDataFrame([(1, "C", 60, 4, 0)], SCORES)).orderBy("m_idx", "n_idx").collect()
    assert [(r["m_idx"], r["base"], r["refused"]) for r in got] == [(0, 4, None), (0, 4, None), (0, 4, None), (0, 8, None), (2, None, "no rests fill it")]


def test_copies_stand_after_a_note_under_new_ids(spark):
    notes = spark.createDataFrame(PIECE, NOTES)
    clip = lambda ids, after: spark.createDataFrame([(1, i, after) for i in ids], "score_id long, note_id long, after_id long")
    got = bars.pasted(notes, clip([1, 2, 3], 4)).orderBy("m_idx", "n_idx").collect()
    assert [(r["m_idx"], r["note_id"]) for r in got] == [(0, 0), (0, 1), (0, 2), (1, 3), (2, 4), (2, -1), (2, -2), (2, 5), (3, -3)]
    assert all(r["source_s"] is None and r["copy_of"] == -r["note_id"] for r in got if r["note_id"] < 0)
    assert [r["note_id"] for r in bars.pasted(notes, clip([3], 0)).orderBy("m_idx", "n_idx").collect()] == [0, 1, 2, 3, 4, 5]  # would overflow


EARLIER = "score_id long, m_idx long, n_idx long, note_id long, event_id long, source_s double, degree long, octave long, accidental long, corrected boolean, confirmed boolean, original_degree long, original_octave long"
LATER = "score_id long, m_idx long, n_idx long, note_id long, event_id long, source_s double, degree long, octave long, accidental long"


def test_edits_are_carried_over_by_event_then_time(spark):
    earlier = spark.createDataFrame([
        (1, 0, 0, 1, 10, 1.0, 5, 1, 0, False, False, None, None), (1, 0, 1, 2, 11, 2.0, 3, 0, 1, True, False, 7, -1), (1, 0, 2, 3, 12, 3.0004, 4, 0, 0, True, True, 6, 0),
        (1, 0, 3, 4, 13, 4.0, 2, 0, 0, False, False, None, None), (1, 1, 0, 5, 14, 5.0, 6, 0, 0, False, False, None, None), (1, 1, 1, 6, 14, 5.5, 6, 0, 0, False, False, None, None),
    ], EARLIER)
    later = spark.createDataFrame([
        (1, 0, 0, 101, 10, 1.2, 1, 0, 0), (1, 0, 1, 102, 11, 2.0, 1, 0, 0), (1, 0, 2, 103, 99, 3.0, 1, 0, 0), (1, 0, 3, 104, 13, 4.0, 1, 0, 0), (1, 1, 0, 105, 14, 5.0, 1, 0, 0), (1, 1, 1, 106, 14, 5.5, 1, 0, 0), (1, 2, 0, 107, 50, 9.0, 1, 2, 1), (1, 2, 1, 108, 12, None, 1, 0, 0),
    ], LATER)
    deleted = spark.createDataFrame([(13,)], "event_id long")
    got = {r["note_id"]: (r["reason"], r["old_id"], r["degree"], r["octave"], r["accidental"]) for r in bars.reconciled(earlier, later, deleted).collect()}
    assert got == {
        101: ("same event", 1, 5, 1, 0), 102: ("same event", 2, 7, -1, 0), 103: ("same time", 3, 4, 0, 0), 104: ("deleted", None, 0, 0, 0), 105: ("same event", 6, 6, 0, 0), 106: ("same event", 6, 6, 0, 0), 107: ("new", None, 1, 2, 1), 108: ("no time", None, 1, 0, 0),
    }
    lyrics = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (4, 1, "c"), (5, 1, "d"), (6, 2, "e"), (3, 1, "f")], "note_id long, verse int, text string")
    there = spark.createDataFrame([(102, 1, "x")], "note_id long, verse int, text string")
    moved = {r["text"]: (r["note_id"], r["reason"]) for r in bars.moved_lyrics(earlier, later, deleted, lyrics, there).collect()}
    assert moved == {"a": (101, "moved"), "b": (None, "occupied"), "c": (None, "no note"), "d": (105, "moved"), "e": (105, "moved"), "f": (103, "moved")}


def test_readers_see_whole_revisions_only(spark, tmp_path, monkeypatch):
    store = projects.ProjectStore(spark, f"file://{tmp_path}/store")
    assert store.revision() == (0, None)
    one, two = (spark.createDataFrame([(1, name)], "project_id long, name string") for name in ("one", "two"))
    assert store.write({"projects": one, "assets": one}, 0) == 1
    reader = store.read("projects")
    # the writer dies after its folder, before the pointer
    monkeypatch.setattr(projects.ProjectStore, "_published", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.write({"projects": two}, 1)
    monkeypatch.undo()
    assert store.revision()[0] == 1 and store.read("projects").first()["name"] == "one"
    assert store.write({"projects": two}, 1) == 2
    assert store.read("projects").first()["name"] == "two" and store.read("assets").first()["name"] == "one"
    assert reader.first()["name"] == "one"  # what was opened stays whole
    with pytest.raises(projects.Conflict):
        store.write({"projects": one}, 1)
    assert store.revision()[0] == 2


def test_register_and_changes(spark, tmp_path):
    for name, files in (("before", {"p1/audio/original.mp3": b"abc", "p1/notes.txt": b"x", "p2/audio/original.wav": b"wav"}), ("after", {"p1/audio/original.mp3": b"abd", "p2/audio/original.wav": b"wav", "p2/audio/original.m4a": b"new"})):
        for path, content in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_bytes(content)
    before, after = (projects.registered_files(spark, f"{tmp_path}/{name}") for name in ("before", "after"))
    assert {(r["project_id"], r["path"], r["size"], r["accepted"], r["sha256"][:8]) for r in before.collect()} == {("p1", "audio/original.mp3", 3, True, "ba7816bf"), ("p1", "notes.txt", 1, False, "2d711642"), ("p2", "audio/original.wav", 3, True, "61e25c2c")}
    assert sorted((r["path"], r["change"]) for r in projects.changed_assets(before, after).collect()) == [("audio/original.m4a", "added"), ("audio/original.mp3", "changed"), ("notes.txt", "removed")]


def test_what_calls_for_a_new_look(spark):
    kind = "project_id long, score string, based_on string, runs array<struct<id:string,status:string,notation:string>>, workspace string"
    run = [("r", "done", "a")]
    before = spark.createDataFrame([(i, "s", "b", run, "w") for i in range(6)], kind)
    after = spark.createDataFrame([(0, "s", "b", run, "other"), (1, "t", "b", run, "w"), (2, "s", None, run, "w"), (3, "s", "b", [("r", "running", "a")], "w"), (4, "s", "b", run, "w")], kind)
    path = "runs/3f2504e0-4f89-41d3-9a0c-0305e82c3301/result.json"
    asset = lambda digest: spark.createDataFrame([(4, path, 1, digest, True), (0, "audio/original.mp3", 1, digest, True)], "project_id long, path string, size long, sha256 string, accepted boolean")
    got = {r["project_id"]: r["reason"] for r in projects.changed_projects(before, after, asset("x"), asset("y")).collect()}
    assert got == {1: "score", 2: "based on", 3: "runs", 4: "assets", 5: "project"}
