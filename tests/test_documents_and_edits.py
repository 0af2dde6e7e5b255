"""Score documents and edits against literal cases."""

import json

from melisma.operators import edits
from melisma.sources import score_documents

NOTE = {"degree": 1, "base": 4, "octave": 0, "dots": 0}


def document(**changes):
    measures = [{"id": "m1", "repeatStart": False, "repeatEnd": False, "notes": [{"id": "a", **NOTE}, {"id": "b", **NOTE}]}, {"id": "m2", "repeatStart": False, "repeatEnd": False, "notes": [{"id": "c", **NOTE}]}]
    return {"version": 2, "title": "x", "key": "C", "meter": [4, 4], "measures": measures, "spans": []} | changes


def test_rules_of_a_score(spark):
    want = {}

    def case(body, found):
        want[len(want)] = (body, found)

    def notes(*changes, **head):
        made = [{"id": f"n{i}", **NOTE, **c} for i, c in enumerate(changes)]
        return json.dumps(document(measures=[{"id": "m", "repeatStart": False, "repeatEnd": False, "notes": made}], **head))

    case(json.dumps(document()), [])
    case("no score", [("", "json")])
    case(None, [("", "json")])
    old = document(version=1)
    del old["spans"]
    case(json.dumps(old), [])
    case(json.dumps(document(meter=[5, 4], tempo=300, title=None, key="H")), [("", r) for r in ("key", "meter", "tempo", "title")])
    case(notes({"octave": 3}, {"degree": 0, "octave": 1, "accidental": 1}, {"accidental": 2}), [("n0", "note"), ("n1", "rest-accidental"), ("n1", "rest-octave"), ("n2", "accidental")])
    case(notes(*[{"base": 1}] * 2), [("m", "capacity")])
    case(notes(*[{"base": 1}] * 2, manualBarlines=True), [])
    three = {"tuplet": {"id": "t", "actual": 3, "normal": 2}}
    case(notes(three, three, three), [])
    case(notes(three, {}, three), [("t", "tuplet-group")])
    case(notes({"id": "m"}, {"grace": {"degree": 1, "octave": 0, "base": 4}}), [("m", "duplicate-id"), ("n1", "grace")])
    spans = [{"id": "s1", "type": "tie", "from": "a", "to": "b"}, {"id": "s2", "type": "tie", "from": "a", "to": "c"}, {"id": "s3", "type": "slur", "from": "c", "to": "a"}]
    ends = [{"id": "e1", "number": 3, "fromMeasure": "m2", "toMeasure": "m1"}]
    lyrics = [{"noteId": "z", "verse": 1, "text": "la"}, {"noteId": "a", "verse": 5, "text": "la"}, {"noteId": "b", "verse": 1, "text": " "}]
    case(json.dumps(document(spans=spans, endings=ends, lyrics=lyrics)), [("a:5", "lyric-verse"), ("b:1", "lyric-text"), ("e1", "ending-number"), ("e1", "ending-range"), ("s2", "tie"), ("s3", "span-ends"), ("z:1", "lyric-note")])
    bodies = spark.createDataFrame([(i, body) for i, (body, _) in want.items()], "score_id long, body string")
    got = {i: [] for i in want}
    for r in score_documents.violations(score_documents.tables(bodies)).collect():
        got[r["score_id"]].append((r["object_id"] or "", r["rule"]))
    assert {i: sorted(found) for i, found in got.items()} == {i: found for i, (_, found) in want.items()}


def test_search_end_follows_heard_syllables_up_to_a_silence(spark):
    chars = spark.createDataFrame([(1, i, 0, "x", 1.0 + i, 1.5 + i, i == 0) for i in range(3)], "song_id long, char_id long, line_id long, text string, start_s double, end_s double, manual boolean")
    heard = lambda *at: spark.createDataFrame([(1, i, t, t + 0.5) for i, t in enumerate(at)], "song_id long, event_id long, start_s double, end_s double")
    assert edits.search_ends(chars, heard(1.0, 3.0, 6.5, 30.0)).collect()[0]["search_to"] == 8.0
    assert edits.search_ends(chars, heard(1.0, 3.0, 9.5, 30.0)).collect()[0]["search_to"] == 4.5


def test_contextual_target_raises_a_flat_peak(spark):
    schema = "song_id long, event_id long, midi long, pitch_center double, start_s double, end_s double, core_start double, core_end double, confidence double, uncertain boolean"
    rows = [(1, 1, 60, 60.0, 0.0, 0.5, 0.1, 0.4, 0.9, False), (1, 2, 62, 62.4, 0.5, 1.0, 0.6, 0.9, 0.9, True), (1, 3, 62, 61.9, 1.1, 1.5, 1.2, 1.4, 0.9, False)]
    assert [tuple(r) for r in edits.targets(spark.createDataFrame(rows, schema)).collect()] == [(1, 2, 62, 63, 60.0)]


def test_what_broke_off_or_is_no_score(spark):
    from melisma.sources import documents, score_documents

    for text in ("[1]", "7", '"text"', "null", "", None):
        assert documents.whole_measures(text) is None
    whole = lambda text: json.loads(documents.whole_measures(text))
    assert whole('{"measures": [{"id": "m", "notes": [{"degree": 1}]}], "lyrics": [{"noteId": "n"}]}')["lyrics"] == []
    assert whole('{"measures": [{"id": "m", "notes": null}, 5], "spans": {"from": "a"}, "chords": [{"measureId": "m"}, {"measureId": ["m"]}, 3]}')["chords"] == [{"measureId": "m"}]
    assert whole('{"measures": null}') == {"measures": None}
    body = '{"version": 2, "measures": [{"id": "a", "notes": [{"id": "1"}, {"id": "2"}]}, {"id": "b", "notes": [{"id": "3"}]}], "lyrics": [{"noteId": "1"}, {"noteId": "3"}], "spans": []}'
    rows = [(0, body), (1, body[:100]), (2, body[:20]), (3, "[1]"), (4, None), (5, body[:-30])]
    got = {r["score_id"]: (r["measures"], r["notes"], r["lyrics"]) for r in score_documents.recovered_measures(spark.createDataFrame(rows, "score_id long, body string")).collect()}
    assert got == {0: (2, 3, 2), 1: (1, 2, None), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None), 5: (2, 3, None)}


def test_choices_of_a_stream(spark):
    from melisma.sources import streams

    piece = lambda text: 'data: {"choices":[{"delta":{"content":"' + text + '"}}]}\n\n'
    end = 'data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"total_tokens":9}}\n\ndata: [DONE]\n\n'
    bodies = {
        "whole": piece("a") + ": kept alive\n\n" + piece("b").replace("\n", "\r\n") + end, "cut": piece("a"), "length": piece("a") + end.replace('"stop"', '"length"'),
        "error": piece("a") + 'data: {"error":{"message":"too many"}}\n\n', "empty": end, "nothing": None, "two lines": 'data: {"choices":[{"delta":\ndata: {"content":"x"}}]}\n\n' + end,
    }
    got = {list(bodies)[r["stream_id"]]: (r["text"], r["problem"]) for r in streams.sent_choices(spark.createDataFrame(list(enumerate(bodies.values())), "stream_id long, body string")).collect()}
    assert got == {"whole": ("ab", None), "cut": ("a", "finish"), "length": ("a", "finish"), "error": ("a", "too many"), "empty": ("", "empty"), "nothing": ("", "finish"), "two lines": ("x", None)}


def test_packages_are_made_a_few_at_a_time():
    import pyarrow as pa

    from melisma.sources import documents

    n = 2 * documents.TOGETHER + 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if i % 3 else "<p>" for i in range(n)], pa.string())], names=["page_id", "html"])
    got = list(documents._packed([batch]))
    assert [b.num_rows for b in got] == [documents.TOGETHER] * 2 + [3]
    assert [x for b in got for x in b["path"].to_pylist()] == [str(i) for i in range(n)]
