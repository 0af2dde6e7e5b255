"""Printed pages read into notes: literal cases, in pixels of a page of 500 by 240."""

import pytest

from melisma.operators import pages

WIDTH, HEIGHT = 500, 240
OBSERVED = "page_id long, place long, tab boolean, width double, glyphs array<struct<ch:string,x:double,y:double,height:double,octave:int,dots:int,beams:int>>"


def glyph(ch, x, y, height=22, octave=0, dots=0, beams=0):
    return (ch, x / WIDTH, y / HEIGHT, height / HEIGHT, octave, dots, beams)


def line(text, xs, y, **more):
    return [glyph(ch, x, y, **more) for ch, x in zip(text, xs)]


PAGES = {
    "bars": dict(rows=[[glyph("1", 60, 82, beams=1), glyph("2", 110, 82), glyph("3", 160, 82), glyph("4", 260, 82, beams=2), glyph("5", 310, 82), glyph("6", 360, 82)], ("tab", line("12345", [60, 130, 200, 270, 340], 138, height=16))], bars=[(82, 200), (82, 400)], chords=[("C", 50, 12), ("G", 275, 12)]),
    "no bars": dict(rows=[line("1234567", range(40, 440, 60), 80)], bars=[]),
    "digits on bars": dict(rows=[line("371l5", [60, 190, 203, 398, 450], 90)], bars=[(90, 200), (90, 400)]),
    "signs, holds and dots": dict(rows=[[glyph("#", 50, 80), glyph("1", 60, 80, octave=1), glyph("-", 100, 80), glyph("b", 130, 80), glyph("5", 140, 80, dots=1), glyph("-", 160, 80), glyph("—", 200, 80), glyph("0", 260, 80), glyph("-", 300, 80), glyph("3", 340, 80), glyph("·", 352, 80), glyph("%", 420, 80, octave=-1)]], bars=[(80, 220), (80, 380)]),
    "lyrics": dict(rows=[line("1-23", [60, 110, 160, 260], 80), line("我们好", [58, 64, 108], 110), line("山水", [250, 490], 110)], bars=[(80, 210)]),
    "two rows": dict(rows=[line("我的歌曲", [100, 120, 140, 160], 10), line("1=D3/4", [200, 205, 210, 220, 225, 230], 12), line("123", [60, 110, 260], 80), line("456", [60, 260, 310], 180), line("Am7G", [61, 68, 74, 300], 215)], bars=[(80, 210), (80, 400), (180, 210)]),
    "words only": dict(rows=[line("没有音符", [100, 120, 140, 160], 50)], bars=[]),
}


@pytest.fixture(scope="module")
def read(spark):
    seen, bars, chords = [], [], []
    for n, page in enumerate(PAGES.values()):
        for i, row in enumerate(page["rows"]):
            tab, glyphs = (True, row[1]) if row[0] == "tab" else (False, row)
            seen.append((n, i, tab, float(WIDTH), glyphs))
        bars += [(n, y / HEIGHT, x / WIDTH) for y, x in page["bars"]]
        chords += [(n, y / HEIGHT, x / WIDTH, label) for label, x, y in page.get("chords", ())]
    seen.append((99, 0, False, float(WIDTH), None))
    found = pages.parsed_pages(spark.createDataFrame(seen, OBSERVED), spark.createDataFrame(bars, "page_id long, y double, x double"), spark.createDataFrame(chords, "page_id long, y double, x double, label string"))
    of = lambda df, *order: {name: [r for r in rows if r["page_id"] == n] for rows in [df.orderBy("page_id", *order).collect()] for n, name in enumerate(PAGES)}
    return of(found.notes, "place"), of(found.chords, "measure", "x"), of(found.heads)


def test_bars_beams_and_tablature(read):
    notes, chords, heads = read
    got = notes["bars"]
    assert [(n["degree"], n["measure"]) for n in got] == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)]
    assert [n["base"] for n in got] == [8, 4, 4, 16, 4, 4]
    assert [(c["measure"], c["label"]) for c in chords["bars"]] == [(1, "C"), (2, "G")] and heads["bars"][0]["unbarred"] == 0


def test_missing_bars_stay_one_measure(read):
    notes, _, heads = read
    assert {n["measure"] for n in notes["no bars"]} == {1} and len(notes["no bars"]) == 7 and heads["no bars"][0]["unbarred"] == 1


def test_digits_that_stand_on_bars_are_none(read):
    assert [(n["degree"], n["measure"]) for n in read[0]["digits on bars"]] == [(3, 1), (7, 1), (5, 3)]


def test_signs_holds_and_dots(read):
    got = [(n["degree"], n["accidental"], n["octave"], n["dots"], n["hold"], n["measure"]) for n in read[0]["signs, holds and dots"]]
    assert got == [(1, 1, 1, 0, False, 1), (1, 0, 0, 0, True, 1), (5, -1, 0, 1, False, 1), (5, 0, 0, 0, True, 1), (0, 0, 0, 0, False, 2), (0, 0, 0, 0, False, 2), (3, 0, 0, 1, False, 2), (6, 0, -1, 0, False, 3)]


def test_syllables_go_to_the_nearest_sounding_note(read):
    assert [n["lyric"] for n in read[0]["lyrics"]] == ["我们好", "", "", "山水"]


def test_rows_key_meter_title_and_letters_below(read):
    notes, chords, heads = read
    assert [(n["degree"], n["measure"]) for n in notes["two rows"]] == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 4)]
    head = heads["two rows"][0]
    assert (head["score_key"], head["meter"], head["title"], head["systems"]) == ("D", "3/4", "我的歌曲", 2)
    assert [(c["measure"], c["label"]) for c in chords["two rows"]] == [(3, "Am7"), (4, "G")]


def test_pages_without_notes(read):
    notes, _, heads = read
    assert notes["words only"] == [] and heads["words only"][0]["systems"] == 0 and heads["words only"][0]["meter"] == "4/4"


def test_heads_do_not_wait_for_notes(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(pages, "kept", lambda df, label: wrote.append(label) or df)
    seen = spark.createDataFrame([], OBSERVED)
    bars, chords = spark.createDataFrame([], "page_id long, y double, x double"), spark.createDataFrame([], "page_id long, y double, x double, label string")
    assert pages.parsed_pages(seen, bars, chords).heads.count() == 0
    assert "page-rows" in wrote and "page-notes" not in wrote
