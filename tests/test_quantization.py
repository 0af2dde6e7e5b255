"""Onsets on a grid: literal cases, in sixteenths of 120 beats a minute unless said otherwise."""

import pytest

from melisma.operators import quantization

KIND = "song_id long, event_id long, start_s double, end_s double, midi long, confidence double, core_start_s double, core_end_s double, manual boolean, uncertain boolean, recovered boolean, crest boolean, weights array<double>, anchor_s double, step_s double"


def event(midi, start, end, a=0.01, b=0.01, weights=None, **flags):
    core = flags.pop("core", (start + a, end - b))
    return dict(midi=midi, start=start, end=end, core=core, weights=weights, **flags)


EARLY = dict(core=(1.98, 2.4), weights=[0.05, 0.1, 0.35, 0.5])
ENTRY = [0.089894, 0, 0.126394, 0, 0.1145447, 0, 0.1127898, 0, 0.1228891, 0, 0.0653473, 0.0646611, 0.0618906, 0.0568164, 0.051015, 0.044545, 0.0361315, 0.0266432, 0.0169594, 0.009479]


def entry(**change):
    first = dict(core=(1.866, 2.19), weights=[1.0, 1.0, 1.0, 1.0]) | change
    return [event(59, 1.866, first.pop("end", 2.19), **first), event(62, 2.25, 2.4), event(62, 2.5, 2.8), event(62, 3.0, 3.4)]


SONGS = {
    "collision": [event(60, 0.065, 0.18), event(62, 0.18, 0.3), event(64, 0.5, 1)],
    "run": [event(60, 0, 0.125), event(61, 0.125, 0.25), event(62, 0.25, 0.375), event(63, 0.375, 0.5), event(64, 2, 2.5, manual=True)],
    "fragments": [event(60, 0, 0.03), event(61, 0.03, 0.05), event(62, 0.05, 0.2), event(64, 0.5, 1)],
    "early": [event(60, 1.5, 1.8), event(55, 1.905, 2.42, **EARLY), event(57, 2.5, 3)],
    "syncopation": [event(55, 1.75, 2.5, core=(1.76, 2.48)), event(57, 2.6, 3)],
    "pickup": [event(55, 1.875, 2.5, core=(1.875, 2.48)), event(57, 2.6, 3)],
    "energy before": [event(55, 1.905, 2.42, core=(1.98, 2.4), weights=[0.95, 0.02, 0.02, 0.01]), event(57, 2.5, 3)],
    "manual": [event(55, 1.905, 2.42, core=(1.98, 2.4), manual=True), event(57, 2.5, 3)],
    "no energy": [event(55, 1.905, 2.42, core=(2.01, 2.4))],
    "repeated pickups": [x for end in (2, 4) for x in (event(60, end - 0.5, end - 0.25), event(55, end - 0.125, end + 0.42, core=(end - 0.125, end + 0.4)), event(57, end + 0.5, end + 1))] + [event(60, 5.5, 5.75), event(55, 5.905, 6.42, core=(5.98, 6.4)), event(57, 6.5, 7)],
    "crest": [event(58, 0.275, 0.325, core=(None, None), crest=True, uncertain=True), event(57, 0.325, 0.5, core=(None, None))],
    "covered": [event(60, 0.5, 0.9), event(62, 0.51, 0.7, recovered=True), event(64, 1, 1.4)],
    "entry": entry(), "entry manual": entry(manual=True), "entry uncertain": entry(uncertain=True), "entry early energy": entry(weights=[1.0, 0.0, 0.0, 0.0]), "entry short": entry(end=2.04, core=(1.866, 2.04)), "entry after a note": [event(60, 1.5, 1.75), *entry()], "entry alone": entry()[:2],
    "entry off the eighths": [*entry()[:2], event(62, 2.625, 2.8), entry()[3]],
    "slow entry": [event(59, 17.792, 18.112, core=(17.792, 18.112), weights=[float(w) for w in ENTRY]), event(62, 18.192, 18.352), event(62, 18.496, 18.816), event(62, 18.96, 19.408)],
}


@pytest.fixture(scope="module")
def placed(spark):
    rows = []
    for n, (name, song) in enumerate(SONGS.items()):
        anchor, step = (15.84, 60 / 114.9946 / 4) if name == "slow entry" else (0.0, 0.125)
        rows += [(n, i, float(e["start"]), float(e["end"]), e["midi"], 0.95, *e["core"], e.get("manual"), e.get("uncertain"), e.get("recovered"), e.get("crest"), e["weights"], anchor, step) for i, e in enumerate(song)]
    got = {name: {} for name in SONGS}
    for r in quantization.placed_onsets(spark.createDataFrame(rows, KIND)).collect():
        got[list(SONGS)[r["song_id"]]][r["event_id"]] = r
    return got


@pytest.mark.parametrize("name, units", {
    "run": [0, 1, 2, 3, 16], "syncopation": [14, 21], "pickup": [15, 21], "manual": [15, 20], "energy before": [15, 20], "entry manual": [15], "entry uncertain": [15], "entry early energy": [15], "entry short": [15], "entry alone": [15], "entry off the eighths": [15], "slow entry": [16, 18, 20, 24],
}.items())
def test_places(placed, name, units):
    assert [placed[name][i]["unit"] for i in range(len(units))] == units


def test_collisions_keep_sustained_notes_and_drop_fragments(placed):
    got = placed["collision"]
    assert len(got) == 3 and got[1]["unit"] > got[0]["unit"] and got[2]["unit"] == 4
    assert len(placed["fragments"]) == 2 and placed["fragments"][3]["unit"] == 4
    assert len(placed["crest"]) == 2 and placed["crest"][0]["unit"] < placed["crest"][1]["unit"]
    assert set(placed["covered"]) == {0, 2}


def test_early_entries_move_to_the_line_with_evidence(placed):
    early = placed["early"][1]
    assert early["unit"] == 16 and early["reason"] == "early-entry-to-downbeat" and early["energy_share"] > 0.8 and early["moved"]
    assert placed["no energy"][0]["unit"] == 16 and placed["no energy"][0]["energy_share"] is None
    assert placed["entry"][0]["unit"] == 16 and placed["entry"][0]["reason"] == "phrase-entry-to-downbeat" and placed["slow entry"][0]["reason"] == "phrase-entry-to-downbeat"
    assert placed["manual"][0]["reason"] == "manual-position" and placed["entry after a note"][1]["unit"] == 15


def test_repeated_pickups_lessen_the_preference(placed):
    last = placed["repeated pickups"][7]
    assert last["unit"] == 47 and last["pickups"] == 2 and last["reason"] == "nearest-grid-with-context"
