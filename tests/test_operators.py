"""The declared operators against DuckDB, and the decoders against literal cases."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from melisma.operators import decoders
from melisma.plans import catalog
from melisma.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, oracle, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), oracle.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["song_id", "do_pc", "key_name", "mode", "distribution_score", "cadence", "phrase_score", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(set(decoders.QUERIES) - {"text_correction", "score_comparison"}))
def test_decoders_run_and_repeat(spark, sf_dir, name):
    first, again = (decoders.QUERIES[name](spark, sf_dir).toPandas() for _ in range(2))
    assert len(first) and rows(first) == rows(again)


def test_text_correction(spark):
    got = {r["pair_id"]: r for r in decoders.correct_text(spark.createDataFrame([(1, "abcdef", "abxdef"), (2, "abc", "xyzuvw"), (3, None, "a"), (4, "hello world", "world")], "pair_id long, heard string, correct string")).collect()}
    assert (got[1]["distance"], got[1]["accepted"], got[1]["kept"]) == (1, True, 5)
    assert not got[2]["accepted"] and got[3]["distance"] == 1 and got[4]["local_score"] == 10


def test_score_comparison(spark):
    a = [(1, 0, i, float(60 + i), 16.0) for i in range(5)]
    b = [(1, 1, i, float(60 + i + (i == 2)), 16.0) for i in range(5)] + [(1, 1, 9, None, 16.0)]
    got = decoders.compare_scores(spark.createDataFrame(a + b, "pair_id long, side long, place long, midi double, ticks double")).first()
    assert (got["matched"], got["different"], got["left_only"], got["right_only"]) == (5, 1, 0, 1) and got["cost"] == 2.35


def test_quantization_rises_strictly(spark):
    events = spark.createDataFrame([(1, i, u, 1.0) for i, u in enumerate([0.1, 0.4, 1.2, 3.9, 4.1])], "song_id long, event_id long, unit double, weight double")
    got = [r["unit"] for r in decoders.quantize_onsets(events).orderBy("event_id").collect()]
    assert got == sorted(set(got)) and len(got) == 5


def test_beats_follow_the_pulse(spark):
    onsets = spark.createDataFrame([(1, f, 1.0) for f in range(4, 200, 8)], "song_id long, frame long, strength double")
    frames = [r["frame"] for r in decoders.track_beats(onsets, 8).orderBy("beat").collect()]
    assert len(frames) >= 24 and all(b - a == 8 for a, b in zip(frames[:-1], frames[1:]))


def test_chords_hold_over_a_weak_window(spark):
    c, g = [float(i in (0, 4, 7)) for i in range(12)], [float(i in (2, 7, 11)) for i in range(12)]
    weak = [{0: 0.5, 2: 0.5, 4: 0.5, 7: 1.0, 11: 0.45}.get(i, 0.0) for i in range(12)]
    rows_ = [(1, i, v) for i, v in enumerate([c, c, weak, c, g, g])]
    got = [(r["root"], r["kind"]) for r in decoders.decode_chords(spark.createDataFrame(rows_, "song_id long, window long, chroma array<double>")).orderBy("window").collect()]
    assert got == [(0, "")] * 4 + [(7, "")] * 2


def test_segmentation_smooths_and_fills(spark):
    pitch = [60.0] * 10 + [61.0] * 3 + [60.0] * 10 + [float("nan")] * 4 + [60.0] * 10
    frames = spark.createDataFrame([(1, i, p, 0.0 if math.isnan(p) else 0.7, 1.0) for i, p in enumerate(pitch)], "song_id long, frame long, pitch double, confidence double, energy double")
    got = decoders.segment_events(frames, 0.016).collect()
    assert [(r["midi"], r["start_s"], r["end_s"]) for r in got] == [(60, 0.0, round(37 * 0.016, 4))]


def test_tempo(spark):
    onsets = spark.createDataFrame([(1, f, 1.0) for f in range(0, 2000, 50)], "song_id long, frame long, strength double")
    assert abs(decoders.tempo(onsets, 0.01).first()["bpm"] - 120) < 1


def test_core_groups(spark):
    cores = spark.createDataFrame([(1, i, c, 1.0) for i, c in enumerate([60.0, 60.1, 60.05, 62.0, 62.1])], "song_id long, place long, center double, length double")
    assert [r["core_group"] for r in decoders.group_cores(cores).orderBy("place").collect()] == [0, 0, 0, 1, 1]


def test_phrase_alignment(spark):
    good, bad = math.log(0.9), math.log(0.05)
    heard = [0, 0, 1, 1, 0, 2, 2, 2, 0]
    rows_ = [(7, t, [good if k == h else bad for k in range(3)], [1, 2]) for t, h in enumerate(heard)]
    got = decoders.align_phrases(spark.createDataFrame(rows_, "line_id long, frame long, log_probs array<double>, tokens array<int>")).orderBy("token_place").collect()
    assert [(r["frame_from"], r["frame_to"]) for r in got] == [(3, 4), (5, 6)] and all(r["probability"] == 0.9 for r in got)


def test_fingerings(spark):
    assert decoders.fingering("Em") == [0, 2, 2, 0, 0, 0] and decoders.fingering("C") == [-1, 3, 2, 0, 1, 0]
    sounding = lambda label: [s + f for s, f in zip(decoders.STRINGS, decoders.fingering(label)) if f >= 0]
    for root, name in enumerate(["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]):
        found = sounding(name)
        assert min(found) % 12 == root and {p % 12 for p in found} == {(root + i) % 12 for i in (0, 4, 7)}
    assert min(sounding("C/G")) % 12 == 7 and min(sounding("D/F#")) % 12 == 6
    ninth = decoders.voicing("G9")
    assert ninth.must == {7, 11, 5, 9} and ninth.may == {7, 11, 2, 5, 9}  # the fifth may be left out
    assert decoders.voicing("Cadd9").must == {0, 4, 2} and decoders.voicing("Bdim7").may == {11, 2, 5, 8} and decoders.fingering("H7") == [] and decoders.fingering("Cm11b5") == []
    chords = spark.createDataFrame([(1, 1, "G"), (1, 2, "nothing"), (1, 3, None), (2, 1, "G")], "score_id long, measure_id long, label string")
    got = {(r["score_id"], r["measure_id"]): r["frets"] for r in decoders.fingerings(chords).collect()}
    assert got == {(1, 1): [3, 2, 0, 0, 0, 3], (1, 2): [], (1, 3): None, (2, 1): [3, 2, 0, 0, 0, 3]}


def test_documents(spark, tmp_path):
    import json

    from melisma.sources import documents

    F = documents.F
    texts = [(1, '{"a": 1}'), (2, 'so:\n```json\n{"a": 2}\n```'), (3, "```{}``` and ```{}```"), (4, None), (5, "words")]
    assert {r[0]: r[1] for r in spark.createDataFrame(texts, "i long, t string").select("i", documents.one_json(F.col("t"))).collect()} == {1: '{"a": 1}', 2: '{"a": 2}', 3: None, 4: None, 5: None}
    broken = '{"title": "x", "lyrics": [{"noteId": "n1"}, {"noteId": "n9"}], "measures": [{"id": "m1", "notes": [{"id": "n1"}]}, {"id": "m2", "no'
    got = json.loads(documents.whole_measures(broken))
    assert [m["id"] for m in got["measures"]] == ["m1"] and got["lyrics"] == [{"noteId": "n1"}] and documents.whole_measures('{"measures": [') is None
    song = spark.createDataFrame([(1, "[00:01.5][00:05.0]la\n[00:03]lo\n[ar:x]\n")], "song_id long, text string")
    assert sorted((r["start_s"], r["end_s"], r["words"]) for r in documents.lrc_lines(song, duration=9).collect()) == [(1.5, 3.0, "la"), (3.0, 5.0, "lo"), (5.0, 9.0, "la")]


def test_packages(spark, tmp_path):
    import hashlib
    import json
    import zipfile

    from melisma.sources import documents

    run = "runs/3f2504e0-4f89-41d3-9a0c-0305e82c3301"
    base = {"score/edited.jpu": b"{}", "state/workspace.json": b"{}", f"{run}/clip.wav": b"abc"}

    def package(name, files=base, manifest=None, kind=zipfile.ZIP_DEFLATED, **more):
        assets = [{"path": p, "size": len(c), "sha256": hashlib.sha256(c).hexdigest()} for p, c in files.items()]
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", kind) as z:
            z.writestr("manifest.json", json.dumps({"version": 1, "assets": assets, "runs": [], **more}) if manifest is None else manifest)
            for p, c in files.items():
                z.writestr(p, c)

    package("good")
    package("outside", base | {"../x": b"1"})
    package("lacking", {"score/edited.jpu": b"{}"})
    package("bzip", kind=zipfile.ZIP_BZIP2)
    package("changed", manifest=json.dumps({"version": 1, "runs": [], "assets": [{"path": p, "size": len(c), "sha256": "0"} for p, c in base.items()]}))
    package("unlisted", assets=[{"path": "score/edited.jpu", "size": 2, "sha256": hashlib.sha256(b"{}").hexdigest()}])
    package("unfinished", runs=[{"id": run.split("/")[1], "status": "done"}])
    package("no manifest", manifest="[]")
    (tmp_path / "none.zip").write_text("no")
    rows_ = documents.read_packages(spark, str(tmp_path / "*.zip")).collect()
    assert {r["package"].rsplit("/", 1)[1][:-4].replace("%20", " "): r["problem"] for r in rows_ if r["problem"]} == {
        "outside": "path, repeat, link or encryption", "lacking": "required file", "bzip": "compression", "changed": "digest", "unlisted": "required file", "unfinished": "run", "no manifest": "manifest", "none": "no archive",
    }
    assert {r["name"]: (r["size"], r["sha256"]) for r in rows_ if not r["problem"] and r["name"] != "manifest.json"} == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in base.items()}


def test_lrc_query_keeps_every_turn(spark, tmp_path):
    from melisma.sources import documents

    turns = [(c, t, f"line {t}") for c in (1, 2) for t in range(9)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in documents.lrc_query(spark, str(tmp_path)).collect())
    assert got == sorted((c, w, t * 10 + 0.5, t * 10 + 10.5 if t < 8 else 600.0) for c, t, w in turns)


def test_job_states(spark, tmp_path):
    ts = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    for k, batch in enumerate([[(1, ts(0), "uploading"), (2, ts(0), "uploading"), (1, ts(1), "running")], [(1, ts(5), "done"), (2, ts(6), "done")], [(3, ts(200), "uploading")], [(3, ts(201), "running")]]):
        spark.createDataFrame(pd.DataFrame(batch, columns=["job_id", "ts", "wanted"])).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("job_id long, ts timestamp, wanted string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r["job_id"], r["state"]) for r in jobs.drained(jobs.job_states(stream.withWatermark("ts", "1 minute")), "append").collect()]
    assert (1, "done") in got and (2, "uploading") in got and (3, "running") in got and (2, "error") in got


def test_pairs_aligned_together_equal_those_aligned_alone():
    """batches of pairs have the totals and ways that each pair has alone."""
    rng = np.random.default_rng(3)
    texts = [(rng.integers(0, 4, rng.integers(1, 40)), rng.integers(0, 4, rng.integers(1, 40))) for _ in range(60)]
    sizes = [(len(a), len(b)) for a, b in texts]
    batches = decoders.batches_of(sizes, 200)
    assert sorted(k for b in batches for k in b) == list(range(60)) and len(batches) < 60
    for batch in batches:
        x, y = (decoders._padded([texts[k][side] for k in batch], -1 - side) for side in (0, 1))
        same = lambda i, j: x[:, i] == y[:, j]  # noqa: B023, E731
        total, (held,) = decoders.sweep_together([sizes[k] for k in batch], lambda i, j: (np.where(same(i, j), 0.0, -1.0), [same(i, j)]), -1.0)  # noqa: B023
        local, _ = decoders.sweep_together([sizes[k] for k in batch], lambda i, j: (np.where(same(i, j), 20, -11), []), np.int32(-8), local=True)  # noqa: B023
        for at, k in enumerate(batch):
            equal = texts[k][0][:, None] == texts[k][1][None, :]
            alone, way = decoders.align_globally(np.where(equal, 0.0, -1.0), -1.0)
            assert (total[at], held[at]) == (alone, sum(equal[i, j] for i, j in way))
            assert abs(local[at] / 10 - decoders.align_locally(np.where(equal, 2.0, -1.1), -0.8)[0]) < 1e-9
