"""Score documents and recognition results: JSON bodies to tables, upgraded to the current version, and every rule they break."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import TICKS
from ..plans.shared import kept
from ..sources import adapters
from .documents import recovered

#: Fixed values of the format: current version, meters, most measures, notes of a measure (with manual bar lines), spans, endings, lyrics.
VERSION, METERS = 2, ["4/4", "3/4", "2/4", "6/8"]
MOST_MEASURES, MOST_NOTES, MOST_MANUAL, MOST_SPANS, MOST_ENDINGS, MOST_LYRICS = 1000, 64, 512, 2000, 100, 10_000
_NOTE = "id string, degree int, base int, octave int, dots int, accidental int, tuplet struct<id string, actual int, normal int>, grace struct<degree int, octave int, base int>"
SCHEMA = (
    f"version int, title string, key string, meter array<int>, tempo double, manualBarlines boolean, measures array<struct<id string, notes array<struct<{_NOTE}>>, repeatStart boolean, repeatEnd boolean>>, "
    "spans array<struct<id string, type string, `from` string, `to` string>>, endings array<struct<id string, number int, fromMeasure string, toMeasure string>>, lyrics array<struct<noteId string, verse int, text string, offsetX double>>"
)


class ScoreTables(NamedTuple):
    """heads (one row a document), measures, notes, spans, endings and lyrics: all carry score_id."""

    heads: DataFrame
    measures: DataFrame
    notes: DataFrame
    spans: DataFrame
    endings: DataFrame
    lyrics: DataFrame


def parsed(documents: DataFrame) -> DataFrame:
    """IO1, IO5: (score_id, s) of (score_id, body). A document of version 1 gets what version 2 added: no spans, no repeats. A field
    of another type than its own is null, and so is the whole of a body that is no JSON object."""
    first = F.from_json("body", SCHEMA)
    old = F.col("s.version") == 1
    plain = F.transform("s.measures", lambda m: m.withField("repeatStart", F.lit(False)).withField("repeatEnd", F.lit(False)))
    no_spans = F.from_json(F.lit("[]"), "array<struct<id string, type string, `from` string, `to` string>>")
    s = F.col("s").withField("measures", F.when(old, plain).otherwise(F.col("s.measures"))).withField("spans", F.when(old, no_spans).otherwise(F.col("s.spans"))).withField("version", F.when(old, F.lit(VERSION)).otherwise(F.col("s.version")))
    return documents.select("score_id", first.alias("s")).select("score_id", F.when(F.col("s.version").isNotNull() | F.col("s.measures").isNotNull(), s).alias("s"))


def tables(documents: DataFrame, stored: bool = False) -> ScoreTables:
    """IO1: the tables of (score_id, body). Each is planned from the bodies; stored: the bodies are read once, and what was read and
    the notes are written to the shared folder, for steps that read them often. place: of a note in its score, from 1."""
    s = kept(parsed(documents), "score-bodies") if stored else parsed(documents)
    heads = s.select(
        "score_id", F.col("s").isNotNull().alias("readable"), "s.version", "s.title", "s.key", F.concat_ws("/", F.get("s.meter", 0), F.get("s.meter", 1)).alias("meter"), F.size("s.meter").alias("meter_parts"), "s.tempo",
        F.coalesce("s.manualBarlines", F.lit(False)).alias("manual"), F.size("s.measures").alias("n_measures"), F.size("s.spans").alias("n_spans"), F.coalesce(F.size("s.endings"), F.lit(-1)).alias("n_endings"), F.coalesce(F.size("s.lyrics"), F.lit(-1)).alias("n_lyrics"),
    )
    measures = s.select("score_id", F.posexplode("s.measures").alias("m_idx", "m")).select("score_id", "m_idx", F.col("m.id").alias("measure_id"), F.size("m.notes").alias("n_notes"), (F.col("m.repeatStart").isNotNull() & F.col("m.repeatEnd").isNotNull()).alias("repeats"), "m.notes")
    in_measure = lambda m, i: F.transform(F.coalesce(m["notes"], F.array()), lambda n, j: F.struct(i.alias("m_idx"), m["id"].alias("measure_id"), j.alias("n_idx"), n.alias("n")))
    notes = s.select("score_id", F.posexplode(F.flatten(F.transform("s.measures", in_measure))).alias("before", "x")).select("score_id", (F.col("before") + 1).alias("place"), "x.*").select(
        "score_id", "m_idx", "measure_id", "n_idx", "place", F.col("n.id").alias("note_id"), "n.degree", "n.base", "n.octave", "n.dots", F.coalesce("n.accidental", F.lit(0)).alias("accidental"),
        F.col("n.tuplet").isNotNull().alias("in_tuplet"), F.col("n.tuplet.id").alias("tuplet_id"), F.col("n.tuplet.actual").alias("actual"), F.col("n.tuplet.normal").alias("normal"),
        F.col("n.grace").isNotNull().alias("graced"), F.col("n.grace.degree").alias("grace_degree"), F.col("n.grace.octave").alias("grace_octave"), F.col("n.grace.base").alias("grace_base"),
    )
    flat = lambda name: s.select("score_id", F.inline(f"s.{name}"))
    notes = kept(notes, "score-notes") if stored else notes
    return ScoreTables(heads, measures.drop("notes"), notes, flat("spans"), flat("endings"), flat("lyrics"))


_RULES = f"""
WITH n AS (SELECT *, CASE WHEN in_tuplet THEN 2e0 / 3 ELSE 1e0 END * {TICKS} AS ticks FROM {{notes}}),
ids AS (SELECT score_id, measure_id AS id FROM {{measures}} UNION ALL SELECT score_id, note_id FROM {{notes}} UNION ALL SELECT score_id, id FROM {{spans}} UNION ALL SELECT score_id, id FROM {{endings}}
        UNION ALL SELECT DISTINCT score_id, tuplet_id FROM {{notes}} WHERE in_tuplet AND tuplet_id IS NOT NULL),
t AS (SELECT score_id, m_idx, tuplet_id, count(*) AS n, max(n_idx) - min(n_idx) AS width, count(DISTINCT base) AS bases FROM {{notes}} WHERE in_tuplet AND tuplet_id IS NOT NULL GROUP BY score_id, m_idx, tuplet_id),
p AS (SELECT /*+ MERGE(a, b) */ x.score_id, x.id, x.type, a.place AS a, b.place AS b, a.degree > 0 AND a.degree = b.degree AND a.octave = b.octave AND a.accidental = b.accidental AS one_pitch
      FROM {{spans}} AS x LEFT JOIN n AS a ON a.score_id = x.score_id AND a.note_id = x.`from` LEFT JOIN n AS b ON b.score_id = x.score_id AND b.note_id = x.`to`),
e AS (SELECT /*+ MERGE(a, b) */ x.score_id, x.id, x.number, a.m_idx AS a, b.m_idx AS b FROM {{endings}} AS x LEFT JOIN {{measures}} AS a ON a.score_id = x.score_id AND a.measure_id = x.fromMeasure LEFT JOIN {{measures}} AS b ON b.score_id = x.score_id AND b.measure_id = x.toMeasure),
l AS (SELECT /*+ MERGE(n) */ x.score_id, concat(coalesce(x.noteId, ''), ':', coalesce(CAST(x.verse AS STRING), '')) AS id, x.verse, x.text, x.offsetX, n.place, n.degree FROM {{lyrics}} AS x LEFT JOIN n ON n.score_id = x.score_id AND n.note_id = x.noteId),
head AS (SELECT score_id, explode(array(CASE WHEN NOT readable THEN 'json' END, CASE WHEN NOT coalesce(version = {VERSION}, FALSE) THEN 'version' END, CASE WHEN NOT coalesce(length(title) <= 200, FALSE) THEN 'title' END,
           CASE WHEN NOT coalesce(key RLIKE '^[A-G][#b]?$', FALSE) THEN 'key' END, CASE WHEN NOT (meter_parts = 2 AND meter IN ({", ".join(repr(m) for m in METERS)})) THEN 'meter' END, CASE WHEN tempo NOT BETWEEN 40 AND 240 THEN 'tempo' END,
           CASE WHEN n_measures NOT BETWEEN 1 AND {MOST_MEASURES} THEN 'measure-count' END, CASE WHEN n_spans NOT BETWEEN 0 AND {MOST_SPANS} THEN 'span-count' END, CASE WHEN n_endings > {MOST_ENDINGS} THEN 'ending-count' END,
           CASE WHEN n_lyrics > {MOST_LYRICS} THEN 'lyric-count' END)) AS rule, readable FROM {{heads}}),
own AS (SELECT score_id, note_id, explode(array(
           CASE WHEN NOT coalesce(degree BETWEEN 0 AND 7 AND base IN (1, 2, 4, 8, 16) AND octave BETWEEN -2 AND 2 AND dots IN (0, 1), FALSE) THEN 'note' END, CASE WHEN accidental NOT BETWEEN -1 AND 1 THEN 'accidental' END,
           CASE WHEN in_tuplet AND NOT coalesce(tuplet_id <> '' AND actual = 3 AND normal = 2 AND dots = 0, FALSE) THEN 'tuplet' END,
           CASE WHEN graced AND NOT coalesce(degree > 0 AND grace_degree BETWEEN 1 AND 7 AND grace_octave BETWEEN -2 AND 2 AND grace_base IN (8, 16), FALSE) THEN 'grace' END,
           CASE WHEN degree = 0 AND accidental <> 0 THEN 'rest-accidental' END, CASE WHEN degree = 0 AND octave <> 0 THEN 'rest-octave' END)) AS rule FROM {{notes}})
SELECT score_id, CAST(NULL AS STRING) AS object_id, rule FROM head WHERE rule = 'json' OR readable AND rule IS NOT NULL UNION ALL
SELECT score_id, note_id, rule FROM own WHERE rule IS NOT NULL UNION ALL
SELECT m.score_id, m.measure_id, 'note-count' FROM {{measures}} AS m JOIN {{heads}} AS h ON h.score_id = m.score_id WHERE NOT coalesce(m.n_notes BETWEEN 0 AND CASE WHEN h.manual THEN {MOST_MANUAL} ELSE {MOST_NOTES} END, FALSE) UNION ALL
SELECT score_id, measure_id, 'repeat' FROM {{measures}} WHERE NOT repeats UNION ALL
SELECT score_id, id, CASE WHEN coalesce(id, '') = '' THEN 'id' ELSE 'duplicate-id' END FROM ids GROUP BY score_id, id HAVING coalesce(id, '') = '' OR count(*) > 1 UNION ALL
SELECT /*+ MERGE(h) */ n.score_id, n.measure_id, 'capacity' FROM n JOIN {{heads}} AS h ON h.score_id = n.score_id WHERE NOT h.manual GROUP BY n.score_id, n.m_idx, n.measure_id, h.meter
       HAVING sum(n.ticks) > 64e0 * CAST(split_part(h.meter, '/', 1) AS DOUBLE) / CAST(split_part(h.meter, '/', 2) AS DOUBLE) + 1e-7 UNION ALL
SELECT score_id, tuplet_id, 'tuplet-group' FROM t WHERE n <> 3 OR width <> 2 OR bases <> 1 UNION ALL
SELECT score_id, tuplet_id, 'tuplet-group' FROM t GROUP BY score_id, tuplet_id HAVING count(*) > 1 UNION ALL
SELECT score_id, id, 'span-ends' FROM p WHERE NOT coalesce(a < b AND type IN ('tie', 'slur'), FALSE) UNION ALL
SELECT score_id, id, 'tie' FROM p WHERE type = 'tie' AND a < b AND NOT coalesce(b = a + 1 AND one_pitch, FALSE) UNION ALL
SELECT score_id, id, 'ending-number' FROM e WHERE NOT coalesce(number IN (1, 2), FALSE) UNION ALL
SELECT score_id, id, 'ending-range' FROM e WHERE NOT coalesce(a <= b, FALSE) UNION ALL
SELECT score_id, id, CASE WHEN place IS NULL THEN 'lyric-note' WHEN degree = 0 THEN 'lyric-rest' WHEN NOT coalesce(verse BETWEEN 1 AND 4, FALSE) THEN 'lyric-verse' WHEN NOT coalesce(length(text) <= 80 AND trim(text) <> '', FALSE) THEN 'lyric-text' ELSE 'lyric-place' END
       FROM l WHERE place IS NULL OR degree = 0 OR NOT coalesce(verse BETWEEN 1 AND 4, FALSE) OR NOT coalesce(length(text) <= 80 AND trim(text) <> '', FALSE) OR abs(offsetX) > 2000 UNION ALL
SELECT score_id, id, 'lyric-duplicate' FROM l GROUP BY score_id, id HAVING count(*) > 1
"""


def violations(score: ScoreTables) -> DataFrame:
    """DQ1, DQ2, DQ3: (score_id, object_id, rule) of every broken rule, not the first only; object_id is null for the document as a
    whole. Of a body that can't be read only 'json' is told; lyrics are named note:verse, by their first broken rule."""
    return score.heads.sparkSession.sql(_RULES, **score._asdict())


RESULT = "clipStart double, notes array<struct<start double, end double, midi int, pitchCenterMidi double, confidence double, performanceStart double, performanceEnd double, coreStart double, coreEnd double>>, pitchTrack array<struct<time double, midi double, confidence double>>"


def result_notes(results: DataFrame) -> DataFrame:
    """IO19, X27: notes of recognition results (song_id, body), shifted by the clip's start to seconds of the recording; what a note
    was performed from and to falls back to its own times; notes that don't end after they begin are left out."""
    r = results.select("song_id", F.from_json("body", RESULT).alias("r"))
    offset = F.coalesce(F.col("r.clipStart"), F.lit(0.0))
    n = r.select("song_id", offset.alias("offset"), F.posexplode("r.notes").alias("place", "n")).where("n.end > n.start")
    shifted = lambda *names: F.round(F.coalesce(*[F.col(f"n.{c}") for c in names]) + F.col("offset"), 4)
    return n.select("song_id", F.col("place").cast("long").alias("place"), shifted("start").alias("start_s"), shifted("end").alias("end_s"), F.col("n.midi").cast("long").alias("midi"),
                    shifted("performanceStart", "start").alias("performed_from"), shifted("performanceEnd", "end").alias("performed_to"), shifted("coreStart").alias("core_from"), shifted("coreEnd").alias("core_to"))


def result_frames(results: DataFrame) -> DataFrame:
    """IO19: (song_id, at, midi, confidence) of the pitch track of recognition results, in seconds of the recording."""
    r = results.select("song_id", F.from_json("body", RESULT).alias("r"))
    t = r.select("song_id", F.coalesce("r.clipStart", F.lit(0.0)).alias("offset"), F.inline("r.pitchTrack")).where("time IS NOT NULL")
    return t.select("song_id", F.round(F.col("time") + F.col("offset"), 4).alias("at"), "midi", "confidence")


def _documents(spark, sf_dir: str) -> DataFrame:
    """Each score as a document: every fifth of version 1, every seventh without a title, every eleventh broken off."""
    notes = adapters.view(spark, sf_dir, "notes").selectExpr("*", "lead(note_id) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS next_id")
    note = F.struct("n_idx", F.col("note_id").cast("string").alias("id"), "degree", "base", "octave", "dots", "accidental")
    span = F.when(F.col("tie") & F.col("next_id").isNotNull(), F.struct(F.concat(F.lit("t"), "note_id").alias("id"), F.lit("tie").alias("type"), F.col("note_id").cast("string").alias("from"), F.col("next_id").cast("string").alias("to")))
    measure = notes.groupBy("score_id", "m_idx", "measure_id").agg(F.array_sort(F.collect_list(note)).alias("notes"), F.collect_list(span).alias("spans"))
    old = F.col("score_id") % 5 == 0
    shown = F.struct("m_idx", F.concat(F.lit("m"), "measure_id").alias("id"), "notes", F.when(~old, F.lit(False)).alias("repeatStart"), F.when(~old, F.lit(False)).alias("repeatEnd"))
    whole = measure.groupBy("score_id").agg(F.array_sort(F.collect_list(shown)).alias("measures"), F.flatten(F.collect_list("spans")).alias("spans"))
    body = F.to_json(F.struct(F.when(old, 1).otherwise(2).alias("version"), F.when(F.col("score_id") % 7 > 0, "a song").alias("title"), F.lit("Eb").alias("key"), F.array(F.lit(4), F.lit(4)).alias("meter"), "measures", F.when(~old, F.col("spans")).alias("spans")))
    return whole.select("score_id", F.when(F.col("score_id") % 11 == 0, F.expr("'broken off'")).otherwise(body).alias("body"))


def _results(spark, sf_dir: str) -> DataFrame:
    events = adapters.view(spark, sf_dir, "note_events")
    note = F.struct(F.col("start_s").alias("start"), "event_id", F.col("end_s").alias("end"), "midi", F.col("performance_end").alias("performanceEnd"), F.col("core_start").alias("coreStart"), F.col("core_end").alias("coreEnd"))
    body = F.to_json(F.struct(F.when(F.col("song_id") % 3 > 0, F.col("song_id") % 3 * F.lit(1.5)).alias("clipStart"), "notes"))
    return events.groupBy("song_id").agg(F.array_sort(F.collect_list(note)).alias("notes")).select("song_id", body.alias("body"))


def recovered_measures(documents: DataFrame) -> DataFrame:
    """IO3: (score_id, measures, notes, lyrics, spans) of what is left of (score_id, body) that may have broken off; null: nothing."""
    kept = recovered(documents, "body")
    count = lambda path: F.json_array_length(F.get_json_object("recovered", path)).cast("long")
    notes = F.aggregate(F.from_json(F.get_json_object("recovered", "$.measures"), "array<struct<notes:array<struct<id:string>>>>"), F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.size(m["notes"]), F.lit(0)).cast("long"))
    return kept.select("score_id", count("$.measures").alias("measures"), notes.alias("notes"), count("$.lyrics").alias("lyrics"), count("$.spans").alias("spans"))


def _broken(spark, sf_dir):
    """The documents of scores, most of them broken off at some place."""
    length = F.length("body")
    return _documents(spark, sf_dir).select("score_id", F.expr("left(body, CAST(length(body) * (score_id % 10 + 1) / 10 AS INT))").alias("body")).where(length >= 0)


QUERIES = {
    "document_notes": lambda s, d: tables(_documents(s, d)).notes.select("score_id", F.col("m_idx").cast("long").alias("m_idx"), F.col("note_id").cast("long").alias("note_id"), *[F.col(c).cast("long").alias(c) for c in ("degree", "base", "octave", "dots", "accidental")]),
    "document_violations": lambda s, d: violations(tables(_documents(s, d), stored=True)),
    "result_notes": lambda s, d: result_notes(_results(s, d)),
    "recovered_measures": lambda s, d: recovered_measures(_broken(s, d)),
}
_NOTES = f"WITH notes AS ({adapters.oracle_view('notes')}), "
ORACLES = {
    "document_notes": _NOTES + "d AS (SELECT *, dense_rank() OVER (PARTITION BY score_id ORDER BY m_idx) - 1 AS measure FROM notes) SELECT score_id, CAST(measure AS BIGINT) AS m_idx, note_id, degree, base, octave, dots, accidental FROM d WHERE score_id % 11 > 0",
    "document_violations": _NOTES + f"""k AS (SELECT *, lead(note_id) OVER w AS next_id, degree = lead(degree) OVER w AND octave = lead(octave) OVER w AND accidental = lead(accidental) OVER w AS same FROM notes WINDOW w AS (PARTITION BY score_id ORDER BY m_idx, n_idx))
SELECT DISTINCT score_id, CAST(NULL AS VARCHAR) AS object_id, 'json' AS rule FROM k WHERE score_id % 11 = 0 UNION ALL SELECT DISTINCT score_id, NULL, 'title' FROM k WHERE score_id % 7 = 0 AND score_id % 11 > 0 UNION ALL
SELECT score_id, concat('m', measure_id), 'capacity' FROM k WHERE score_id % 11 > 0 GROUP BY score_id, measure_id HAVING sum({TICKS}) > 64 + 1e-7 UNION ALL
SELECT score_id, concat('t', note_id), 'tie' FROM k WHERE score_id % 11 > 0 AND score_id % 5 > 0 AND tie AND next_id IS NOT NULL AND NOT same""",
    "result_notes": f"""WITH note_events AS ({adapters.oracle_view('note_events')}), o AS (SELECT *, song_id % 3 * 1.5e0 AS offs FROM note_events)
SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) - 1 AS BIGINT) AS place, round(start_s + offs, 4) AS start_s, round(end_s + offs, 4) AS end_s, midi, round(start_s + offs, 4) AS performed_from,
       round(coalesce(performance_end, end_s) + offs, 4) AS performed_to, round(core_start + offs, 4) AS core_from, round(core_end + offs, 4) AS core_to FROM o""",
}
