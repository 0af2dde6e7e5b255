"""Canonical musical tables, as deterministic views of the relational test tables: synthetic exercise, not music.

note_events(song_id, event_id, start_s, end_s, midi, pitch_center, confidence, uncertain, core_start, core_end, performance_end,
    pitch_reliability, recovery_reason): detector output in seconds of the song, from events. A song's events follow each other by
    half a second and pause after every eighth, some hold a flat peak or begin together; a note's stable core, its performed end and its reliability may be unknown.
notes(score_id, measure_id, m_idx, n_idx, note_id, degree, base, octave, dots, accidental, tie, source_s): written notes, from
    lineitem; tie: the note is held into the next one; source_s: its time in the recording, if known.
chords(score_id, measure_id, label): a chord label of each measure, from orders.
scores(score_id, score_key, bpm, meter, capo): the head of each score, from orders.
characters(song_id, char_id, line_id, text, start_s, end_s, manual): timed lyric characters, from events.
chroma(window_id, song_id, pc, weight): twelve pitch-class weights of each window, from embeddings.
suggestions, lyric_edits, bar_marks: edits of the notes; frames(song_id, frame, pitch, voiced, confidence, energy, onset): what a pitch
    detector found in each frame; emissions(frame, token, sound, log_p): log probabilities of syllables and what they sound like.
lines(conv_id, turn, role, text): lyric lines in order, from conversations.
library(project_id, revision, published_at, title, status): published snapshots, from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import kept

#: One text for both engines.
VIEWS = {
    "note_events": """
        SELECT user_id AS song_id, event_id, s AS start_s, round(s + (1e-1 + (event_id % 16) * 5e-2), 3) AS end_s,
               CAST(CASE WHEN r % 40 = 11 THEN 57 WHEN r % 40 IN (12, 13) THEN 59 ELSE 48 + (CAST(floor(value) AS BIGINT) % 24) END AS BIGINT) AS midi,
               CASE WHEN r % 40 = 11 THEN 57e0 WHEN r % 40 = 12 THEN 594e-1 WHEN r % 40 = 13 THEN 5905e-2 ELSE 48 + (CAST(floor(value) AS BIGINT) % 24) + (event_id % 7 - 3) * 1e-1 END AS pitch_center,
               5e-1 + (event_id % 6) * 1e-1 AS confidence, CASE WHEN r % 40 IN (11, 13) THEN false WHEN r % 40 = 12 THEN true ELSE event_type = 'error' END AS uncertain,
               CASE WHEN event_id % 9 > 0 THEN round(s + 2e-2, 3) END AS core_start, CASE WHEN event_id % 9 > 0 THEN round(s + (8e-2 + (event_id % 16) * 5e-2), 3) END AS core_end,
               CASE WHEN event_id % 4 = 0 THEN round(s + (15e-2 + (event_id % 16) * 5e-2), 3) END AS performance_end,
               CASE WHEN event_id % 3 = 0 THEN 4e-1 + (event_id % 5) * 1e-1 END AS pitch_reliability, CASE WHEN event_id % 23 = 0 THEN 'gap' END AS recovery_reason
        FROM (SELECT user_id, event_id, value, event_type, r, CASE WHEN r % 41 = 20 THEN (r - 1) * 5e-1 + floor((r - 1) / 8) WHEN r % 41 = 21 THEN round((r - 2) * 5e-1 + floor((r - 2) / 8) + 1e-3, 3) ELSE round((r - 1) * 5e-1 + floor((r - 1) / 8) + (event_id % 7) * 3e-2, 3) END AS s
              FROM (SELECT user_id, event_id, value, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS r FROM {events}) AS x) AS e""",
    "notes": """
        SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS score_id, l_orderkey AS measure_id, l_orderkey % 32 AS m_idx, n_idx,
               l_orderkey * 100 + n_idx AS note_id, l_partkey % 8 AS degree,
               CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS base,
               CASE WHEN l_partkey % 8 = 0 THEN 0 ELSE l_suppkey % 5 - 2 END AS octave, l_suppkey % 2 AS dots,
               CASE WHEN l_partkey % 8 = 0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) % 3 - 1 END AS accidental,
               l_suppkey % 4 = 0 AND l_partkey % 8 > 0 AS tie, CASE WHEN l_orderkey % 32 > 0 OR n_idx > 2 THEN round((l_orderkey % 32) * 2e0 + n_idx * 25e-2 + 3e0, 3) END AS source_s
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS n_idx FROM {lineitem}) AS l""",
    "lines": "SELECT conv_id, turn, role, text FROM {conversations}",
    "library": """
        SELECT o_custkey AS project_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS revision,
               o_orderkey AS score_id, o_orderstatus AS status, o_totalprice AS audio_offset, o_orderpriority AS title, o_orderdate AS published_at
        FROM {orders}""",
    "song_keys": "SELECT DISTINCT user_id AS song_id, user_id % 12 AS do_pc FROM {events}",
    "sourced_notes": "SELECT user_id AS song_id, event_id * 10 AS note_id, round((r - 1) * 5e-1 + floor((r - 1) / 8) + (event_id % 9 - 4) * 1e-3, 3) AS source_s FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS r FROM {events}) AS x WHERE event_id % 5 > 0",
    "chords": """
        SELECT CAST(floor(o_orderkey / 32) AS BIGINT) AS score_id, o_orderkey AS measure_id,
               concat(substr('C D E F G A B ', CAST(o_custkey % 7 AS INT) * 2 + 1, 1), CASE WHEN o_custkey % 5 = 1 THEN 'b' WHEN o_custkey % 5 = 2 THEN '#' ELSE '' END,
                      CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN '7' WHEN 3 THEN 'maj7' WHEN 4 THEN 'm7' WHEN 5 THEN 'dim' WHEN 6 THEN 'add9' WHEN 7 THEN '9' ELSE 'm11' END,
                      CASE WHEN o_custkey % 6 = 0 THEN '/G' WHEN o_custkey % 6 = 1 THEN '/F#' ELSE '' END) AS label
        FROM {orders}""",
    "scores": """
        SELECT score_id, CASE score_id % 12 WHEN 0 THEN 'C' WHEN 1 THEN 'Db' WHEN 2 THEN 'D' WHEN 3 THEN 'Eb' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'Gb' WHEN 7 THEN 'G' WHEN 8 THEN 'Ab' WHEN 9 THEN 'A' WHEN 10 THEN 'Bb' ELSE 'B' END AS score_key,
               60 + score_id % 90 AS bpm, 2 + score_id % 3 AS meter, score_id % 13 AS capo
        FROM (SELECT DISTINCT CAST(floor(o_orderkey / 32) AS BIGINT) AS score_id FROM {orders}) AS s""",
    "characters": """
        SELECT user_id AS song_id, event_id AS char_id, CAST(floor((r - 1) / 5) AS BIGINT) AS line_id, substr('天地人你我他好春夏秋冬山水火', CAST(event_id % 14 AS INT) + 1, 1) AS text,
               s AS start_s, round(s + 2e-1, 3) AS end_s, event_id % 6 = 0 AS manual
        FROM (SELECT user_id, event_id, r, round((r - 1) * 7e-1 + (event_id % 5) * 11e-2, 3) AS s
              FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS r FROM {events}) AS x) AS e""",
}
#: Edits of notes, and evidence before the notes: frames of a detector, emissions of syllables.
VIEWS |= {
    "suggestions": f"""
        SELECT score_id, note_id, CASE WHEN note_id % 5 = 0 THEN 'missing' ELSE 'difference' END AS kind, CASE note_id % 3 WHEN 0 THEN 'pitch' WHEN 1 THEN 'length' ELSE 'both' END AS wants,
               degree % 7 + 1 AS source_degree, octave AS source_octave, CAST(0 AS BIGINT) AS source_accidental, CAST(4 AS INT) AS source_base, 1 - dots AS source_dots, score_id % 4 > 0 AS same_key, note_id % 13 = 0 AS tuplet
        FROM ({VIEWS["notes"]}) AS s WHERE note_id % 6 < 4""",
    "lyric_edits": f"""
        SELECT score_id, note_id * 10 + k AS seq, note_id - note_id % 3 AS note_id, (note_id + k) % 6 AS verse, CASE WHEN (note_id + k) % 4 = 0 THEN ' ' WHEN note_id % 31 = 0 THEN repeat('la', 50) ELSE concat(' la', CAST(k AS VARCHAR(2))) END AS text
        FROM ({VIEWS["notes"]}) AS s CROSS JOIN (VALUES (0), (1)) AS d(k)""",
    "bar_marks": f"SELECT score_id, note_id AS mark_id, source_s + (note_id % 9 - 4) * 1e-1 AS at FROM ({VIEWS['notes']}) AS s WHERE n_idx = 1 AND source_s IS NOT NULL",
    "frames": """
        SELECT user_id AS song_id, r AS frame, CASE WHEN event_id % 29 > 0 THEN 55 + (block * 5) % 9 + (event_id % 5 - 2) * 1e-2
                    + CASE WHEN block % 3 = 1 THEN CASE WHEN k < 5 THEN -11e-1 WHEN k < 9 THEN (k - 9) * 22e-2 ELSE 0e0 END
                           WHEN block % 3 = 2 THEN CASE WHEN k < 5 THEN k * 28e-2 WHEN k < 9 THEN (9 - k) * 25e-2 ELSE 0e0 END WHEN k = 0 THEN -8e-1 ELSE 0e0 END END AS pitch,
               event_id % 31 > 0 AND r % 70 < 66 AS voiced, CASE WHEN event_id % 17 = 0 THEN 2e-1 ELSE 5e-1 + (event_id % 5) * 1e-1 END AS confidence,
               CASE WHEN k = 0 OR k = 6 AND block % 2 = 0 OR k = 15 AND block % 6 = 0 THEN 5e-2 ELSE 3e-1 + (event_id % 3) * 1e-2 END AS energy, k = 1 OR k = 7 AND block % 2 = 0 OR k = 16 AND block % 6 = 0 AS onset
        FROM (SELECT user_id, event_id, r, CAST(floor(r / 2e1) AS BIGINT) AS block, r % 20 AS k FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS r FROM {events}) AS x) AS e""",
    "emissions": "SELECT event_id AS frame, CAST(k AS BIGINT) AS token, CAST(floor(k / 2e0) AS BIGINT) AS sound, ln((1 + (event_id * (k + 3)) % 7) / 4e1) AS log_p FROM {events} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS d(k)",
}
TABLES = {"song_keys": "events", "sourced_notes": "events", "note_events": "events", "notes": "lineitem", "lines": "conversations", "library": "orders", "chords": "orders", "scores": "orders", "characters": "events", "suggestions": "lineitem", "lyric_edits": "lineitem", "bar_marks": "lineitem", "frames": "events", "emissions": "events"}


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> list[DataFrame]:
    """Canonical tables. Notes that three of them or more are made of are numbered and stored once, not dealt and sorted for each."""
    of_notes = [name for name in names if VIEWS["notes"] in VIEWS.get(name, "")]
    notes = kept(view(spark, sf_dir, "notes"), "notes") if len(of_notes) > 2 else None
    return [view(spark, sf_dir, name, notes if name in of_notes else None) for name in names]


def view(spark: SparkSession, sf_dir: str, name: str, notes: DataFrame | None = None) -> DataFrame:
    """A canonical table, or the driver's own where there is no view of that name; made of notes, if they are given."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if notes is not None:
        return notes if name == "notes" else spark.sql(VIEWS[name].replace(f"({VIEWS['notes']})", "{notes}"), notes=notes)
    source = TABLES[name]
    return spark.sql(VIEWS[name], **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def oracle_view(name: str) -> str:
    return VIEWS[name].replace("{" + TABLES[name] + "}", TABLES[name])
