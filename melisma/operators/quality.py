"""Validation, repair, sets, edits and versioned snapshots."""

from ..functions.scalars import MIDI, TICKS
from ..plans.sqlop import operator

violations = operator("score_violations", "notes", f"""
SELECT note_id AS object_id, 'degree' AS rule FROM {{notes}} WHERE degree NOT BETWEEN 0 AND 7 UNION ALL
SELECT note_id, 'octave' FROM {{notes}} WHERE octave NOT BETWEEN -2 AND 2 UNION ALL
SELECT note_id, 'rest-accidental' FROM {{notes}} WHERE degree = 0 AND (accidental <> 0 OR octave <> 0) UNION ALL
SELECT measure_id, 'capacity' FROM {{notes}} GROUP BY measure_id HAVING sum({TICKS}) > 64 + 1e-7 UNION ALL
SELECT note_id, 'duplicate-id' FROM {{notes}} GROUP BY note_id HAVING count(*) > 1 UNION ALL
SELECT measure_id, 'note-count' FROM {{notes}} GROUP BY measure_id HAVING count(*) > 64
""", "DQ1: one table of violations, a rule a branch")
beat_audit = operator("beat_audit", "notes", f"""
SELECT measure_id, round(sum({TICKS}) / 16, 6) AS beats, abs(sum({TICKS}) / 16 - 4) > 1e-2 AS warn FROM {{notes}} GROUP BY measure_id
""", "DQ6, DQ7")
triplets = operator("triplet_groups", "notes", """
WITH t AS (SELECT measure_id, CAST(floor((n_idx - 1) / 3) AS BIGINT) AS grp, n_idx, base FROM {notes} WHERE dots = 0)
SELECT measure_id, grp, count(*) AS n, count(*) = 3 AND max(n_idx) - min(n_idx) = 2 AND count(DISTINCT base) = 1 AS valid FROM t GROUP BY measure_id, grp
""", "DQ2")
lyric_checks = operator("lyric_checks", "notes lines", """
WITH l AS (SELECT conv_id * 100 + turn AS note_id, conv_id, turn, length(text) AS n FROM {lines})
SELECT l.conv_id, l.turn, CASE WHEN n.note_id IS NULL THEN 'no note' WHEN n.degree = 0 THEN 'rest' WHEN l.turn > 3 THEN 'verse' WHEN l.n > 80 THEN 'length' ELSE 'valid' END AS reason FROM l LEFT JOIN {notes} AS n ON n.note_id = l.note_id
""", "DQ3, J1: the first reason for which a lyric doesn't stand")
quarantine = operator("quarantined_notes", "notes", "SELECT note_id, CASE WHEN base IN (1, 2, 4, 8) THEN base END AS base, CASE WHEN base NOT IN (1, 2, 4, 8) THEN 'base' WHEN octave NOT BETWEEN -1 AND 1 THEN 'octave' END AS pending FROM {notes}", "DQ5: value and reason of each field put aside")
gates = operator("frame_gates", "note_events", """
SELECT event_id, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 65e-2 THEN 'pass' ELSE 'fail' END AS gate,
       CASE WHEN uncertain THEN 'uncertain' WHEN confidence < 55e-2 THEN 'weak' WHEN end_s - start_s < 2e-1 THEN 'short' WHEN abs(pitch_center - midi) > 25e-2 THEN 'off-pitch' ELSE 'eligible' END AS decision FROM {note_events}
""", "DQ9, SC16: the first gate that fails names the reason")
issues = operator("issue_list", "note_events", """
WITH i AS (SELECT song_id, event_id, start_s, 3 AS severity, 'uncertain' AS issue FROM {note_events} WHERE uncertain UNION ALL SELECT song_id, event_id, start_s, 2, 'weak' FROM {note_events} WHERE confidence < 65e-2 UNION ALL
SELECT song_id, event_id, start_s, 1, 'short' FROM {note_events} WHERE end_s - start_s < 15e-2 UNION ALL SELECT song_id, event_id, start_s, 1, 'off-pitch' FROM {note_events} WHERE abs(pitch_center - midi) > 25e-2)
SELECT song_id, event_id, severity, issue, CAST(row_number() OVER (PARTITION BY song_id ORDER BY severity DESC, start_s, event_id, issue) AS BIGINT) AS place FROM i
""", "DQ10")
patched = operator("patched_measures", "notes", """
WITH patch AS (SELECT measure_id, note_id, degree % 7 + 1 AS degree FROM {notes} WHERE measure_id % 10 = 0 AND degree > 0)
SELECT measure_id, note_id, degree FROM patch UNION ALL SELECT n.measure_id, n.note_id, n.degree FROM {notes} AS n WHERE NOT EXISTS (SELECT 1 FROM patch AS p WHERE p.measure_id = n.measure_id)
""", "DQ13: measures of the patch replace those of the score")
latest = operator("latest_published", "library", "SELECT project_id, revision, score_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY revision DESC) AS r FROM {library}) AS l WHERE r = 1", "IO4, X30: latest wins for each key")
history = operator("history_of_ten", "library", "SELECT project_id, revision FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY revision DESC) AS r FROM {library}) AS l WHERE r <= 10", "K4")
conflict = operator("revision_conflicts", "library", """
WITH e AS (SELECT project_id, revision, score_id % 5 AS expected_back FROM {library})
SELECT e.project_id, e.revision, m.latest, m.latest - e.expected_back <> e.revision AS conflict FROM e JOIN (SELECT project_id, max(revision) AS latest FROM {library} GROUP BY project_id) AS m ON m.project_id = e.project_id
""", "DQ14: a change is refused when the revision has moved on")
catalog = operator("score_catalog", "notes", "SELECT score_id, count(DISTINCT measure_id) AS measures, count(*) AS notes, count(CASE WHEN degree > 0 THEN 1 END) >= 1 AS publishable FROM {notes} GROUP BY score_id", "IO7, IO8")
offsets = operator("audio_offsets", "library", "SELECT project_id, revision, coalesce(nullif(CASE WHEN status = 'O' THEN audio_offset END, 0e0), CASE WHEN status = 'F' THEN audio_offset / 2 END, 0e0) AS audio_offset FROM {library}", "IO5, IO8: the first offset that is known")
properties = operator("event_properties", "events", "SELECT event_id, CAST([[json:props|'$.k']] AS BIGINT) AS k FROM {events}", "IO1, IO15: a field of a JSON document")
midi_deltas = operator("midi_deltas", "notes", f"""
WITH t AS (SELECT score_id, note_id, ({MIDI}) AS midi, sum({TICKS}) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS off_at, sum({TICKS}) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) - {TICKS} AS on_at FROM {{notes}}),
e AS (SELECT score_id, note_id, midi, on_at * 30 AS tick, 1 AS kind FROM t WHERE midi IS NOT NULL UNION ALL SELECT score_id, note_id, midi, off_at * 30, 0 FROM t WHERE midi IS NOT NULL)
SELECT score_id, note_id, CAST(midi AS BIGINT) AS midi, kind, CAST(round(tick - coalesce(lag(tick) OVER (PARTITION BY score_id ORDER BY tick, kind, note_id), 0e0), 0) AS BIGINT) AS delta FROM e
""", "IO14: note on and off events with delta times at 480 ticks a quarter")
token_rows = operator("compact_rows", "notes", "SELECT note_id, concat(CAST(degree AS VARCHAR(4)), '/', CAST(base AS VARCHAR(4)), '/', CAST(octave AS VARCHAR(4)), '/', CAST(dots AS VARCHAR(4))) AS token FROM {notes}", "IO20")
chosen = operator("closest_reading", "notes", f"""
WITH a AS (SELECT measure_id, n_idx % 2 AS reading, abs(sum({TICKS}) - 32) AS off FROM {{notes}} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY measure_id ORDER BY round(off, 6), reading) AS rank FROM a)
SELECT measure_id, reading, round(off, 6) AS off FROM r WHERE rank = 1
""", "U5: of two readings the one closer to the expected beats")
best_of = operator("best_of_slot", "note_events", """
WITH s AS (SELECT song_id, event_id, CAST(floor(start_s / 1e0) AS BIGINT) AS slot, CASE WHEN uncertain THEN 0 ELSE 1 END AS priority, round((end_s - start_s) * confidence, 6) AS weight FROM {note_events}), r AS (SELECT *, row_number() OVER (PARTITION BY song_id, slot ORDER BY priority DESC, weight DESC, event_id) AS rank FROM s)
SELECT song_id, slot, event_id, priority, weight FROM r WHERE rank = 1
""", "K6")
renumbered = operator("deleted_and_renumbered", "notes", "SELECT measure_id, note_id, CAST(row_number() OVER (PARTITION BY measure_id ORDER BY n_idx) AS BIGINT) AS n_idx FROM {notes} WHERE note_id % 7 <> 0", "ED1, ED2")
relabelled = operator("relabelled_notes", "notes", f"""
WITH m AS (SELECT note_id, ({MIDI}) - 62 AS distance FROM {{notes}} WHERE degree > 0)
SELECT note_id, CAST(floor(distance / 12e0) AS BIGINT) AS octave, CAST(((distance % 12) + 12) % 12 AS BIGINT) AS pc FROM m
""", "ED5: the same sounding pitch under another Do")
barlines = operator("moved_barlines", "notes", f"""
WITH p AS (SELECT score_id, note_id, sum({TICKS}) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) - {TICKS} AS placed FROM {{notes}})
SELECT score_id, note_id, CAST(floor(round(placed, 6) / 48) AS BIGINT) AS new_measure FROM p
""", "ED3: notes fall to measures of another length by their running position")
edit_log = operator("edit_log", "note_events", """
WITH old AS (SELECT event_id, midi FROM {note_events} WHERE event_id % 11 <> 0), now AS (SELECT event_id, midi + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS midi FROM {note_events} WHERE event_id % 7 <> 0)
SELECT coalesce(o.event_id, n.event_id) AS event_id, CASE WHEN n.event_id IS NULL THEN 'deleted' WHEN o.event_id IS NULL THEN 'added' ELSE 'changed' END AS edit FROM old AS o FULL OUTER JOIN now AS n ON o.event_id = n.event_id WHERE n.event_id IS NULL OR o.event_id IS NULL OR o.midi <> n.midi
""", "X29, X36, X37: what an edit deleted, added and changed")
chord_windows = operator("chord_windows", "note_events", """
WITH m AS (SELECT song_id, CAST(floor(start_s / 2e0) AS BIGINT) AS measure, min(start_s) AS a, max(end_s) AS b FROM {note_events} GROUP BY 1, 2)
SELECT m.song_id, m.measure, h.half, round(m.a + (m.b - m.a) * 5e-1 * h.half, 3) AS window_from, round(m.a + (m.b - m.a) * 5e-1 * (h.half + 1), 3) AS window_to FROM m CROSS JOIN (VALUES (0), (1)) AS h(half) WHERE m.b > m.a
""", "X4")
#: Spellable lengths in sixteenths, longest first.
LONGEST = "CASE WHEN {x} >= 16 THEN 16 WHEN {x} >= 12 THEN 12 WHEN {x} >= 8 THEN 8 WHEN {x} >= 6 THEN 6 WHEN {x} >= 4 THEN 4 WHEN {x} >= 3 THEN 3 WHEN {x} >= 2 THEN 2 ELSE {x} END"
decomposed = operator("duration_parts", "note_events", f"""
WITH u AS (SELECT song_id, event_id, CAST(floor(start_s / 125e-3 + 5e-1) AS BIGINT) AS placed, CAST(greatest(1, floor((end_s - start_s) * 4 / 125e-3 + 5e-1)) AS BIGINT) AS units FROM {{note_events}}),
b AS (SELECT *, least(units, 16 - placed % 16) AS head FROM u), k AS (SELECT *, ceil((units - head) / 16e0) + 1 AS bars FROM b),
s AS (SELECT song_id, event_id, CAST(i AS BIGINT) AS bar, CAST(CASE WHEN i = 0 THEN head ELSE least(16, units - head - 16 * (i - 1)) END AS BIGINT) AS len FROM k [[each_below:bars|i]]),
p AS (SELECT song_id, event_id, bar, 0 AS part, CAST({LONGEST.replace("{x}", "len")} AS BIGINT) AS amount, len FROM s),
q AS (SELECT song_id, event_id, bar, part, amount FROM p UNION ALL SELECT song_id, event_id, bar, 1, len - amount FROM p WHERE len > amount)
SELECT song_id, event_id, bar, part, amount FROM q
""", "X33: a length in sixteenths split at bars, each part by the longest spellable value first; what it leaves of a bar is spellable")
provenance = operator("provenance_links", "note_events sourced_notes", """
WITH n AS (SELECT song_id, note_id, source_s, CAST(floor(source_s / 1e-2) AS BIGINT) + d.i AS slot FROM {sourced_notes} CROSS JOIN (VALUES (-1), (0), (1)) AS d(i))
SELECT e.song_id, e.event_id, n.note_id FROM {note_events} AS e JOIN n ON n.song_id = e.song_id AND n.slot = CAST(floor(e.start_s / 1e-2) AS BIGINT) AND round(abs(n.source_s - e.start_s), 6) < 3e-3
""", "X39: the score's notes whose recorded time is less than 3 ms from a detected start, by slots of 10 ms and their neighbours")
