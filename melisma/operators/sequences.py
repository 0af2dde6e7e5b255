"""Runs, phrases, running positions and other operators over ordered rows."""

from ..functions.scalars import MIDI, TICKS
from ..plans.sqlop import operator

W = "WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id)"

runs = operator("equal_runs", "note_events", f"""
WITH c AS (SELECT song_id, event_id, start_s, end_s, midi, CASE WHEN lag(midi) OVER w = midi THEN 0 ELSE 1 END AS fresh FROM {{note_events}} {W}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS run FROM c)
SELECT song_id, CAST(run AS BIGINT) AS run, min(midi) AS midi, count(*) AS n, round(max(end_s) - min(start_s), 6) AS span FROM g GROUP BY song_id, run
""", "W1: maximal runs of equal pitch")
phrases = operator("phrase_ends", "note_events", """
WITH s AS (SELECT song_id, event_id, end_s, confidence, uncertain, pitch_center, start_s, max(coalesce(performance_end, end_s)) OVER (PARTITION BY song_id ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sounding, lead(start_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS next_s FROM {note_events})
SELECT song_id, event_id, CAST(floor(pitch_center + 5e-1) AS BIGINT) AS midi, round(least(15e-1, end_s - start_s) * least(1e0, confidence), 6) AS weight
FROM s WHERE next_s - sounding >= 5e-1 AND NOT uncertain AND end_s - start_s >= 12e-2 AND abs(pitch_center - floor(pitch_center + 5e-1)) <= 35e-2
""", "W2: ends before a silence after all that sounded so far")
phrase_histogram = operator("phrase_histogram", "note_events", phrases.text.replace("SELECT song_id, event_id, CAST(floor(pitch_center + 5e-1) AS BIGINT) AS midi, round(least", "SELECT song_id, CAST(floor(pitch_center + 5e-1) AS BIGINT) % 12 AS pc, count(*) AS n, round(sum(least", 1).replace("least(1e0, confidence), 6) AS weight", "least(1e0, confidence)), 6) AS weight", 1).rstrip() + "\nGROUP BY 1, 2\n", "AG26")
terminal = operator("terminal_evidence", "note_events", """
WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY end_s DESC, event_id DESC) AS BIGINT) - 1 AS skipped FROM {note_events} WHERE NOT uncertain),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY skipped) AS rank FROM o WHERE end_s - start_s >= 25e-2 AND confidence >= 5e-1 AND abs(pitch_center - floor(pitch_center + 5e-1)) <= 35e-2)
SELECT song_id, event_id, CAST(floor(pitch_center + 5e-1) AS BIGINT) AS midi, skipped FROM r WHERE rank = 1
""", "W3: the last sustained reliable event, short tails skipped")
positions = operator("note_positions", "notes", f"""
SELECT score_id, note_id, round(sum({TICKS}) OVER (PARTITION BY measure_id ORDER BY n_idx) - {TICKS}, 6) AS in_measure, round(sum({TICKS}) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) - {TICKS}, 6) AS in_score FROM {{notes}}
""", "W4")
tied = operator("tied_events", "notes", f"""
WITH c AS (SELECT *, ({MIDI}) AS midi, CASE WHEN degree > 0 AND lag(tie) OVER w AND lag({MIDI}) OVER w = ({MIDI}) THEN 0 ELSE 1 END AS fresh FROM {{notes}} WINDOW w AS (PARTITION BY score_id ORDER BY m_idx, n_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS run FROM c)
SELECT score_id, min(note_id) AS first_note, CAST(min(midi) AS BIGINT) AS midi, count(*) AS notes, round(sum({TICKS}), 6) AS ticks FROM g WHERE degree > 0 GROUP BY score_id, run
""", "W5: notes of one pitch that ties join become one event; repeated notes without a tie stay")
chord_merge = operator("merged_labels", "notes", f"""
WITH m AS (SELECT score_id, m_idx, measure_id, min(degree) AS label, sum({TICKS}) AS ticks, avg(CAST(dots AS DOUBLE)) AS support FROM {{notes}} GROUP BY score_id, m_idx, measure_id),
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY score_id ORDER BY m_idx) = label THEN 0 ELSE 1 END AS fresh FROM m), g AS (SELECT *, sum(fresh) OVER (PARTITION BY score_id ORDER BY m_idx) AS run FROM c)
SELECT score_id, min(m_idx) AS from_measure, max(m_idx) AS to_measure, min(label) AS label, round(sum(ticks * support) / sum(ticks), 6) AS support FROM g GROUP BY score_id, run
""", "W6: equal neighbours merge, support weighted by ticks")
beat_positions = operator("beat_positions", "note_events", """
WITH d AS (SELECT song_id, event_id, start_s, start_s - lag(start_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS gap FROM {note_events}), p AS (SELECT song_id, median(gap) AS period FROM d GROUP BY song_id)
SELECT d.song_id, d.event_id, CAST(sum(CASE WHEN d.gap IS NULL THEN 0 ELSE greatest(1, floor(d.gap / p.period + 5e-1)) END) OVER (PARTITION BY d.song_id ORDER BY d.start_s, d.event_id) AS BIGINT) AS position FROM d JOIN p ON p.song_id = d.song_id
""", "W9: missed beats are counted in")
interpolated = operator("interpolated_times", "note_events", """
WITH k AS (SELECT song_id, event_id, row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS i, CASE WHEN uncertain THEN NULL ELSE start_s - min(start_s) OVER (PARTITION BY song_id) END AS t FROM {note_events}),
g AS (SELECT *, count(t) OVER (PARTITION BY song_id ORDER BY i) AS before, count(t) OVER (PARTITION BY song_id ORDER BY i DESC) AS after FROM k),
a AS (SELECT song_id, before, i AS i0, t AS t0 FROM g WHERE t IS NOT NULL), b AS (SELECT song_id, after, i AS i1, t AS t1 FROM g WHERE t IS NOT NULL)
SELECT g.song_id, g.event_id, round(a.t0 + (b.t1 - a.t0) * (g.i - a.i0) / (b.i1 - a.i0), 4) AS t FROM g JOIN a ON a.song_id = g.song_id AND a.before = g.before JOIN b ON b.song_id = g.song_id AND b.after = g.after WHERE g.t IS NULL
""", "W10: unknown times between known anchors")
page_merge = operator("page_offsets", "notes", """
WITH p AS (SELECT score_id, CAST(floor(m_idx / 8) AS BIGINT) AS page, count(DISTINCT measure_id) AS measures FROM {notes} GROUP BY 1, 2)
SELECT score_id, page, measures, CAST(coalesce(sum(measures) OVER (PARTITION BY score_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_measure FROM p
""", "W17")
tempo_steps = operator("tempo_steps", "note_events", """
SELECT song_id, event_id, round(60e0 / nullif(lead(start_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) - start_s, 0e0), 6) AS bpm FROM {note_events}
""", "W23")
outward = operator("outward_estimates", "note_events", """
WITH s AS (SELECT song_id, event_id, row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS i, start_s - min(start_s) OVER (PARTITION BY song_id) AS t, uncertain FROM {note_events}),
f AS (SELECT song_id, min(i) AS i0, max(i) AS i1 FROM s WHERE NOT uncertain GROUP BY song_id), a AS (SELECT s.song_id, s.i, s.t FROM s JOIN f ON f.song_id = s.song_id AND (s.i = f.i0 OR s.i = f.i1)),
r AS (SELECT f.song_id, f.i0, f.i1, min(a.t) AS t0, max(a.t) AS t1 FROM f JOIN a ON a.song_id = f.song_id GROUP BY f.song_id, f.i0, f.i1)
SELECT s.song_id, s.event_id, round(CASE WHEN s.i < r.i0 THEN r.t0 - (r.i0 - s.i) * (r.t1 - r.t0) / (r.i1 - r.i0) ELSE r.t1 + (s.i - r.i1) * (r.t1 - r.t0) / (r.i1 - r.i0) END, 4) AS t
FROM s JOIN r ON r.song_id = s.song_id WHERE (s.i < r.i0 OR s.i > r.i1) AND r.i1 > r.i0
""", "W8: times before the first and after the last anchor")
rest_fill = operator("bridged_rests", "note_events", """
WITH n AS (SELECT song_id, event_id, midi, end_s, lead(start_s) OVER w AS next_s, lead(midi) OVER w AS next_midi FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id))
SELECT song_id, event_id, round(CASE WHEN next_s > end_s AND next_s - end_s <= 3e-1 THEN next_s ELSE end_s END - end_s, 6) AS added FROM n
""", "DQ15, X34: short rests are sustained to the next onset")
slides = operator("slide_moves", "note_events", """
WITH m AS (SELECT song_id, event_id, midi - (lag(midi) OVER w) AS step, (lead(midi) OVER w) - midi AS next_step FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id))
SELECT song_id, event_id, step, next_step FROM m WHERE abs(step) <= 4 AND abs(next_step) <= 4 AND step * next_step > 0
""", "W14: bounded steps that go on in one direction")
peaks = operator("local_peaks", "note_events", """
WITH m AS (SELECT song_id, event_id, midi, lag(midi) OVER w AS before, lead(midi) OVER w AS after FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id))
SELECT song_id, event_id, midi FROM m WHERE midi > before AND midi > after
""", "W16")
char_times = operator("character_times", "lines", """
WITH c AS (SELECT conv_id, turn, length(text) AS n FROM {lines} WHERE text IS NOT NULL AND length(text) > 0)
SELECT conv_id, turn, CAST(i AS BIGINT) AS char_index, round(turn + CAST(i AS DOUBLE) / n, 6) AS start_s FROM c [[each_below:n|i]]
""", "W20: equal parts of a word's time")
silence_groups = operator("silence_groups", "note_events", """
WITH c AS (SELECT song_id, event_id, start_s, confidence, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) <= 2e0 THEN 0 ELSE 1 END AS fresh FROM {note_events}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS grp FROM c)
SELECT song_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, round(avg(confidence), 4) AS probability FROM g GROUP BY song_id, grp HAVING count(*) >= 3 AND avg(confidence) >= 35e-2
""", "X15: groups parted by silence, with enough members and probability")
windows = operator("owned_windows", "note_events", """
WITH d AS (SELECT song_id, max(end_s) AS duration FROM {note_events} GROUP BY song_id),
w AS (SELECT song_id, duration, i AS window_index FROM (SELECT song_id, duration, ceil(duration / 3e1) AS n FROM d) AS x [[each_below:n|i]]),
o AS (SELECT song_id, CAST(floor((start_s + end_s) / 2 / 3e1) AS BIGINT) AS owner, count(*) AS owned FROM {note_events} GROUP BY 1, 2)
SELECT w.song_id, CAST(w.window_index AS BIGINT) AS window_index, w.window_index * 3e1 AS start_s, least(w.duration, w.window_index * 3e1 + 3e1) AS end_s,
       greatest(0e0, w.window_index * 3e1 - 15e-1) AS decode_from, least(w.duration, w.window_index * 3e1 + 315e-1) AS decode_to, coalesce(o.owned, 0) AS owned
FROM w LEFT JOIN o ON o.song_id = w.song_id AND o.owner = w.window_index
""", "ST1: windows of 30 s that are decoded 1.5 s beyond either side; each event belongs to the one that holds its middle")
