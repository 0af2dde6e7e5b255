"""Joins by overlap, nearness and order, each with an equality on the song first so that it is never a cross join."""

from ..functions.scalars import MIDI, TICKS
from ..plans.sqlop import operator

#: Written notes with their tick positions in the measure.
PLACED = f"""p AS (SELECT *, round(sum({TICKS}) OVER (PARTITION BY measure_id ORDER BY n_idx) - {TICKS}, 6) AS tick_from, round(sum({TICKS}) OVER (PARTITION BY measure_id ORDER BY n_idx), 6) AS tick_to FROM {{notes}})"""
#: Half-measure windows.
HALVES = "(VALUES (0, 0, 32), (1, 32, 64)) AS w(half, a, b)"

overlap = operator("half_measure_overlap", "notes", f"""
WITH {PLACED}
SELECT p.measure_id, w.half, p.note_id, round((least(p.tick_to, w.b) - greatest(p.tick_from, w.a)) * CASE WHEN p.tick_from >= w.a THEN 15e-1 ELSE 1e0 END, 6) AS weight
FROM p JOIN {HALVES} ON p.tick_from < w.b AND p.tick_to > w.a WHERE p.degree > 0
""", "J3: overlap of notes with half-measure windows, onsets weighing more")
inside = operator("notes_in_window", "notes", f"""
WITH {PLACED}, r AS (SELECT p.measure_id, w.half, p.note_id, ({MIDI}) AS midi, row_number() OVER (PARTITION BY p.measure_id, w.half, {MIDI} ORDER BY p.n_idx DESC) AS last_first FROM p JOIN {HALVES} ON p.tick_from >= w.a AND p.tick_from < w.b WHERE p.degree > 0)
SELECT measure_id, half, note_id, CAST(midi AS BIGINT) AS midi FROM r WHERE last_first = 1
""", "J4: notes whose onset lies in a window, the last of each pitch")
nearest = operator("nearest_certain_event", "note_events", """
WITH q AS (SELECT song_id, event_id, start_s, CAST(floor(start_s / 12e-1) AS BIGINT) + i AS slot FROM {note_events} CROSS JOIN (VALUES (-1), (0), (1)) AS d(i) WHERE uncertain), c AS (SELECT song_id, event_id, start_s, CAST(floor(start_s / 12e-1) AS BIGINT) AS slot FROM {note_events} WHERE NOT uncertain),
m AS (SELECT q.song_id, q.event_id, c.event_id AS near_id, round(abs(c.start_s - q.start_s), 6) AS gap FROM q JOIN c ON c.song_id = q.song_id AND c.slot = q.slot AND c.start_s BETWEEN q.start_s - 12e-1 AND q.start_s + 12e-1),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id, event_id ORDER BY gap, near_id) AS rank FROM m)
SELECT song_id, event_id, near_id, gap FROM r WHERE rank = 1
""", "J6: nearest event within 1.2 s, by slots as long and their neighbours, the earliest on a tie")
as_of = operator("as_of_previous", "note_events", """
WITH s AS (SELECT *, sum(CASE WHEN uncertain THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS seen FROM {note_events}),
t AS (SELECT song_id, seen, event_id AS at_id, start_s AS at_s FROM s WHERE NOT uncertain)
SELECT s.song_id, s.event_id, t.at_id, round(s.start_s - t.at_s, 6) AS since FROM s LEFT JOIN t ON t.song_id = s.song_id AND t.seen = s.seen WHERE s.uncertain
""", "J9: the latest certain event at or before each uncertain one, by a running count instead of a search")
manual_over = operator("manual_over_automatic", "note_events", """
WITH e AS (SELECT *, CAST(floor(start_s / 2e0) AS BIGINT) AS first_slot, CAST(floor(end_s / 2e0) AS BIGINT) - CAST(floor(start_s / 2e0) AS BIGINT) + 1 AS slots FROM {note_events}),
h AS (SELECT song_id, event_id, start_s, end_s, first_slot + i AS slot FROM e [[each_below:slots|i]]),
o AS (SELECT DISTINCT a.song_id, a.event_id FROM h AS a JOIN h AS m ON m.song_id = a.song_id AND m.slot = a.slot AND m.start_s < a.end_s AND m.end_s > a.start_s WHERE m.event_id % 10 = 0 AND a.event_id % 10 <> 0)
SELECT song_id, event_id, 'manual' AS origin FROM e WHERE event_id % 10 = 0 UNION ALL
SELECT e.song_id, e.event_id, 'automatic' AS origin FROM e LEFT JOIN o ON o.song_id = e.song_id AND o.event_id = e.event_id WHERE e.event_id % 10 <> 0 AND o.event_id IS NULL
""", "J11, U1: automatic events stay where no manual one overlaps, by slots of 2 s")
mixed_stems = operator("mixed_stems", "note_events", """
WITH n AS (SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id, event_id % 2 ORDER BY start_s, event_id) AS BIGINT) AS i, event_id % 2 AS stem, pitch_center AS x FROM {note_events}),
a AS (SELECT * FROM n WHERE stem = 0), b AS (SELECT * FROM n WHERE stem = 1)
SELECT coalesce(a.song_id, b.song_id) AS song_id, coalesce(a.i, b.i) AS i, round(coalesce(a.x, 0e0) + coalesce(b.x, 0e0), 6) AS mixed FROM a FULL OUTER JOIN b ON a.song_id = b.song_id AND a.i = b.i
""", "J12: the shorter stem padded, sums by sample")
ngrams = operator("unique_ngram_matches", "notes", """
WITH s AS (SELECT score_id, score_id % 2 AS side, floor(score_id / 2) AS pair, CAST(row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS BIGINT) AS i, degree FROM {notes}),
g AS (SELECT pair, side, i, concat(CAST(degree AS VARCHAR(4)), '-', CAST(lead(degree, 1) OVER w AS VARCHAR(4)), '-', CAST(lead(degree, 2) OVER w AS VARCHAR(4)), '-', CAST(lead(degree, 3) OVER w AS VARCHAR(4))) AS gram, lead(degree, 3) OVER w AS whole FROM s WINDOW w AS (PARTITION BY score_id ORDER BY i)),
u AS (SELECT pair, side, gram, min(i) AS i FROM g WHERE whole IS NOT NULL GROUP BY pair, side, gram HAVING count(*) = 1)
SELECT CAST(a.pair AS BIGINT) AS pair, a.gram, a.i AS left_at, b.i AS right_at FROM u AS a JOIN u AS b ON a.pair = b.pair AND a.gram = b.gram AND a.side = 0 AND b.side = 1
""", "J13: 4-grams that stand once on each of two sides")
fragments = operator("fragment_shares", "notes", f"""
SELECT note_id, measure_id, round(sum({TICKS}) OVER w - {TICKS}, 6) AS before, round({TICKS} / sum({TICKS}) OVER (PARTITION BY measure_id), 6) AS share FROM {{notes}} WINDOW w AS (PARTITION BY measure_id ORDER BY n_idx)
""", "J14: real time dealt out by written ticks")
contexts = operator("repeated_neighbours", "note_events", """
WITH c AS (SELECT song_id, event_id, midi, lag(midi) OVER w AS before, lead(midi) OVER w AS after FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id))
SELECT song_id, before, midi, after, count(*) AS times FROM c WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY song_id, before, midi, after HAVING count(*) >= 2
""", "J15: a pitch between the same neighbours again")
recovery = operator("retained_recoveries", "note_events", """
WITH e AS (SELECT *, CAST(floor(start_s / 2e0) AS BIGINT) AS first_slot, CAST(floor(end_s / 2e0) AS BIGINT) - CAST(floor(start_s / 2e0) AS BIGINT) + 1 AS slots FROM {note_events}),
h AS (SELECT song_id, event_id, start_s, end_s, uncertain, first_slot + i AS slot FROM e [[each_below:slots|i]]),
x AS (SELECT u.song_id, u.event_id, max((least(u.end_s, p.end_s) - greatest(u.start_s, p.start_s)) / (u.end_s - u.start_s)) AS covered FROM h AS u JOIN h AS p ON p.song_id = u.song_id AND p.slot = u.slot AND p.start_s < u.end_s AND p.end_s > u.start_s WHERE u.uncertain AND NOT p.uncertain GROUP BY u.song_id, u.event_id)
SELECT e.song_id, e.event_id, round(coalesce(x.covered, 0e0), 6) AS covered FROM e LEFT JOIN x ON x.song_id = e.song_id AND x.event_id = e.event_id WHERE e.uncertain AND coalesce(x.covered, 0e0) <= 5e-1
""", "J16: recovered events that no certain one covers by more than half, by slots of 2 s")
ties = operator("tie_targets", "notes", """
WITH n AS (SELECT note_id, lag(tie) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS held FROM {notes})
SELECT note_id FROM n WHERE NOT coalesce(held, FALSE)
""", "J2: notes that no tie leads to")
