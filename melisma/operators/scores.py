"""Composites over scores, chords and lyrics: timelines, remapping, edits, evidence shares."""

from ..functions.scalars import MIDI, TICKS
from ..plans.sqlop import operator
from .joins import PLACED

chord_remap = operator("remapped_chords", "note_events", """
WITH c AS (SELECT song_id, CAST(floor(start_s / 2e0) AS BIGINT) AS bar, min(midi) % 12 AS label FROM {note_events} GROUP BY 1, 2),
w AS (SELECT DISTINCT song_id, CAST(floor(start_s / 3e0) AS BIGINT) AS bar FROM {note_events}),
s AS (SELECT w.song_id, w.bar, h.half, (w.bar + (h.half + 5e-1) / 2) * 3e0 AS middle FROM w CROSS JOIN (VALUES (0), (1)) AS h(half))
SELECT s.song_id, s.bar, s.half, c.label FROM s JOIN c ON c.song_id = s.song_id AND c.bar = CAST(floor(s.middle / 2e0) AS BIGINT)
""", "J5: labels go to the bars of another tempo by each half's middle")
containing = operator("containing_or_nearest_segment", "note_events", """
WITH s AS (SELECT song_id, event_id AS segment, start_s AS a, end_s AS b, CAST(floor(start_s / 2e0) AS BIGINT) AS first_slot, CAST(floor(end_s / 2e0) AS BIGINT) - CAST(floor(start_s / 2e0) AS BIGINT) + 1 AS slots FROM {note_events} WHERE NOT uncertain),
q AS (SELECT song_id, event_id, start_s AS t FROM {note_events} WHERE uncertain),
h AS (SELECT song_id, segment, a, b, first_slot + i AS slot FROM s [[each_below:slots|i]]),
c AS (SELECT q.song_id, q.event_id, min(h.segment) AS segment FROM q JOIN h ON h.song_id = q.song_id AND h.slot = CAST(floor(q.t / 2e0) AS BIGINT) AND q.t >= h.a AND q.t < h.b GROUP BY q.song_id, q.event_id),
u AS (SELECT song_id, b AS moment, 0 AS kind, NULL AS event_id FROM s UNION ALL SELECT song_id, a, 2, NULL FROM s UNION ALL SELECT song_id, t, 1, event_id FROM q),
w AS (SELECT song_id, event_id, kind, moment, max(CASE WHEN kind = 0 THEN moment END) OVER (PARTITION BY song_id ORDER BY moment, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended, min(CASE WHEN kind = 2 THEN moment END) OVER (PARTITION BY song_id ORDER BY moment, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS begun FROM u),
e AS (SELECT song_id, b, min(segment) AS segment FROM s GROUP BY song_id, b), f AS (SELECT song_id, a, min(segment) AS segment FROM s GROUP BY song_id, a),
n AS (SELECT w.song_id, w.event_id, e.segment AS left_segment, f.segment AS right_segment, round(w.moment - w.ended, 6) AS left_gap, round(w.begun - w.moment, 6) AS right_gap FROM w LEFT JOIN e ON e.song_id = w.song_id AND e.b = w.ended LEFT JOIN f ON f.song_id = w.song_id AND f.a = w.begun WHERE w.kind = 1)
SELECT n.song_id, n.event_id, CASE WHEN c.segment IS NOT NULL THEN c.segment WHEN right_gap IS NULL OR left_gap < right_gap OR left_gap = right_gap AND left_segment < right_segment THEN left_segment ELSE right_segment END AS segment,
       CASE WHEN c.segment IS NOT NULL THEN 0e0 WHEN right_gap IS NULL OR left_gap <= right_gap THEN left_gap ELSE right_gap END AS gap
FROM n LEFT JOIN c ON c.song_id = n.song_id AND c.event_id = n.event_id WHERE c.segment IS NOT NULL OR left_gap IS NOT NULL OR right_gap IS NOT NULL
""", "J8: the segment that holds a time, by slots of 2 s, else the nearest, however far, by the last end before and the first start after")
chroma_mix = operator("combined_chroma", "note_events", """
WITH h AS (SELECT song_id, midi % 12 AS pc, event_id % 3 AS stem, sum(end_s - start_s) AS weight FROM {note_events} GROUP BY 1, 2, 3),
n AS (SELECT song_id, pc, stem, weight / sum(weight) OVER (PARTITION BY song_id, stem) AS share FROM h), s AS (SELECT song_id, sum(v) AS total FROM (SELECT DISTINCT song_id, stem, CASE stem WHEN 0 THEN 65e-2 WHEN 1 THEN 2e-1 ELSE 15e-2 END AS v FROM h) AS x GROUP BY song_id)
SELECT n.song_id, n.pc, round(sum(n.share * CASE n.stem WHEN 0 THEN 65e-2 WHEN 1 THEN 2e-1 ELSE 15e-2 END) / max(s.total), 6) AS weight FROM n JOIN s ON s.song_id = n.song_id GROUP BY n.song_id, n.pc
""", "AG9: sources weigh .65, .2 and .15, over those that are there")
agreement = operator("window_agreement", "note_events", """
WITH w AS (SELECT song_id, CAST(floor(start_s / 12e0) AS BIGINT) AS win, midi % 12 AS pc, sum(confidence) AS weight FROM {note_events} GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY song_id, win ORDER BY round(weight, 6) DESC, pc) AS rank FROM w), t AS (SELECT song_id, pc, sum(weight) AS weight FROM w GROUP BY song_id, pc),
g AS (SELECT song_id, pc, row_number() OVER (PARTITION BY song_id ORDER BY round(weight, 6) DESC, pc) AS rank FROM t)
SELECT b.song_id, count(*) AS windows, round(avg(CASE WHEN b.pc = g.pc THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM b JOIN g ON g.song_id = b.song_id AND g.rank = 1 WHERE b.rank = 1 GROUP BY b.song_id
""", "AG10: share of windows whose winner is the song's")
index_quantiles = operator("index_quantiles", "note_events", """
WITH r AS (SELECT song_id, pitch_center - midi AS off, row_number() OVER (PARTITION BY song_id ORDER BY pitch_center - midi, event_id) - 1 AS i, count(*) OVER (PARTITION BY song_id) AS n FROM {note_events} WHERE NOT uncertain)
SELECT song_id, round(max(CASE WHEN i = CAST(floor((n - 1) * 1e-1) AS BIGINT) THEN off END), 6) + 0e0 AS low, round(max(CASE WHEN i = CAST(ceil((n - 1) * 9e-1) AS BIGINT) THEN off END), 6) + 0e0 AS high FROM r GROUP BY song_id
""", "AG12: percentiles by index, not interpolated")
grid_fit = operator("trimmed_grid_fit", "note_events", """
WITH b AS (SELECT song_id, event_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS DOUBLE) AS i, (start_s - min(start_s) OVER (PARTITION BY song_id)) AS t FROM {note_events}),
f AS (SELECT song_id, regr_slope(t, i) AS k, regr_intercept(t, i) AS c FROM b GROUP BY song_id), e AS (SELECT b.*, abs(b.t - f.k * b.i - f.c) AS err FROM b JOIN f ON f.song_id = b.song_id),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(err, 9), event_id) AS rank, count(*) OVER (PARTITION BY song_id) AS n FROM e)
SELECT song_id, count(*) AS kept, round(regr_slope(t, i), 5) AS period FROM r WHERE rank <= 65e-2 * n GROUP BY song_id HAVING count(*) >= 2
""", "AG19: a regression again over the 65 % that fit it best")
energy_bins = operator("timing_energy", "note_events", """
WITH d AS (SELECT song_id, min(start_s) AS a, max(end_s) AS b FROM {note_events} GROUP BY song_id), s AS (SELECT e.song_id, CAST(least(31, floor((e.start_s - d.a) / (d.b - d.a) * 32)) AS BIGINT) AS slot, sum(e.confidence) AS energy FROM {note_events} AS e JOIN d ON d.song_id = e.song_id GROUP BY 1, 2)
SELECT song_id, slot, round(energy / sum(energy) OVER (PARTITION BY song_id) + 1e-9, 5) AS weight FROM s
""", "AG24: energy in 32 bins that sum to one")
energy_after = operator("energy_after_boundary", "note_events", """
WITH d AS (SELECT song_id, (min(start_s) + max(end_s)) / 2 AS boundary FROM {note_events} GROUP BY song_id)
SELECT e.song_id, round(sum(greatest(0e0, e.end_s - greatest(e.start_s, d.boundary)) * e.confidence) / sum((e.end_s - e.start_s) * e.confidence), 6) AS share FROM {note_events} AS e JOIN d ON d.song_id = e.song_id GROUP BY e.song_id
""", "AG25")
rest_shares = operator("written_rest_shares", "notes", f"""
WITH g AS (SELECT *, count(CASE WHEN degree > 0 THEN 1 END) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS after FROM {{notes}}), t AS (SELECT score_id, after, sum({TICKS}) AS ticks FROM g WHERE degree = 0 GROUP BY score_id, after)
SELECT g.score_id, g.note_id, round({TICKS} / t.ticks, 6) AS share FROM g JOIN t ON t.score_id = g.score_id AND t.after = g.after WHERE g.degree = 0
""", "W7: a gap is dealt out over the rests written in it")
corrections = operator("weak_pitch_corrections", "note_events", """
WITH c AS (SELECT song_id, event_id, midi, confidence, lag(midi) OVER w AS before, lead(midi) OVER w AS after FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id)), s AS (SELECT song_id, midi, count(*) AS stable FROM {note_events} WHERE confidence >= 8e-1 GROUP BY song_id, midi)
SELECT c.song_id, c.event_id, c.midi, c.before AS corrected FROM c LEFT JOIN s ON s.song_id = c.song_id AND s.midi = c.midi WHERE c.before = c.after AND abs(c.midi - c.before) = 1 AND c.confidence < 7e-1 AND coalesce(s.stable, 0) < 2
""", "W15: a weak step between equal neighbours, unless the pitch is stable elsewhere")
merged_sources = operator("merged_with_overlaps", "note_events", """
WITH u AS (SELECT song_id, event_id, start_s, end_s, 'intro' AS part FROM {note_events} WHERE uncertain UNION ALL SELECT song_id, event_id, start_s, end_s, 'vocal' FROM {note_events} WHERE NOT uncertain),
o AS (SELECT *, lag(end_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS before FROM u)
SELECT song_id, event_id, part, coalesce(before - start_s > 5e-2, FALSE) AS rejected FROM o
""", "U2: a union in order, overlaps over .05 s marked")
missing_measures = operator("filled_measures", "notes", """
WITH s AS (SELECT score_id, max(m_idx) AS last_m FROM {notes} GROUP BY score_id), a AS (SELECT score_id, i AS m_idx FROM s [[each_below:last_m + 1|i]]), h AS (SELECT DISTINCT score_id, m_idx FROM {notes})
SELECT a.score_id, CAST(a.m_idx AS BIGINT) AS m_idx FROM a LEFT JOIN h ON h.score_id = a.score_id AND h.m_idx = a.m_idx WHERE h.m_idx IS NULL
""", "U3, X26: measures that are missing between the first and the last")
lyric_slots = operator("sequential_lyrics", "notes", """
WITH n AS (SELECT score_id, note_id, row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) - 1 AS i, count(*) OVER (PARTITION BY score_id) AS m FROM {notes} WHERE degree > 0), c AS (SELECT score_id, m + m_n % 7 AS chars FROM (SELECT score_id, count(*) AS m, count(DISTINCT measure_id) AS m_n FROM {notes} WHERE degree > 0 GROUP BY score_id) AS x),
k AS (SELECT score_id, chars, i AS ch FROM c [[each_below:chars|i]])
SELECT n.score_id, n.note_id, count(*) AS characters FROM k JOIN n ON n.score_id = k.score_id AND n.i = CAST(floor(CAST(k.ch AS DOUBLE) * n.m / k.chars) AS BIGINT) GROUP BY n.score_id, n.note_id
""", "X9, ED4: characters dealt to notes in order, floor(i N / M)")
ties_detached = operator("detached_ties", "notes", """
WITH t AS (SELECT score_id, note_id AS tie_from, lead(note_id, 2) OVER w AS tie_to, note_id % 2 AS moved, lead(note_id) OVER w AS next_id FROM {notes} WINDOW w AS (PARTITION BY score_id ORDER BY m_idx, n_idx))
SELECT score_id, tie_from, tie_to FROM t WHERE moved = 1 AND tie_to <> next_id
""", "ED7: ties that lead past the note that follows by now")
restored = operator("restored_notes", "note_events", "SELECT event_id, coalesce(CASE WHEN confidence < 7e-1 THEN midi END, CAST(floor(pitch_center + 5e-1) AS BIGINT)) AS midi, confidence < 7e-1 AS restored FROM {note_events}", "ED6, ED9")
upsert = operator("published_upsert", "library", """
WITH new AS (SELECT project_id, max(revision) AS revision FROM {library} WHERE status = 'F' GROUP BY project_id), old AS (SELECT project_id, min(revision) AS revision FROM {library} GROUP BY project_id)
SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.revision, o.revision) AS revision, CASE WHEN n.project_id IS NULL THEN 'kept' WHEN n.revision = o.revision THEN 'same' ELSE 'replaced' END AS action FROM old AS o FULL OUTER JOIN new AS n ON n.project_id = o.project_id
""", "IO4, IO6: upsert by key")
manifest = operator("manifest_check", "library", """
WITH f AS (SELECT project_id, revision, score_id, status FROM {library}), m AS (SELECT project_id, revision, score_id + CASE WHEN score_id % 17 = 0 THEN 1 ELSE 0 END AS score_id FROM {library})
SELECT f.project_id, f.revision, CASE WHEN f.status = 'P' THEN 'interrupted' ELSE f.status END AS status FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project_id = f.project_id AND m.revision = f.revision AND m.score_id = f.score_id)
""", "IO12: files that the manifest doesn't list as they are")
key_map = operator("key_map_checks", "notes", f"""
WITH s AS (SELECT score_id, CAST(min({MIDI}) AS BIGINT) AS reference_do, CAST(count(*) % 12 AS BIGINT) AS do_pc, count(*) AS anchors FROM {{notes}} WHERE degree > 0 GROUP BY score_id)
SELECT score_id, CASE WHEN ((reference_do % 12) + 12) % 12 <> do_pc THEN 'reference' WHEN anchors > 64 THEN 'anchors' ELSE 'valid' END AS reason FROM s
""", "DQ4")
paths = operator("allowed_paths", "pages", "SELECT page_id, [[matches:url|'^https?://[a-z0-9.-]+(/[A-Za-z0-9._/-]*)?$']] AS allowed FROM {pages}", "DQ12")
credits = operator("repeated_lines", "lines", """
WITH l AS (SELECT [[find:lower(trim(text))|'^([a-z]+)'|1]] AS line, conv_id FROM {lines}) SELECT line, count(*) AS times, count(DISTINCT conv_id) AS conversations FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 2
""", "DQ11: opening words that stand twice or more")
recording = operator("recording_timeline", "notes", f"""
WITH {PLACED}, m AS (SELECT measure_id, max(tick_to) AS total FROM p GROUP BY measure_id)
SELECT p.measure_id, p.note_id, round(p.tick_from / m.total * 2, 6) AS start_s, round(p.tick_to / m.total * 2, 6) AS end_s FROM p JOIN m ON m.measure_id = p.measure_id
""", "X1-X3: a measure's two seconds dealt out by written ticks")
audition = operator("audition_clip", "note_events", """
WITH d AS (SELECT song_id, min(start_s) + 5e0 AS a, min(start_s) + 15e0 AS b FROM {note_events} GROUP BY song_id)
SELECT e.song_id, e.event_id, e.midi, round(greatest(e.start_s, d.a) - d.a, 4) AS start_s, round(least(e.end_s, d.b) - d.a, 4) AS end_s FROM {note_events} AS e JOIN d ON d.song_id = e.song_id WHERE e.end_s > d.a AND e.start_s < d.b
""", "X5, SC21, X41: clipped to a window and shifted to its start")
selected_run = operator("selected_revision", "library", """
WITH r AS (SELECT project_id, revision, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN status = 'F' THEN 0 WHEN status = 'O' THEN 1 ELSE 2 END, revision DESC) AS rank FROM {library}) SELECT project_id, revision FROM r WHERE rank = 1
""", "X28: by priority, then the latest")
line_timing = operator("accepted_lines", "note_events", """
WITH l AS (SELECT song_id, CAST(floor(start_s / 8e0) AS BIGINT) AS line, event_id, start_s, confidence >= 8e-1 AS acoustic, lag(confidence >= 8e-1) OVER (PARTITION BY song_id, CAST(floor(start_s / 8e0) AS BIGINT) ORDER BY start_s, event_id) AS before FROM {note_events})
SELECT song_id, line, count(*) AS n, count(CASE WHEN acoustic THEN 1 END) >= 2 AND (count(CASE WHEN acoustic AND before THEN 1 END) > 0 OR count(CASE WHEN acoustic THEN 1 END) >= 4e-1 * count(*)) AS accepted FROM l GROUP BY song_id, line
""", "X20")
