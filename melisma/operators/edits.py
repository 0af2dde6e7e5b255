"""Edits kept as rows, and what follows from them: suggestions, lyric entries, bar marks, times with a fallback, search ends."""

from ..functions.scalars import TICKS
from ..plans.sqlop import operator

PITCH, LENGTH = "s.refused IS NULL AND s.wants IN ('pitch', 'both')", "s.refused IS NULL AND s.wants IN ('length', 'both')"
applied = operator("applied_suggestions", "notes suggestions", f"""
WITH s AS (SELECT *, CASE WHEN kind <> 'difference' THEN 'unmatched' WHEN wants <> 'length' AND NOT same_key THEN 'key' WHEN wants <> 'pitch' AND tuplet THEN 'tuplet' END AS refused FROM {{suggestions}})
SELECT n.score_id, n.note_id, s.refused, {", ".join(f"CASE WHEN {PITCH} THEN s.source_{c} ELSE n.{c} END AS {c}" for c in ("degree", "octave", "accidental"))},
       {", ".join(f"CASE WHEN {LENGTH} THEN s.source_{c} ELSE n.{c} END AS {c}" for c in ("base", "dots"))} FROM {{notes}} AS n LEFT JOIN s ON s.note_id = n.note_id
""", "X8: a note takes pitch or length from the note it was compared with; not without a match, across keys, or for one note of a tuplet")
lyric_entries = operator("lyric_entries", "notes lyric_edits", """
WITH c AS (SELECT e.score_id, e.seq, e.note_id, e.verse, trim(e.text) AS text, CASE WHEN n.note_id IS NULL THEN 'no note' WHEN n.degree = 0 THEN 'rest' WHEN e.verse NOT BETWEEN 1 AND 4 THEN 'verse' WHEN length(trim(e.text)) > 80 THEN 'length' END AS refused
           FROM {lyric_edits} AS e LEFT JOIN {notes} AS n ON n.note_id = e.note_id),
r AS (SELECT score_id, seq, note_id, verse, text, row_number() OVER (PARTITION BY note_id, verse ORDER BY seq DESC) AS later FROM c WHERE refused IS NULL)
SELECT score_id, seq, note_id, verse, CASE WHEN later > 1 THEN 'replaced' WHEN text = '' THEN 'removed' ELSE 'kept' END AS state, CASE WHEN later = 1 AND text <> '' THEN text END AS text FROM r
UNION ALL SELECT score_id, seq, note_id, verse, refused, NULL FROM c WHERE refused IS NOT NULL
""", "X35: the last entry of a note and verse stands, an empty one removes it; refused entries tell why")
STARTS = f"""
WITH m AS (SELECT score_id, m_idx, measure_id, min(source_s) AS start_s, max(source_s + 60e0 / 16 * ({TICKS}) / 90) AS end_s FROM {{notes}} GROUP BY score_id, m_idx, measure_id),
k AS (SELECT *, lag(measure_id) OVER w AS before, lead(measure_id) OVER w AS after, lead(start_s) OVER w AS next_s FROM m WINDOW w AS (PARTITION BY score_id ORDER BY m_idx))
"""
marks = operator("boundary_times", "notes", f"{STARTS.rstrip()}\nSELECT score_id, measure_id, round(coalesce(next_s, end_s), 4) AS at FROM k WHERE after IS NOT NULL AND m_idx % 3 = 0 AND coalesce(next_s, end_s) IS NOT NULL\n",
    "X38: a manual boundary's time: where the next measure begins, else where its own ends; every third is manual")
rebound = operator("rebound_bars", "notes scores bar_marks", f"""{STARTS.rstrip()},
b AS (SELECT k.score_id, k.before, k.m_idx, k.start_s, CAST(floor(k.start_s) AS BIGINT) AS slot, greatest(15e-2, 30e0 / s.bpm) AS bound FROM k JOIN {{scores}} AS s ON s.score_id = k.score_id WHERE k.before IS NOT NULL AND k.start_s IS NOT NULL),
t AS (SELECT x.score_id, x.mark_id, x.at, CAST(floor(x.at) AS BIGINT) + d.i AS slot FROM {{bar_marks}} AS x CROSS JOIN (VALUES (-1), (0), (1)) AS d(i)),
j AS (SELECT t.score_id, t.mark_id, b.before, row_number() OVER (PARTITION BY t.score_id, t.mark_id ORDER BY round(abs(b.start_s - t.at), 6), b.m_idx) AS rank FROM t JOIN b ON b.score_id = t.score_id AND b.slot = t.slot AND abs(b.start_s - t.at) < b.bound)
SELECT x.score_id, x.mark_id, j.before AS measure_id FROM {{bar_marks}} AS x LEFT JOIN j ON j.score_id = x.score_id AND j.mark_id = x.mark_id AND j.rank = 1
""", "X38: a bar mark is bound to the measure whose end is nearest, within two sixteenths or .15 s, by slots of a second; else to none")
compared_times = operator("comparison_times", "notes scores", f"""
WITH p AS (SELECT n.score_id, n.note_id, n.source_s, count(n.source_s) OVER (PARTITION BY n.score_id) AS known, sum({TICKS}) OVER (PARTITION BY n.score_id ORDER BY n.m_idx, n.n_idx) - {TICKS} AS placed, {TICKS} AS ticks, 60e0 / s.bpm / 16 AS tick_s
           FROM {{notes}} AS n JOIN {{scores}} AS s ON s.score_id = n.score_id)
SELECT score_id, note_id, round(CASE WHEN known > 0 THEN source_s ELSE placed * tick_s END, 4) AS start_s, round(CASE WHEN known > 0 THEN source_s ELSE placed * tick_s END + ticks * tick_s, 4) AS end_s, known = 0 AS estimated FROM p
""", "X6: recorded times; written ones only where a score has no recorded time at all")
search_ends = operator("search_ends", "characters note_events", """
WITH l AS (SELECT song_id, line_id, count(*) - max(CASE WHEN manual THEN i END) AS tail, max(CASE WHEN manual THEN start_s END) AS t, max(end_s) + 1 AS line_end
           FROM (SELECT *, row_number() OVER (PARTITION BY song_id, line_id ORDER BY char_id) AS i FROM {characters}) AS x GROUP BY song_id, line_id),
h AS (SELECT song_id, start_s, end_s, row_number() OVER w AS place, CASE WHEN start_s - lag(start_s) OVER w <= 4e0 THEN 0 ELSE 1 END AS fresh FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY place) AS island FROM h),
e AS (SELECT *, max(place) OVER (PARTITION BY song_id, island) AS island_end, max(end_s) OVER (PARTITION BY song_id) AS duration FROM g),
u AS (SELECT song_id, t + 5e-2 AS moment, 1 AS kind, line_id AS id FROM l WHERE t IS NOT NULL UNION ALL SELECT song_id, start_s, 0, place FROM e),
f AS (SELECT song_id, id, kind, min(CASE WHEN kind = 0 THEN id END) OVER (PARTITION BY song_id ORDER BY moment, kind, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i0 FROM u),
j AS (SELECT l.*, f.i0, CASE WHEN l.tail > 0 AND a.start_s - l.t <= 4e0 THEN least(f.i0 + l.tail - 1, a.island_end) END AS reach FROM l LEFT JOIN f ON f.kind = 1 AND f.song_id = l.song_id AND f.id = l.line_id LEFT JOIN e AS a ON a.song_id = l.song_id AND a.place = f.i0),
d AS (SELECT song_id, max(duration) AS duration FROM e GROUP BY song_id)
SELECT j.song_id, j.line_id, round(least(d.duration, greatest(j.line_end, coalesce(b.end_s + 1, j.line_end), coalesce(j.t + j.tail * 65e-2 + 5e-1, j.line_end))), 4) AS search_to
FROM j JOIN d ON d.song_id = j.song_id LEFT JOIN e AS b ON b.song_id = j.song_id AND b.place = j.reach
""", "X17: a line is searched to where as many heard syllables end as follow its last known character, unless 4 s of silence part them")
targets = operator("contextual_targets", "note_events", """
WITH n AS (SELECT song_id, event_id, midi, pitch_center, start_s, end_s, core_end - core_start AS core, confidence, uncertain, lag(uncertain) OVER w AS left_uncertain, lead(uncertain) OVER w AS right_uncertain, lag(pitch_center) OVER w AS left_center,
                  lead(pitch_center) OVER w AS right_center, lag(end_s) OVER w AS left_end, lead(start_s) OVER w AS right_start, lead(midi) OVER w AS right_midi FROM {note_events} WINDOW w AS (PARTITION BY song_id ORDER BY start_s, event_id))
SELECT song_id, event_id, midi AS nearest_midi, midi + 1 AS midi, round(abs(pitch_center - midi - 1) * 100, 1) AS cents FROM n
WHERE uncertain AND core >= 96e-3 - 1e-8 AND confidence >= 65e-2 AND NOT left_uncertain AND NOT right_uncertain AND right_start - end_s <= 3e-1 AND start_s - left_end <= 15e-2
      AND pitch_center - midi >= 35e-2 AND pitch_center - midi < 5e-1 AND midi = right_midi AND pitch_center - left_center >= 15e-1 AND pitch_center - right_center BETWEEN 28e-2 AND 8e-1
""", "W13: an uncertain flat peak just under a rounding boundary, before a distinct lower note of the same rounded pitch, is proposed a half tone higher")
eligible = operator("eligible_frames", "frames", """
WITH f AS (SELECT *, greatest(8e-4, max(energy) OVER (PARTITION BY song_id) * 25e-3) AS floor_ FROM {frames})
SELECT song_id, frame, CASE WHEN NOT voiced THEN 'unvoiced' WHEN pitch IS NULL THEN 'missing-pitch' WHEN energy < floor_ THEN 'low-energy' WHEN confidence < 35e-2 THEN 'low-voicing' ELSE 'eligible' END AS decision FROM f
""", "X27, SC16: which frames a decoder may read, and the first gate that keeps one out")
homophones = operator("homophone_emissions", "emissions", """
WITH s AS (SELECT *, max(log_p) OVER g AS peak FROM {emissions} WINDOW g AS (PARTITION BY frame, sound))
SELECT frame, token, round(least(0e0, peak + ln(exp(log_p - peak) + 5e-1 * (sum(exp(log_p - peak)) OVER (PARTITION BY frame, sound) - exp(log_p - peak)))), 6) AS log_p FROM s
""", "X22: a syllable also hears the others of its sound, each with half its weight")
