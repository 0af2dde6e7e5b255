"""Aggregations and rankings over notes and detector events."""

from ..functions.fixed import KEY_NAMES, MAJOR, MINOR, SCALE, rows
from ..functions.scalars import TICKS
from ..plans.sqlop import operator

PC12 = "(VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11))"
#: Events that count: certain, not recovered, of positive length, pitch and reliability.
RELIABILITY = "coalesce(pitch_reliability, confidence, 1e0)"
VALID = f"NOT uncertain AND recovery_reason IS NULL AND midi > 0 AND end_s > start_s AND {RELIABILITY} > 0"
#: Dense weighted pitch-class histogram of each song.
HISTOGRAM = f"""
w AS (SELECT song_id, ((CAST(floor(pitch_center + 5e-1) AS BIGINT) % 12) + 12) % 12 AS pc, sum((end_s - start_s) * least(1e0, {RELIABILITY})) AS weight FROM {{note_events}} WHERE {VALID} GROUP BY 1, 2),
h AS (SELECT s.song_id, p.pc, coalesce(w.weight, 0e0) AS weight FROM (SELECT DISTINCT song_id FROM {{note_events}}) AS s CROSS JOIN {PC12} AS p(pc) LEFT JOIN w ON w.song_id = s.song_id AND w.pc = p.pc)"""
IN_SCALE = f"(h.pc - d.d + 12) % 12 IN ({', '.join(map(str, SCALE))})"

used_ticks = operator("used_ticks", "notes", f"SELECT measure_id, round(sum({TICKS}), 6) AS used FROM {{notes}} GROUP BY measure_id", "AG1")
histogram = operator("pitch_histogram", "note_events", f"WITH {HISTOGRAM.strip()} SELECT song_id, CAST(pc AS BIGINT) AS pc, round(weight, 6) AS weight FROM h", "AG2, DQ8")
coverage = operator("scale_coverage", "note_events", f"""
WITH {HISTOGRAM.strip()}
SELECT h.song_id, CAST(d.d AS BIGINT) AS do_pc, round(coalesce(sum(CASE WHEN {IN_SCALE} THEN h.weight ELSE 0e0 END) / nullif(sum(h.weight), 0e0), 0e0), 6) AS in_scale
FROM h CROSS JOIN {PC12} AS d(d) GROUP BY h.song_id, d.d
""", "AG3, J17")
do_ranking = operator("do_ranking", "note_events", f"""
WITH {HISTOGRAM.strip()},
s AS (
  SELECT h.song_id, d.d, sum(h.weight) AS total, sum(CASE WHEN {IN_SCALE} THEN h.weight ELSE 0e0 END) AS inside,
         sum(CASE WHEN h.pc = d.d THEN h.weight WHEN h.pc = (d.d + 9) % 12 THEN 8e-1 * h.weight ELSE 0e0 END) AS tonic,
         coalesce(CASE WHEN max(h.weight) - min(h.weight) > 1e-9 THEN covar_pop(h.weight, ma.v) / nullif(stddev_pop(h.weight) * stddev_pop(ma.v), 0e0) END, 0e0) AS major, coalesce(CASE WHEN max(h.weight) - min(h.weight) > 1e-9 THEN covar_pop(h.weight, mi.v) / nullif(stddev_pop(h.weight) * stddev_pop(mi.v), 0e0) END, 0e0) AS minor
  FROM h CROSS JOIN {PC12} AS d(d) JOIN {rows(MAJOR, 'ma', 'i', 'v')} ON ma.i = (h.pc - d.d + 12) % 12 JOIN {rows(MINOR, 'mi', 'i', 'v')} ON mi.i = (h.pc - d.d + 15) % 12
  GROUP BY h.song_id, d.d),
e AS (SELECT *, {VALID} AS valid, coalesce(core_start, start_s) AS own_from, coalesce(core_end, end_s) AS own_to, core_start IS NOT NULL AND core_end IS NOT NULL AS cored, CAST(floor(pitch_center + 5e-1) AS BIGINT) AS pitch,
      abs(pitch_center - floor(pitch_center + 5e-1)) <= 35e-2 AS settled, coalesce(performance_end, end_s) AS sounds_to FROM {{note_events}} WHERE end_s > start_s),
o AS (SELECT *, max(sounds_to) OVER (PARTITION BY song_id ORDER BY start_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sounding, lead(start_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS next_s FROM e),
ph AS (SELECT song_id, ((pitch % 12) + 12) % 12 AS pc, least(15e-1, own_to - own_from) * least(1e0, {RELIABILITY}) AS weight FROM o WHERE valid AND settled AND round(next_s - sounding, 9) >= 5e-1 AND round(own_to - own_from, 9) >= 12e-2),
pt AS (SELECT song_id, sum(weight) AS total, count(*) AS n FROM ph GROUP BY song_id),
pd AS (SELECT ph.song_id, d.d, sum(ph.weight * CASE WHEN ph.pc = d.d THEN 1e0 WHEN ph.pc = (d.d + 9) % 12 THEN 8e-1 WHEN ph.pc = (d.d + 7) % 12 THEN 35e-2 ELSE 0e0 END) AS support FROM ph CROSS JOIN {PC12} AS d(d) GROUP BY ph.song_id, d.d),
te AS (SELECT song_id, ((pitch % 12) + 12) % 12 AS pc, row_number() OVER (PARTITION BY song_id ORDER BY sounds_to DESC, event_id) AS rank FROM e WHERE valid AND settled AND {RELIABILITY} >= 5e-1 AND round(own_to - own_from, 9) >= CASE WHEN cored THEN 2e-1 ELSE 25e-2 END),
c AS (SELECT s.*, coalesce(inside / nullif(total, 0e0), 0e0) AS cover FROM s), m AS (SELECT *, max(cover) OVER (PARTITION BY song_id) AS most FROM c),
t AS (SELECT te.song_id, te.pc, round(m.most - m.cover, 9) <= 18e-2 AS accepted FROM te JOIN m ON m.song_id = te.song_id AND m.d = te.pc WHERE te.rank = 1),
r AS (
  SELECT m.song_id, m.d, CASE WHEN minor > major THEN 'relative-minor' ELSE 'major' END AS mode,
         round(65e-2 * cover + 25e-2 * (greatest(major, minor) + 1) / 2 + 1e-1 * coalesce(m.tonic / nullif(m.total, 0e0), 0e0), 6) AS distribution_score,
         CASE WHEN round(m.most - cover, 9) > 12e-2 OR NOT coalesce(t.accepted OR t.pc = (m.d + 9) % 12, FALSE) THEN 0e0 WHEN t.pc = m.d THEN 4e-2 WHEN t.pc = (m.d + 9) % 12 THEN 32e-3 WHEN t.pc = (m.d + 7) % 12 THEN 12e-3 ELSE 0e0 END AS cadence,
         round(CASE WHEN round(m.most - cover, 9) <= 12e-2 THEN coalesce(12e-2 * least(1e0, pt.n / 4e0) * pd.support / nullif(pt.total, 0e0), 0e0) ELSE 0e0 END, 6) AS phrase_score
  FROM m LEFT JOIN t ON t.song_id = m.song_id LEFT JOIN pt ON pt.song_id = m.song_id LEFT JOIN pd ON pd.song_id = m.song_id AND pd.d = m.d)
SELECT r.song_id, CAST(r.d AS BIGINT) AS do_pc, k.name AS key_name, r.mode, r.distribution_score, r.cadence, r.phrase_score, round(r.distribution_score + r.cadence + r.phrase_score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY r.song_id ORDER BY round(r.distribution_score + r.cadence + r.phrase_score, 6) DESC, r.d) AS BIGINT) AS rank
FROM r JOIN {rows(KEY_NAMES, 'k', 'pc', 'name')} ON k.pc = r.d
""", "AG2-AG5, J17, K1, W2, W3: twelve tonic candidates by scale share, profile correlation and tonic share, and by the notes that end the song and its phrases")
main_classes = operator("main_pitch_classes", "note_events", f"""
WITH v AS (SELECT song_id, CAST(floor(pitch_center + 5e-1) AS BIGINT) AS m, (end_s - start_s) * least(1e0, {RELIABILITY}) AS weight FROM {{note_events}} WHERE {VALID}),
o AS (SELECT song_id, m, m % 12 AS pc, round(sum(weight), 6) AS weight FROM v GROUP BY song_id, m),
c AS (SELECT song_id, pc, sum(weight) AS weight FROM o GROUP BY song_id, pc),
r AS (SELECT song_id, pc, weight, sum(weight) OVER (PARTITION BY song_id) AS total, row_number() OVER (PARTITION BY song_id ORDER BY round(weight, 6) DESC, pc) AS rank FROM c),
b AS (SELECT song_id, pc, m, row_number() OVER (PARTITION BY song_id, pc ORDER BY weight DESC, m) AS best FROM o)
SELECT r.song_id, r.pc, CAST(r.rank AS BIGINT) AS rank, round(r.weight, 6) AS weight, round(r.weight / r.total, 6) AS share, b.m AS midi
FROM r JOIN b ON b.song_id = r.song_id AND b.pc = r.pc AND b.best = 1 WHERE r.rank <= 7
""", "AG7: seven main pitch classes and the octave in which each is heaviest")
range_stats = operator("range_stats", "note_events", """
WITH m AS (SELECT song_id, median(pitch_center) AS center FROM {note_events} GROUP BY song_id)
SELECT e.song_id, count(*) AS n, count(CASE WHEN NOT e.uncertain THEN 1 END) AS voiced, round(max(m.center), 6) AS center, round(median(abs(e.pitch_center - m.center)) * 100, 4) AS mad_cents, round(avg(e.confidence) + 1e-9, 4) AS confidence
FROM {note_events} AS e JOIN m ON m.song_id = e.song_id GROUP BY e.song_id
""", "AG11: median and median absolute deviation in cents")
weighted_median = operator("weighted_median", "note_events", """
WITH c AS (SELECT song_id, pitch_center, event_id, sum(confidence) OVER (PARTITION BY song_id ORDER BY pitch_center, event_id) AS upto, sum(confidence) OVER (PARTITION BY song_id) AS total FROM {note_events})
SELECT song_id, round(min(pitch_center), 6) AS weighted_median FROM c WHERE round(upto, 6) >= round(total / 2, 6) GROUP BY song_id
""", "AG13: least value at which half of the weight is reached")
local_spread = operator("interquartile_spread", "note_events", """
SELECT song_id, round([[quartile3:pitch_center]] - [[quartile1:pitch_center]], 6) AS iqr, [[quartile3:pitch_center]] - [[quartile1:pitch_center]] <= 25e-2 AS stable FROM {note_events} GROUP BY song_id
""", "AG14")
tuning = operator("tuning_estimate", "note_events", """
WITH a AS (SELECT song_id, count(*) AS n, avg(cos(2 * pi() * pitch_center)) AS x, avg(sin(2 * pi() * pitch_center)) AS y FROM {note_events} WHERE NOT uncertain GROUP BY song_id)
SELECT song_id, n, round(sqrt(x * x + y * y), 6) AS concentration, round(100 * atan2(y, x) / (2 * pi()), 4) + 0e0 AS cents,
       CASE WHEN n < 8 THEN 'few' WHEN sqrt(x * x + y * y) < 3e-1 THEN 'spread' ELSE 'used' END AS decision FROM a
""", "AG15: circular mean of fractional pitches")
consensus = operator("anchor_consensus", "notes", f"""
WITH a AS (SELECT score_id, degree, (((60 + 12 * octave + accidental + CASE degree {' '.join(f'WHEN {i + 1} THEN {v}' for i, v in enumerate(SCALE))} END - m_idx % 2) % 12) + 12) % 12 AS do_pc FROM {{notes}} WHERE degree > 0 AND n_idx = 1)
SELECT score_id, count(*) AS anchors, CASE WHEN count(DISTINCT do_pc) > 1 THEN 'conflict' WHEN count(*) >= 2 AND count(DISTINCT degree) >= 2 THEN 'verified' ELSE 'insufficient' END AS status,
       CASE WHEN count(DISTINCT do_pc) = 1 THEN CAST(min(do_pc) AS BIGINT) END AS do_pc FROM a GROUP BY score_id
""", "AG16")
phase_scores = operator("phase_scores", "note_events", """
WITH p AS (SELECT song_id, (row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) - 1) % 4 AS phase, confidence FROM {note_events}),
s AS (SELECT song_id, phase, round(avg(confidence), 9) AS score FROM p GROUP BY song_id, phase)
SELECT song_id, CAST(phase AS BIGINT) AS phase, round(score / max(score) OVER (PARTITION BY song_id), 6) AS relative FROM s
""", "AG20: score of each beat of the bar, relative to the best")
double_bars = operator("metrical_level", "note_events", """
WITH g AS (SELECT song_id, start_s - lag(start_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS gap FROM {note_events}), m AS (SELECT song_id, median(gap) AS typical FROM g GROUP BY song_id)
SELECT g.song_id, count(CASE WHEN g.gap > 15e-1 * m.typical THEN 1 END) AS doubles, count(g.gap) AS gaps,
       count(CASE WHEN g.gap > 15e-1 * m.typical THEN 1 END) >= 4 AND count(CASE WHEN g.gap > 15e-1 * m.typical THEN 1 END) >= 6e-1 * count(g.gap) AS prefer_double
FROM g JOIN m ON m.song_id = g.song_id GROUP BY g.song_id
""", "AG21")
half_time = operator("half_time_counts", "note_events", """
WITH t AS (SELECT song_id, CAST(floor((start_s - min(start_s) OVER (PARTITION BY song_id)) / 2e0) AS BIGINT) AS bar FROM {note_events})
SELECT song_id, bar, count(*) AS onsets FROM t WHERE bar < 4 GROUP BY song_id, bar
""", "AG22: onsets in each of the first four bars")
rhythm_anchor = operator("rhythm_anchor", "note_events", """
WITH b AS (SELECT song_id, event_id, start_s, CAST(floor(start_s / 8e0) AS BIGINT) AS slot FROM {note_events} WHERE NOT uncertain), n AS (SELECT song_id, event_id, start_s, slot + i AS slot FROM b CROSS JOIN (VALUES (-1), (0), (1)) AS d(i)),
p AS (SELECT x.song_id, x.event_id, sum(1e0 / (1 + abs(y.start_s - x.start_s) / 2e0)) AS score, count(*) AS agreeing FROM n AS x JOIN b AS y ON x.song_id = y.song_id AND x.slot = y.slot AND y.start_s BETWEEN x.start_s - 8e0 AND x.start_s + 8e0 GROUP BY x.song_id, x.event_id),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(score, 6) DESC, event_id) AS rank FROM p)
SELECT song_id, event_id, agreeing, round(score, 6) AS score FROM r WHERE rank = 1
""", "AG23: the downbeat that most others agree with, within 8 s, by slots as long and their neighbours")
issue_density = operator("issue_density", "note_events", """
WITH s AS (SELECT song_id, min(start_s) AS a, max(start_s) AS b FROM {note_events} GROUP BY song_id)
SELECT e.song_id, CAST(least(179, floor((e.start_s - s.a) / (s.b - s.a) * 180)) AS BIGINT) AS bin, count(*) AS issues
FROM {note_events} AS e JOIN s ON s.song_id = e.song_id WHERE e.uncertain AND s.b > s.a GROUP BY 1, 2
""", "X40")
key_share = operator("accidental_share", "notes", "SELECT score_id, count(*) AS notes, round(avg(CASE WHEN accidental <> 0 THEN 1e0 ELSE 0e0 END), 6) AS share FROM {notes} WHERE degree > 0 GROUP BY score_id", "AG29")
comparison_totals = operator("comparison_totals", "notes", "SELECT score_id, count(*) AS notes, count(CASE WHEN degree = 0 THEN 1 END) AS rests, count(CASE WHEN accidental <> 0 THEN 1 END) AS altered, count(DISTINCT measure_id) AS measures FROM {notes} GROUP BY score_id", "AG27")
