"""Evidence about level and pitch: energy within events, deviation in the core, the metrical level and where bars begin, and keys."""

from ..functions.fixed import SCALE, rows
from ..plans.sqlop import operator
from ..sources import adapters

energy = operator("event_timing_energy", "core_events frames_of_cores", """
WITH e AS (SELECT song_id, a, b - a AS n, least(32, b - a) AS bins FROM {core_events} WHERE b > a),
x AS (SELECT song_id, a, n, bins, a + d AS i, CAST(floor(d * bins / (1e0 * n)) AS BIGINT) AS slot FROM e [[each_below:n|d]]),
w AS (SELECT x.song_id, x.a, x.slot, sum(CASE WHEN f.energy >= 0 AND NOT isnan(f.energy) THEN f.energy * f.energy ELSE 0e0 END) AS power FROM x LEFT JOIN {frames_of_cores} AS f ON f.song_id = x.song_id AND f.i = x.i GROUP BY x.song_id, x.a, x.slot),
t AS (SELECT *, sum(power) OVER (PARTITION BY song_id, a) AS total FROM w)
SELECT song_id, a, slot, round(power / total, 7) AS weight FROM t WHERE total > 0
""", "AG24: an event's energy over 32 parts of it at most, which sum to one; an event without energy has none")

deviation = operator("pitch_deviation", "core_events frames_of_cores song_cents", """
WITH e AS (SELECT song_id, a, midi, center, core_a, core_b - core_a AS n FROM {core_events}),
x AS (SELECT song_id, a, core_a + d AS i FROM (SELECT * FROM e WHERE n > 0) AS q [[each_below:n|d]]),
v AS (SELECT x.song_id, x.a, f.pitch, row_number() OVER (PARTITION BY x.song_id, x.a ORDER BY f.pitch, f.i) - 1 AS r, count(*) OVER (PARTITION BY x.song_id, x.a) AS m FROM x JOIN {frames_of_cores} AS f ON f.song_id = x.song_id AND f.i = x.i WHERE f.voiced AND f.pitch IS NOT NULL),
s AS (SELECT song_id, a, max(m) AS frames, (max(CASE WHEN r = floor((m - 1) / 2e0) THEN pitch END) + max(CASE WHEN r = ceil((m - 1) / 2e0) THEN pitch END)) / 2 AS middle, max(CASE WHEN r = floor((m - 1) * 1e-1) THEN pitch END) AS low, max(CASE WHEN r = ceil((m - 1) * 9e-1) THEN pitch END) AS high FROM v GROUP BY song_id, a),
j AS (SELECT e.song_id, e.a, e.midi, e.center, s.frames, s.middle, s.low, s.high, CASE WHEN e.center IS NOT NULL AND c.cents IS NOT NULL THEN e.center + c.cents / 100 ELSE s.middle END AS raw_center, c.cents FROM e LEFT JOIN s ON s.song_id = e.song_id AND s.a = e.a LEFT JOIN {song_cents} AS c ON c.song_id = e.song_id)
SELECT song_id, a, round((raw_center - midi) * 100, 4) + 0e0 AS raw_cents, round((center - midi) * 100, 4) + 0e0 AS corrected_cents, round((low - midi) * 100, 4) + 0e0 AS low_cents, round((high - midi) * 100, 4) + 0e0 AS high_cents, coalesce(frames, 0) AS frames,
       CASE WHEN center IS NOT NULL AND cents IS NOT NULL THEN 'center and tuning' WHEN middle IS NOT NULL THEN 'core frames' ELSE 'insufficient' END AS basis FROM j
""", "AG12: how far a note is from its pitch, before and after tuning, with the tenth and ninetieth of its core's voiced frames by index")

level = operator("preferred_level", "note_events level_grids level_tempi downbeats", """
WITH n AS (SELECT e.song_id, e.start_s, min(e.start_s) OVER (PARTITION BY e.song_id) AS first_s, 24e1 / g.bpm AS bar, g.bpm FROM {note_events} AS e JOIN {level_grids} AS g ON g.song_id = e.song_id WHERE e.midi > 0),
c AS (SELECT song_id, count(*) AS starts, CAST(floor((start_s - first_s) / bar) AS BIGINT) AS bar_no FROM n WHERE start_s < first_s + 4 * bar GROUP BY song_id, CAST(floor((start_s - first_s) / bar) AS BIGINT)),
v AS (SELECT song_id, sum(starts) AS opening, sum(CASE WHEN starts >= 4 THEN 1 ELSE 0 END) AS full_bars FROM c GROUP BY song_id),
h AS (SELECT g.song_id, max(CASE WHEN abs(t.bpm - g.bpm / 2e0) < g.bpm * 25e-3 THEN 1 ELSE 0 END) AS halved FROM {level_grids} AS g JOIN {level_tempi} AS t ON t.song_id = g.song_id GROUP BY g.song_id),
d AS (SELECT x.song_id, x.beat_s - lag(x.beat_s) OVER (PARTITION BY x.song_id ORDER BY x.beat_s) AS gap, 24e1 / g.bpm AS bar FROM {downbeats} AS x JOIN {level_grids} AS g ON g.song_id = x.song_id),
i AS (SELECT song_id, count(*) AS gaps, sum(CASE WHEN abs(gap - 2 * bar) <= greatest(14e-2, 12e-2 * bar) THEN 1 ELSE 0 END) AS doubles FROM d WHERE gap >= bar * 75e-2 AND gap <= bar * 225e-2 GROUP BY song_id),
j AS (SELECT g.song_id, g.bpm, g.confirmed, g.bpm BETWEEN 120 AND 150 AND NOT g.confirmed AND coalesce(h.halved, 0) = 1 AND coalesce(v.opening, 0) >= 20 AND v.full_bars >= 3 AS dense, coalesce(i.doubles, 0) >= 4 AND i.doubles >= 6e-1 * i.gaps AS doubled FROM {level_grids} AS g LEFT JOIN h ON h.song_id = g.song_id LEFT JOIN v ON v.song_id = g.song_id LEFT JOIN i ON i.song_id = g.song_id)
SELECT song_id, CASE WHEN bpm >= 100 AND (dense OR doubled) THEN bpm / 2e0 ELSE bpm * 1e0 END AS bpm, CASE WHEN bpm < 100 THEN 'slow' WHEN dense THEN 'dense opening' WHEN doubled THEN 'double bars' ELSE 'kept' END AS reason FROM j
""", "AG21, AG22: a fast level is halved where the opening four bars are dense and half the tempo is a candidate, or where marked first beats stand two bars apart")

anchor = operator("suggested_anchor", "note_events level_grids downbeats", """
WITH f AS (SELECT e.song_id, min(e.start_s) AS first_s, max(24e1 / g.bpm) AS bar, max(6e1 / g.bpm) AS period FROM {note_events} AS e JOIN {level_grids} AS g ON g.song_id = e.song_id WHERE e.midi > 0 GROUP BY e.song_id),
t AS (SELECT d.song_id, d.beat_s, f.first_s, f.bar, f.period FROM {downbeats} AS d JOIN f ON f.song_id = d.song_id WHERE d.beat_s BETWEEN f.first_s - 2 * f.bar AND f.first_s + 4 * f.bar),
p AS (SELECT a.song_id, a.beat_s AS anchor, count(*) AS agreeing, sum(1 / (1 + abs(t.beat_s - t.first_s) / t.bar)) AS score FROM t AS a JOIN t ON t.song_id = a.song_id AND abs((t.beat_s - a.beat_s) / a.bar - round((t.beat_s - a.beat_s) / a.bar)) * a.bar <= a.period * 15e-2 WHERE a.beat_s <= a.first_s GROUP BY a.song_id, a.beat_s),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(score, 8) DESC, anchor DESC) AS place FROM p WHERE agreeing >= 3),
d AS (SELECT song_id, min(beat_s) AS first_at FROM {downbeats} GROUP BY song_id)
SELECT d.song_id, coalesce(r.anchor, d.first_at) AS anchor, r.anchor IS NOT NULL AS supported FROM d LEFT JOIN r ON r.song_id = d.song_id AND r.place = 1
""", "AG23: where bars begin: the marked first beat before the first note with which most others near it agree, of equal ones the latest; else the first mark")

_MAP = "version = 1 AND status IN ('unknown', 'suggested', 'confirmed', 'conflict') AND do_pc BETWEEN 0 AND 11 AND do_pc = key_pc AND ((reference_midi % 12) + 12) % 12 = do_pc AND (NOT locked OR status = 'confirmed')"
maps = operator("key_map_violations", "key_maps key_anchors", f"""
WITH a AS (SELECT score_id, count(*) AS anchors, max(CASE WHEN start_s >= 0 AND end_s > start_s AND degree BETWEEN 1 AND 7 AND accidental BETWEEN -1 AND 1 AND midi IS NOT NULL AND do_pc BETWEEN 0 AND 11 THEN 0 ELSE 1 END) AS bad FROM {{key_anchors}} GROUP BY score_id)
SELECT m.score_id, CASE WHEN NOT coalesce({_MAP}, false) THEN 'state' WHEN NOT coalesce(mode IN ('unknown', 'major', 'minor') AND (tonic_pc IS NULL OR tonic_pc BETWEEN 0 AND 11), false) THEN 'tonic' WHEN coalesce(a.anchors, 0) > 64 OR tuning_cents IS NULL OR isnan(tuning_cents) THEN 'record' WHEN a.bad = 1 THEN 'anchor' END AS reason
FROM {{key_maps}} AS m LEFT JOIN a ON a.score_id = m.score_id
""", "DQ4: the first rule that a key map breaks, in the order in which they are told")

relabelled = operator("relabelled_to_key", "notes scores new_keys", f"""
WITH k AS (SELECT n.score_id, n.note_id, n.degree AS old_degree, CASE WHEN n.degree > 0 THEN s.do_midi + CASE n.degree {' '.join(f'WHEN {i + 1} THEN {v}' for i, v in enumerate(SCALE))} END + 12 * n.octave + n.accidental END AS midi, w.do_midi AS new_do, w.flat FROM {{notes}} AS n JOIN {{new_keys}} AS w ON w.score_id = n.score_id
           JOIN (SELECT score_id, 60 + CASE score_key WHEN 'C' THEN 0 WHEN 'Db' THEN 1 WHEN 'D' THEN 2 WHEN 'Eb' THEN 3 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'Gb' THEN 6 WHEN 'G' THEN 7 WHEN 'Ab' THEN 8 WHEN 'A' THEN 9 WHEN 'Bb' THEN 10 ELSE 11 END AS do_midi FROM {{scores}}) AS s ON s.score_id = n.score_id),
d AS (SELECT *, (((midi - new_do) % 12) + 12) % 12 AS pc, CAST(floor((midi - new_do) / 12e0) AS BIGINT) AS octave FROM k)
SELECT d.score_id, d.note_id, CAST(d.midi AS BIGINT) AS midi, CAST(CASE WHEN old_degree = 0 THEN 0 WHEN octave NOT BETWEEN -2 AND 2 THEN NULL WHEN s.i IS NOT NULL THEN s.i + 1 WHEN flat THEN f.i + 1 ELSE u.i + 1 END AS BIGINT) AS degree, CASE WHEN old_degree > 0 AND octave BETWEEN -2 AND 2 THEN octave END AS octave,
       CASE WHEN old_degree = 0 OR s.i IS NOT NULL THEN 0 WHEN flat THEN -1 ELSE 1 END AS accidental, CASE WHEN old_degree > 0 AND octave NOT BETWEEN -2 AND 2 THEN 'octave' END AS refused
FROM d LEFT JOIN {rows(SCALE, 's', 'i', 'v')} ON s.v = d.pc LEFT JOIN {rows(SCALE, 'u', 'i', 'v')} ON u.v = d.pc - 1 LEFT JOIN {rows(SCALE, 'f', 'i', 'v')} ON f.v = d.pc + 1
""", "ED5: the same sounding pitch under another Do, flats in flat keys and sharps in others; what leaves two octaves is refused")

adapters.VIEWS |= {
    "song_cents": "SELECT DISTINCT user_id AS song_id, CASE WHEN user_id % 4 > 0 THEN user_id % 7 * 5e0 - 15 END AS cents FROM {events}",
    "level_grids": "SELECT DISTINCT user_id AS song_id, 90 + user_id % 70 AS bpm, user_id % 11 = 0 AS confirmed FROM {events}",
    "level_tempi": "SELECT DISTINCT user_id AS song_id, CASE WHEN user_id % 3 > 0 THEN 45e0 + user_id % 70 / 2e0 ELSE 40e0 END AS bpm FROM {events}",
    "key_maps": "SELECT DISTINCT CAST(floor(l_orderkey / 32) AS BIGINT) AS score_id, CASE WHEN l_orderkey % 37 = 0 THEN 2 ELSE 1 END AS version, CASE CAST(floor(l_orderkey / 32) AS BIGINT) % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'other' ELSE 'suggested' END AS status, CAST(floor(l_orderkey / 32) AS BIGINT) % 12 AS do_pc, CAST(floor(l_orderkey / 32) AS BIGINT) % 12 AS key_pc, 60 + CAST(floor(l_orderkey / 32) AS BIGINT) % 12 AS reference_midi, CAST(floor(l_orderkey / 32) AS BIGINT) % 10 = 0 AS locked, CASE CAST(floor(l_orderkey / 32) AS BIGINT) % 7 WHEN 3 THEN 'dorian' ELSE 'major' END AS mode, CASE WHEN CAST(floor(l_orderkey / 32) AS BIGINT) % 3 > 0 THEN CAST(floor(l_orderkey / 32) AS BIGINT) % 13 END AS tonic_pc, 1e1 AS tuning_cents FROM {lineitem} WHERE l_linenumber = 1 AND l_orderkey % 32 = 5",
    "key_anchors": "SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS score_id, l_linenumber * 1e0 AS start_s, l_linenumber + l_partkey % 50 * 1e-1 AS end_s, 1 + l_partkey % 7 AS degree, l_suppkey % 3 - 1 AS accidental, 60e0 AS midi, l_partkey % 12 AS do_pc FROM {lineitem} WHERE l_orderkey % 32 < 20",
    "new_keys": "SELECT DISTINCT CAST(floor(l_orderkey / 32) AS BIGINT) AS score_id, 55 + CAST(floor(l_orderkey / 32) AS BIGINT) % 12 AS do_midi, CAST(floor(l_orderkey / 32) AS BIGINT) % 2 = 0 AS flat FROM {lineitem}",
}
adapters.TABLES |= {"song_cents": "events", "level_grids": "events", "level_tempi": "events", "key_maps": "lineitem", "key_anchors": "lineitem", "new_keys": "lineitem"}
