"""Edits of measures and bar lines, notes laid over new measures, and edits carried over to a new recognition."""

from ..functions.scalars import TICKS
from ..plans.sqlop import operator
from ..sources import adapters

NOTE = "degree, base, octave, dots, accidental"
_OF = lambda alias: ", ".join(f"{alias}.{c}" for c in NOTE.split(", "))

#: What each edit of a bar line does: the note that begins a measure, or no longer does, or why it is refused.
_EDITS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY score_id, m_idx ORDER BY n_idx) AS inside, dense_rank() OVER (PARTITION BY score_id ORDER BY m_idx) AS m FROM {notes}),
h AS (SELECT score_id, m_idx, m, note_id AS head FROM n WHERE inside = 1),
l AS (SELECT h.score_id, h.m_idx, h.m, r.head AS next_head FROM h LEFT JOIN h AS r ON r.score_id = h.score_id AND r.m = h.m + 1),
d AS (SELECT e.score_id, e.seq, e.kind, e.note_id, l.next_head, CASE WHEN e.kind = 'insert' THEN CASE WHEN n.note_id IS NULL THEN 'no note' WHEN n.inside = 1 THEN 'begins a measure' END WHEN l.m IS NULL THEN 'no measure' WHEN l.next_head IS NULL THEN 'last line'
             WHEN e.kind = 'move' AND (n.note_id IS NULL OR n.m NOT BETWEEN l.m AND l.m + 1 OR n.m = l.m AND n.inside = 1) THEN 'beyond its measures' END AS refused
      FROM {bar_edits} AS e LEFT JOIN n ON n.score_id = e.score_id AND n.note_id = e.note_id LEFT JOIN l ON l.score_id = e.score_id AND l.m_idx = e.m_idx)
"""
refusals = operator("bar_edit_results", "notes bar_edits", f"{_EDITS.rstrip()}\nSELECT score_id, seq, kind, note_id, refused FROM d\n", "ED3: which edits of bar lines hold, and why the others don't")
edited_bars = operator("edited_bars", "notes bar_edits", f"""{_EDITS.rstrip()},
f AS (SELECT score_id, note_id, max(begins) AS begins FROM (SELECT score_id, note_id, 1 AS begins FROM d WHERE refused IS NULL AND kind IN ('insert', 'move') UNION ALL SELECT score_id, next_head, 0 FROM d WHERE refused IS NULL AND kind IN ('delete', 'move')) AS u GROUP BY score_id, note_id),
b AS (SELECT n.*, coalesce(f.begins, CASE WHEN n.inside = 1 THEN 1 ELSE 0 END) AS begins, f.begins IS NOT NULL AS edited FROM n LEFT JOIN f ON f.score_id = n.score_id AND f.note_id = n.note_id),
m AS (SELECT *, sum(begins) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) - 1 AS new_m, CASE WHEN begins = 1 THEN CASE WHEN inside = 1 THEN measure_id ELSE -note_id END END AS own_id FROM b)
SELECT score_id, max(own_id) OVER (PARTITION BY score_id, new_m) AS measure_id, CAST(new_m AS BIGINT) AS m_idx, CAST(row_number() OVER (PARTITION BY score_id, new_m ORDER BY m_idx, n_idx) AS BIGINT) AS n_idx, note_id, {NOTE}, tie, source_s,
       max(CASE WHEN edited AND begins = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, new_m) = 1 AS manual, sum({TICKS}) OVER (PARTITION BY score_id, new_m) AS measure_ticks FROM m
""", "ED3: bar lines inserted, deleted and moved part the same notes anew; notes, ties and times stay, a new measure is named by its first note")
rebarred = operator("rebarred_notes", "notes scores", f"""
WITH p AS (SELECT n.*, s.meter * 16 AS capacity, 60e0 / s.bpm / 16 AS tick_s, {TICKS} AS ticks, round(sum({TICKS}) OVER (PARTITION BY n.score_id ORDER BY n.m_idx, n.n_idx) - {TICKS}, 6) AS placed FROM {{notes}} AS n JOIN {{scores}} AS s ON s.score_id = n.score_id),
b AS (SELECT *, CAST(floor(placed / capacity) AS BIGINT) AS first_m, CAST(ceil(round((placed + ticks) / capacity, 9)) AS BIGINT) - CAST(floor(placed / capacity) AS BIGINT) AS parts FROM p),
x AS (SELECT *, first_m + part AS m FROM b [[each_below:parts|part]]),
c AS (SELECT *, greatest(placed, m * capacity) AS a, least(placed + ticks, (m + 1) * capacity) AS z FROM x)
SELECT score_id, m AS m_idx, CAST(row_number() OVER (PARTITION BY score_id, m ORDER BY placed, part) AS BIGINT) AS n_idx, note_id, CAST(part AS BIGINT) AS part, degree, octave, accidental, round(z - a, 6) AS part_ticks, round(a - m * capacity, 6) AS at_tick, part < parts - 1 AND degree > 0 OR part = parts - 1 AND tie AS tie, round(source_s + (a - placed) * tick_s, 4) AS source_s FROM c
""", "ED3, ED7: notes over measures of the score's meter; a note that a line cuts becomes tied parts, each with its own time; a rest is cut without a tie")
rests = operator("filled_rests", "notes scores", f"""
WITH u AS (SELECT n.score_id, n.m_idx, max(n.measure_id) AS measure_id, max(n.n_idx) AS last_n, max(s.meter) * 16 - sum({TICKS}) AS free FROM {{notes}} AS n JOIN {{scores}} AS s ON s.score_id = n.score_id GROUP BY n.score_id, n.m_idx),
c AS (SELECT *, CAST(floor(free / 16) AS BIGINT) AS n4, CAST(floor((free - floor(free / 16) * 16) / 8) AS BIGINT) AS n8, CAST(floor((free - floor(free / 8) * 8) / 4) AS BIGINT) AS n16, free - floor(free / 4) * 4 AS over_ FROM u WHERE free > 0),
r AS (SELECT * FROM (SELECT *, CASE WHEN over_ > 1e-7 THEN 1 ELSE n4 + n8 + n16 END AS rows_ FROM c) AS q WHERE rows_ > 0)
SELECT score_id, measure_id, m_idx, last_n + k + 1 AS n_idx, CASE WHEN over_ > 1e-7 THEN NULL WHEN k < n4 THEN 4 WHEN k < n4 + n8 THEN 8 ELSE 16 END AS base, CASE WHEN over_ > 1e-7 THEN 'no rests fill it' END AS refused FROM r [[each_below:rows_|k]]
""", "ED2: the rests that fill a measure, longest first; a measure that quarters, eighths and sixteenths can't fill is refused")
pasted = operator("pasted_notes", "notes clips", f"""
WITH n AS (SELECT *, dense_rank() OVER (PARTITION BY score_id ORDER BY m_idx) AS m FROM {{notes}}),
u AS (SELECT score_id, m, sum({TICKS}) AS used FROM n GROUP BY score_id, m),
c AS (SELECT n.*, k.after_id, dense_rank() OVER (PARTITION BY n.score_id ORDER BY n.m) AS grp FROM {{clips}} AS k JOIN n ON n.score_id = k.score_id AND n.note_id = k.note_id),
t AS (SELECT c.score_id, max(a.m) AS m, max(a.n_idx) AS n_idx, max(a.measure_id) AS measure_id, max(u.used) + sum(CASE WHEN c.grp = 1 THEN {TICKS.replace("base", "c.base").replace("dots", "c.dots")} ELSE 0 END) AS filled, max(c.grp) AS groups FROM c JOIN n AS a ON a.score_id = c.score_id AND a.note_id = c.after_id JOIN u ON u.score_id = a.score_id AND u.m = a.m GROUP BY c.score_id),
w AS (SELECT *, filled <= 64 + 1e-7 AS fits FROM t),
o AS (SELECT n.score_id, n.note_id, CAST(NULL AS BIGINT) AS copy_of, {_OF("n")}, n.tie, n.source_s, n.m + CASE WHEN w.fits AND n.m > w.m THEN w.groups - 1 ELSE 0 END AS m, CASE WHEN w.fits AND n.m = w.m AND n.n_idx > w.n_idx THEN 1 ELSE 0 END AS side, n.n_idx FROM n LEFT JOIN w ON w.score_id = n.score_id),
p AS (SELECT c.score_id, -c.note_id AS note_id, c.note_id AS copy_of, {_OF("c")}, c.tie AND lead(c.note_id) OVER (PARTITION BY c.score_id ORDER BY c.m, c.n_idx) IS NOT NULL AS tie, CAST(NULL AS DOUBLE) AS source_s, w.m + c.grp - 1 AS m, CASE WHEN c.grp = 1 THEN 5e-1 ELSE 0 END AS side, c.n_idx FROM c JOIN w ON w.score_id = c.score_id AND w.fits),
a AS (SELECT * FROM o UNION ALL SELECT * FROM p)
SELECT score_id, CAST(m - 1 AS BIGINT) AS m_idx, CAST(row_number() OVER (PARTITION BY score_id, m ORDER BY side, n_idx, note_id) AS BIGINT) AS n_idx, note_id, copy_of, {NOTE}, tie, source_s FROM a
""", "ED2: copied notes stand after a note under ids of their own, without the times of their originals; further copied measures become new ones; a measure that would overflow refuses all")

#: Which earlier note a newly recognized one carries on: of its event, else of its time to the millisecond.
_MATCHED = """
WITH e AS (SELECT event_id, max_by(note_id, place) AS by_event, min_by(note_id, place) AS first_of FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS place FROM {earlier_notes} WHERE event_id IS NOT NULL) AS x GROUP BY event_id),
t AS (SELECT score_id, round(source_s, 3) AS at, min_by(note_id, place) AS by_time FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS place FROM {earlier_notes} WHERE source_s IS NOT NULL) AS x GROUP BY score_id, round(source_s, 3)),
m AS (SELECT[[merged:e, t]] n.*, CASE WHEN d.event_id IS NOT NULL THEN 'deleted' WHEN n.source_s IS NULL THEN 'no time' WHEN e.by_event IS NOT NULL THEN 'same event' WHEN t.by_time IS NOT NULL THEN 'same time' ELSE 'new' END AS reason,
             CASE WHEN d.event_id IS NULL AND n.source_s IS NOT NULL THEN coalesce(e.by_event, t.by_time) END AS old_id, row_number() OVER (PARTITION BY n.score_id, n.event_id ORDER BY n.m_idx, n.n_idx) AS event_place, row_number() OVER (PARTITION BY n.score_id ORDER BY n.m_idx, n.n_idx) AS place
      FROM {later_notes} AS n LEFT JOIN {deleted_events} AS d ON d.event_id = n.event_id LEFT JOIN e ON e.event_id = n.event_id LEFT JOIN t ON t.score_id = n.score_id AND t.at = round(n.source_s, 3))
"""
reconciled = operator("reconciled_notes", "earlier_notes later_notes deleted_events", f"""{_MATCHED.rstrip()}
SELECT m.score_id, m.note_id, m.reason, m.old_id, CASE WHEN m.reason = 'deleted' THEN 0 WHEN o.note_id IS NULL THEN m.degree WHEN o.corrected AND NOT o.confirmed THEN o.original_degree ELSE o.degree END AS degree,
       CASE WHEN m.reason = 'deleted' THEN 0 WHEN o.note_id IS NULL THEN m.octave WHEN o.corrected AND NOT o.confirmed THEN o.original_octave ELSE o.octave END AS octave, CASE WHEN m.reason = 'deleted' THEN 0 WHEN o.note_id IS NULL THEN m.accidental WHEN o.corrected AND NOT o.confirmed THEN 0 ELSE o.accidental END AS accidental, coalesce(o.confirmed, false) AS confirmed
FROM m LEFT JOIN {{earlier_notes}} AS o ON o.note_id = m.old_id
""", "X36: a new recognition keeps what was edited: notes of the same event, else of the same time, take the earlier pitch (the original one where only a correction had changed it); deleted events stay silent")
moved_lyrics = operator("reconciled_lyrics", "earlier_notes later_notes deleted_events earlier_lyrics later_lyrics", f"""{_MATCHED.rstrip()}[[stored:m|score_id, note_id, event_id, old_id, reason, event_place, place]],
g AS (SELECT o.note_id AS old_id, m.note_id, 0 AS rank, m.place FROM {{earlier_notes}} AS o JOIN m ON m.event_id = o.event_id AND m.score_id = o.score_id AND m.reason = 'same event' AND m.event_place = 1 UNION ALL SELECT old_id, note_id, 1, place FROM m WHERE reason = 'same time'),
r AS (SELECT old_id, note_id FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY rank, place) AS k FROM g) AS x WHERE k = 1),
l AS (SELECT e.note_id AS old_id, e.verse, e.text, r.note_id, row_number() OVER (PARTITION BY r.note_id, e.verse ORDER BY e.note_id) AS k FROM {{earlier_lyrics}} AS e LEFT JOIN r ON r.old_id = e.note_id)
SELECT l.old_id, l.verse, l.text, CASE WHEN l.note_id IS NOT NULL AND y.note_id IS NULL AND l.k = 1 THEN l.note_id END AS note_id, CASE WHEN l.note_id IS NULL THEN 'no note' WHEN y.note_id IS NOT NULL OR l.k > 1 THEN 'occupied' ELSE 'moved' END AS reason
FROM l LEFT JOIN {{later_lyrics}} AS y ON y.note_id = l.note_id AND y.verse = l.verse
""", "X36: lyrics go with their notes; where one stands already nothing is overwritten")

_N = adapters.VIEWS["notes"]
_EVENTS_OF = f"SELECT *, CAST(floor(note_id / 2e0) AS BIGINT) AS event_id FROM ({_N}) AS n"
adapters.VIEWS |= {
    "bar_edits": f"SELECT score_id, note_id AS seq, CASE note_id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'move' END AS kind, note_id + note_id % 2 AS note_id, m_idx FROM ({_N}) AS n WHERE note_id % 8 = 5",
    "clips": f"SELECT score_id, note_id, max(CASE WHEN note_id % 10 = 1 THEN note_id END) OVER (PARTITION BY score_id) AS after_id FROM ({_N}) AS n WHERE m_idx % 9 = 4",
    "earlier_notes": f"SELECT score_id, m_idx, n_idx, note_id, event_id, source_s, degree, octave, accidental, note_id % 5 = 0 AS corrected, note_id % 10 = 0 AS confirmed, degree % 7 + 1 AS original_degree, CAST(0 AS BIGINT) AS original_octave FROM ({_EVENTS_OF}) AS n",
    "later_notes": f"SELECT score_id, m_idx, n_idx, note_id + 1000000000 AS note_id, CASE WHEN note_id % 6 > 0 THEN event_id ELSE -event_id END AS event_id, CASE WHEN note_id % 24 = 0 THEN source_s + 1e1 ELSE source_s END AS source_s, (degree + note_id) % 8 AS degree, CAST(0 AS BIGINT) AS octave, CAST(0 AS BIGINT) AS accidental FROM ({_EVENTS_OF}) AS n WHERE note_id % 7 > 0",
    "deleted_events": f"SELECT DISTINCT event_id FROM ({_EVENTS_OF}) AS n WHERE event_id % 13 = 0",
    "earlier_lyrics": f"SELECT note_id, 1 + note_id % 2 AS verse, 'la' AS text FROM ({_N}) AS n WHERE degree > 0",
    "later_lyrics": f"SELECT note_id + 1000000000 AS note_id, 1 AS verse, 'lo' AS text FROM ({_N}) AS n WHERE note_id % 4 = 0",
}
adapters.TABLES |= {name: "lineitem" for name in ("bar_edits", "clips", "earlier_notes", "later_notes", "deleted_events", "earlier_lyrics", "later_lyrics")}
