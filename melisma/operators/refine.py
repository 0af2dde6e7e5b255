"""Second thoughts about written pitches and syllables: slides, weak pitches, crests for review, auditions, and lyrics moved along."""

from ..functions.fixed import SCALE
from ..plans.sqlop import operator
from ..sources import adapters
from .cores import STEP, crests

_DEGREES = ", ".join(map(str, SCALE))
_IN_KEY = lambda midi: f"((({midi}) - do_pc) % 12 + 12) % 12 IN ({_DEGREES})"
corrections = operator("pitch_corrections", "crest_events frames_of_cores song_keys", f"""
WITH e AS (SELECT x.*, k.do_pc, lead(midi) OVER w AS next_midi, lead(a) OVER w AS next_a, lead(core_a) OVER w AS next_core_a, lead(core_b) OVER w AS next_core_b, lead(uncertain) OVER w AS next_uncertain, lead(crest) OVER w AS next_crest,
                  sum(CASE WHEN NOT uncertain AND core_a IS NOT NULL AND (core_b - core_a) * {STEP} >= 16e-2 - 1e-9 AND abs(center - midi) < 2e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY x.song_id, midi) - CASE WHEN NOT uncertain AND core_a IS NOT NULL AND (core_b - core_a) * {STEP} >= 16e-2 - 1e-9 AND abs(center - midi) < 2e-1 THEN 1 ELSE 0 END AS repeats
           FROM {{crest_events}} AS x JOIN {{song_keys}} AS k ON k.song_id = x.song_id WINDOW w AS (PARTITION BY x.song_id ORDER BY a, b)),
o AS (SELECT * FROM e WHERE NOT ({_IN_KEY("midi")}) AND center IS NOT NULL),
c AS (SELECT *, next_core_a - a + 2 AS reach FROM o WHERE {_IN_KEY("next_midi")} AND abs(next_midi - midi) = 1 AND NOT crest AND NOT next_crest AND NOT next_uncertain AND (b - a) * {STEP} <= 12e-2 + 1e-9 AND next_a >= b AND (next_a - b) * {STEP} <= 96e-3 + 1e-9 AND (next_core_b - next_core_a) * {STEP} >= 16e-2 - 1e-9),
x AS (SELECT c.song_id, c.a, c.next_core_a, c.next_midi - c.midi AS way, c.a + d AS i FROM c [[each_below:reach|d]]),
p AS (SELECT x.*, f.pitch, x.i - lag(x.i) OVER v AS gap, f.pitch - lag(f.pitch) OVER v AS step, first_value(f.pitch) OVER v AS begun FROM x JOIN {{frames_of_cores}} AS f ON f.song_id = x.song_id AND f.i = x.i WHERE f.pitch IS NOT NULL WINDOW v AS (PARTITION BY x.song_id, x.a ORDER BY x.i)),
s AS (SELECT song_id, a FROM p GROUP BY song_id, a HAVING count(*) >= 3 AND (min(i) - a) * {STEP} <= 5e-2 AND (max(next_core_a) - max(i)) * {STEP} <= 5e-2 AND coalesce(max(gap), 0) * {STEP} <= 65e-3 AND max(CASE WHEN abs(step) > least(15e-1, 40 * gap * {STEP}) THEN 1 ELSE 0 END) = 0
      AND sum(greatest(0e0, -way * coalesce(step, 0e0))) <= 4e-1 AND sum(way * coalesce(step, 0e0)) >= 7e-1),
w AS (SELECT o.*, s.a IS NOT NULL AS slides, CASE WHEN {_IN_KEY("midi - 1")} THEN abs(midi - 1 - center) END AS below, CASE WHEN {_IN_KEY("midi + 1")} THEN abs(midi + 1 - center) END AS above,
             uncertain OR coalesce((core_b - core_a) * {STEP}, 0e0) < 12e-2 - 1e-9 OR abs(center - midi) > 28e-2 OR coalesce(spread, 0e0) > 25 AS weak FROM o LEFT JOIN s ON s.song_id = o.song_id AND s.a = o.a)
SELECT song_id, a, midi AS original_midi, CASE WHEN slides THEN next_midi WHEN above IS NULL OR below <= above THEN midi - 1 ELSE midi + 1 END AS target_midi, CASE WHEN slides THEN 'slide-to-stable-diatonic' ELSE 'weak-pitch-diatonic-prior' END AS reason, CASE WHEN slides THEN next_a END AS destination_a
FROM w WHERE slides OR weak AND least(coalesce(below, 99e0), coalesce(above, 99e0)) <= 85e-2 AND (below IS NULL OR above IS NULL OR round(abs(below - above), 9) >= 2e-1) AND repeats < 2
""", "W14, W15: a note outside the key that slides in one way to a stable one beside it, or a weak one nearer to one degree than to another, is proposed as that; two stable repeats of it are stronger than the key")

peaks = operator("slide_peaks", "core_events frames_of_cores", crests.text[: crests.text.index("k AS (SELECT")].rstrip() + """
n AS (SELECT song_id, a, core_a, max(b) OVER (PARTITION BY song_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_b, lead(a) OVER (PARTITION BY song_id ORDER BY a, b) AS after_a FROM {core_events})
SELECT m.song_id, m.event_a, m.lo AS peak_from, least(m.cut, n.core_a) AS peak_to, CAST(floor(m.top + 5e-1) AS BIGINT) AS midi, round((m.top - m.center) * 100, 1) AS prominence_cents, m.near_frames FROM m JOIN n ON n.song_id = m.song_id AND n.a = m.event_a
WHERE CAST(floor(m.top + 5e-1) AS BIGINT) <> m.midi AND coalesce(n.before_b <= m.lo, true) AND coalesce(n.after_a >= least(m.cut, n.core_a), true)
""", "W16: a rise and fall before a certain core, of three frames near its peak, is shown for review where no other note stands; no note is made of it")

audition = operator("audition_timeline", "note_events fragments auditions", """
WITH f AS (SELECT song_id, event_id, note_id, ticks, sum(ticks) OVER (PARTITION BY song_id, event_id ORDER BY place) - ticks AS before, sum(ticks) OVER (PARTITION BY song_id, event_id) AS total FROM {fragments}),
m AS (SELECT e.song_id, f.note_id, e.midi, e.start_s + (e.end_s - e.start_s) * f.before / f.total AS a, e.start_s + (e.end_s - e.start_s) * (f.before + f.ticks) / f.total AS b, s.from_s FROM {note_events} AS e JOIN {auditions} AS s ON s.song_id = e.song_id JOIN f ON f.song_id = e.song_id AND f.event_id = e.event_id WHERE e.end_s > s.from_s)
SELECT e.song_id, 'event' AS kind, e.event_id AS id, e.midi, round(greatest(0e0, e.start_s - s.from_s), 4) AS start_s, round(e.end_s - s.from_s, 4) AS end_s FROM {note_events} AS e JOIN {auditions} AS s ON s.song_id = e.song_id WHERE e.end_s > s.from_s
UNION ALL SELECT song_id, 'mark', note_id, midi, round(greatest(0e0, a - from_s), 4), round(b - from_s, 4) FROM m WHERE b > from_s
""", "J14, X5: detected events from a moment on, and their score fragments, which share an event's real time by written ticks; events without fragments stay")

tails = operator("moved_lyric_tails", "placed_lyrics notes tail_moves", """
WITH o AS (SELECT note_id, score_id, m_idx, row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS place FROM {notes}),
l AS (SELECT p.*, o.m_idx, o.place FROM {placed_lyrics} AS p JOIN o ON o.note_id = p.note_id),
t AS (SELECT v.score_id, v.seq, v.verse, v.delta, v.first_m, v.last_m, l.place FROM {tail_moves} AS v LEFT JOIN l ON l.note_id = v.note_id AND l.verse = v.verse),
m AS (SELECT l.note_id, l.verse, t.seq, l.offset_x + t.delta AS moved, max(abs(l.offset_x + t.delta)) OVER (PARTITION BY t.score_id, t.seq) AS farthest FROM t JOIN l ON l.score_id = t.score_id AND l.verse = t.verse AND l.place >= t.place AND l.m_idx BETWEEN t.first_m AND t.last_m)
SELECT l.score_id, l.note_id, l.verse, CASE WHEN m.farthest <= 2000 THEN round(m.moved, 1) ELSE l.offset_x END AS offset_x, CASE WHEN m.farthest > 2000 THEN 'too far' WHEN m.seq IS NOT NULL THEN 'moved' ELSE 'stays' END AS state FROM l LEFT JOIN m ON m.note_id = l.note_id AND m.verse = l.verse
""", "ED4: a syllable and those after it in its row shift together; a move of which one would go too far leaves all")

relocated = operator("relocated_lyrics", "placed_lyrics notes relocations", """
WITH o AS (SELECT note_id, score_id, m_idx, degree, coalesce(lag(tie) OVER w, false) AS held, row_number() OVER w AS place FROM {notes} WINDOW w AS (PARTITION BY score_id ORDER BY m_idx, n_idx))[[stored:o|*]],
l AS (SELECT[[merged:o]] p.*, o.m_idx, o.place FROM {placed_lyrics} AS p JOIN o ON o.note_id = p.note_id)[[stored:l|score_id, note_id, verse, text, m_idx, place]],
v AS (SELECT[[merged:l, o]] r.score_id, r.verse, r.target_id, r.first_m, r.last_m, l.place AS from_place, o.place AS to_place FROM {relocations} AS r JOIN l ON l.note_id = r.note_id AND l.verse = r.verse JOIN o ON o.note_id = r.target_id AND o.degree > 0 WHERE r.note_id <> r.target_id)[[stored:v|*]],
q AS (SELECT[[merged:v]] l.score_id, l.note_id, l.verse, l.text, v.target_id, CASE WHEN l.place >= v.from_place AND l.m_idx BETWEEN v.first_m AND v.last_m THEN 0 WHEN l.place >= v.to_place THEN 1 END AS part, l.place FROM l JOIN v ON v.score_id = l.score_id AND v.verse = l.verse),
k AS (SELECT score_id, note_id, verse, text, row_number() OVER (PARTITION BY score_id, verse ORDER BY part, place) AS k, count(*) OVER (PARTITION BY score_id, verse) AS n FROM q WHERE part IS NOT NULL)[[stored:k|*]],
t AS (SELECT[[merged:v, l]] o.score_id, v.verse, o.note_id, row_number() OVER (PARTITION BY o.score_id, v.verse ORDER BY o.place) AS k, count(*) OVER (PARTITION BY o.score_id, v.verse) AS n FROM o JOIN v ON v.score_id = o.score_id LEFT JOIN l ON l.note_id = o.note_id AND l.verse = v.verse WHERE o.place >= v.to_place AND o.degree > 0 AND (NOT o.held OR o.note_id = v.target_id OR l.note_id IS NOT NULL))[[stored:t|*]],
w AS (SELECT[[merged:f, t]] k.score_id, k.note_id, k.verse, k.text, t.note_id AS new_id, k.n <= f.n AS fits FROM k JOIN (SELECT DISTINCT score_id, verse, n FROM t) AS f ON f.score_id = k.score_id AND f.verse = k.verse LEFT JOIN t ON t.score_id = k.score_id AND t.verse = k.verse AND t.k = k.k)
SELECT[[merged:w]] l.score_id, l.note_id AS old_id, l.verse, l.text, CASE WHEN w.fits THEN w.new_id ELSE l.note_id END AS note_id, CASE WHEN w.fits THEN 'moved' WHEN NOT w.fits THEN 'no room' ELSE 'stays' END AS state FROM l LEFT JOIN w ON w.note_id = l.note_id AND w.verse = l.verse
""", "ED4: a syllable and those after it in its row stand before all that were sung from the target on, which make room; without notes enough nothing moves")

_N = adapters.VIEWS["notes"]
_LYRICS = f"SELECT score_id, note_id, 1 + v AS verse, concat('la', CAST(note_id % 7 AS VARCHAR(2))) AS text, (note_id % 9 - 4) * 4e2 AS offset_x, m_idx FROM ({_N}) AS n CROSS JOIN (VALUES (0), (1)) AS d(v) WHERE degree > 0 AND (note_id + v) % 5 > 1"
adapters.VIEWS |= {
    "fragments": "SELECT user_id AS song_id, event_id, event_id * 10 + k AS note_id, k AS place, 4e0 + (event_id + k) % 5 AS ticks FROM {events} CROSS JOIN (VALUES (0), (1), (2)) AS d(k) WHERE k <= event_id % 4",
    "auditions": "SELECT DISTINCT user_id AS song_id, user_id % 9 * 15e-1 AS from_s FROM {events}",
    "placed_lyrics": f"SELECT score_id, note_id, verse, text, offset_x FROM ({_LYRICS}) AS l",
    "tail_moves": f"SELECT score_id, min(note_id) AS seq, min(note_id) AS note_id, verse, 2e1 + score_id % 3 * 4e2 AS delta, 4 AS first_m, 7 AS last_m FROM ({_LYRICS}) AS l WHERE m_idx BETWEEN 4 AND 7 AND verse = 1 GROUP BY score_id, verse",
    "relocations": f"SELECT score_id, min(CASE WHEN m_idx BETWEEN 4 AND 7 THEN note_id END) AS note_id, verse, CASE WHEN score_id % 4 = 0 THEN max(note_id) ELSE min(CASE WHEN m_idx > 8 THEN note_id END) END AS target_id, 4 AS first_m, 7 AS last_m FROM ({_LYRICS}) AS l WHERE verse = 1 GROUP BY score_id, verse",
}
adapters.TABLES |= {"fragments": "events", "auditions": "events", "placed_lyrics": "lineitem", "tail_moves": "lineitem", "relocations": "lineitem"}
