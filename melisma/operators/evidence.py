"""Chord labels, key votes, lyric placement, edits and windows: evidence composed from the canonical tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import KEY_NAMES, MAJOR, MINOR, SCALE, rows
from ..functions.scalars import MIDI, TICKS
from ..plans.sqlop import operator
from .aggregates import PC12, RELIABILITY, VALID

#: Names that shifted labels are spelled with.
SHIFTED = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
#: Marks that stay with the character before them.
MARKS = "，。！？、；：,.!?;:"


def pitch_class(name: str) -> str:
    """Pitch class of a note name with at most one sign, 0 to 11."""
    letter = " ".join(f"WHEN '{n}' THEN {pc}" for n, pc in (("C", 0), ("D", 2), ("E", 4), ("F", 5), ("G", 7), ("A", 9), ("B", 11)))
    return f"((CASE substr({name}, 1, 1) {letter} END + CASE substr({name}, 2, 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 12) % 12)"


def spelled(pc: str) -> str:
    return f"CASE {pc} {' '.join(f'''WHEN {i} THEN '{n}' ''' for i, n in enumerate(SHIFTED))} END"


LABEL = "'^([A-G][#b]?)([^/]*)(/([A-G][#b]?))?$'"
SPLIT = f"x AS (SELECT *, [[find:label|{LABEL}|1]] AS root_name, [[find:label|'^[A-G][#b]?(.*)$'|1]] AS suffix, [[find:label|{LABEL}|2]] AS kind, [[find:label|{LABEL}|4]] AS bass_name FROM {{chords}})"
#: Third, fifth, seventh and extensions of a label above its root; a seventh comes with 7 or with 9, 11, 13 that aren't added.
TONES = f"""{SPLIT}, y AS (SELECT *, {pitch_class('root_name')} AS root, suffix LIKE 'm%' AND suffix NOT LIKE 'maj%' AS minor, (suffix LIKE '%9%' OR suffix LIKE '%11%' OR suffix LIKE '%13%') AS extended FROM x),
z AS (SELECT *, suffix LIKE '%7%' OR (extended AND suffix NOT LIKE '%add%') AS seventh FROM y)"""

labels = operator("chord_labels", "chords", f"""
WITH {TONES}
SELECT measure_id, label, CAST(root AS BIGINT) AS root, suffix, minor, extended, seventh, CAST(CASE WHEN seventh THEN (root + CASE WHEN suffix LIKE 'maj%' THEN 11 ELSE 10 END) % 12 END AS BIGINT) AS seventh_pc,
       concat(CAST(root AS VARCHAR(4)), '-', CAST((root + CASE WHEN suffix = 'dim' OR minor THEN 3 ELSE 4 END) % 12 AS VARCHAR(4)), '-', CAST((root + CASE WHEN suffix = 'dim' THEN 6 ELSE 7 END) % 12 AS VARCHAR(4)),
              CASE WHEN seventh THEN concat('-', CAST((root + CASE WHEN suffix LIKE 'maj%' THEN 11 ELSE 10 END) % 12 AS VARCHAR(4))) ELSE '' END,
              CASE WHEN extended THEN concat('-', CAST((root + 2) % 12 AS VARCHAR(4))) ELSE '' END, CASE WHEN suffix LIKE '%11%' OR suffix LIKE '%13%' THEN concat('-', CAST((root + 5) % 12 AS VARCHAR(4))) ELSE '' END,
              CASE WHEN suffix LIKE '%13%' THEN concat('-', CAST((root + 9) % 12 AS VARCHAR(4))) ELSE '' END) AS pcs
FROM z
""", "SC7: root, suffix, sounding pitch classes, seventh and extensions of a chord label")
transposed = operator("transposed_chords", "chords scores", f"""
WITH {SPLIT}
SELECT x.measure_id, x.label, concat({spelled(f"(({pitch_class('x.root_name')} - s.capo) % 12 + 12) % 12")}, x.kind, CASE WHEN x.bass_name <> '' THEN concat('/', {spelled(f"(({pitch_class('x.bass_name')} - s.capo) % 12 + 12) % 12")}) ELSE '' END) AS shape_label
FROM x JOIN {{scores}} AS s ON s.score_id = x.score_id WHERE x.root_name <> ''
""", "SC8, X32: the label to be fingered at a score's capo, its slash bass moved along")
shares = operator("diatonic_chords", "chords scores", f"""
WITH {TONES}
SELECT z.score_id, count(*) AS chords, round(avg(CASE WHEN (z.root - {pitch_class('s.score_key')} + 12) % 12 IN ({', '.join(map(str, SCALE))}) THEN 1e0 ELSE 0e0 END), 6) AS diatonic,
       round(avg(CASE WHEN z.seventh THEN 1e0 ELSE 0e0 END), 6) AS seventh_share, round(avg(CASE WHEN z.extended THEN 1e0 ELSE 0e0 END), 6) AS extended_share
FROM z JOIN {{scores}} AS s ON s.score_id = z.score_id GROUP BY z.score_id
""", "AG29: shares of diatonic, seventh and extended chords")
capo = operator("recommended_capo", "scores", f"""
WITH d AS (SELECT s.score_id, v.shape, (({pitch_class('s.score_key')} - v.pc) % 12 + 12) % 12 AS up FROM {{scores}} AS s CROSS JOIN (VALUES ('C', 0), ('G', 7)) AS v(shape, pc)),
r AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY up, shape) AS rank FROM d)
SELECT score_id, shape, CAST(CASE WHEN up > 6 THEN up - 12 ELSE up END AS BIGINT) AS capo, rank = 1 AS easiest FROM r
""", "SC9: shift of -5 to 6 half tones for either shape, and the shape that needs the least when none may be lowered")
guitar = operator("concert_pitch_class", "scores", f"""
SELECT score_id, CAST({pitch_class('score_key')} AS BIGINT) AS concert, CAST(({pitch_class('score_key')} + capo) % 12 AS BIGINT) AS fingered FROM {{scores}}
""", "SC5: the sounding pitch class of a key that is meant as it sounds, or as it is fingered at a capo")
anchor = operator("anchor_do", "notes", f"""
SELECT note_id, CAST(((({MIDI}) - CASE degree {' '.join(f'WHEN {i + 1} THEN {v}' for i, v in enumerate(SCALE))} END - accidental) % 12 + 12) % 12 AS BIGINT) AS do_pc FROM {{notes}} WHERE degree > 0
""", "SC5: Do from a note of known degree")
width = operator("lyric_widths", "lines", "SELECT conv_id, turn, CAST(9 * length(text) + 9 * [[count_of:text|'[⺀-￿]']] AS BIGINT) AS width FROM {lines} WHERE text IS NOT NULL", "SC10: 18 for a wide character, 9 for another")
#: White space between words, the wide blank too.
SPACES = " \n\t\r\u00a0\u3000"
tokens = operator("lyric_tokens", "lines", f"""
WITH w AS (SELECT conv_id, turn, [[strip:text|'{SPACES}']] AS text FROM {{lines}} WHERE text IS NOT NULL), t AS (SELECT * FROM w WHERE text <> '')
SELECT conv_id, turn, CASE WHEN [[matches:text|'[{SPACES}]']] THEN [[replace_all:text|'[{SPACES}]+'|'¦']] WHEN [[matches:text|'[㐀-鿿]']] THEN [[tokens_of:text|'.[{MARKS}]*']] ELSE text END AS tokens FROM t
""", "SC11: words, or wide characters with the marks after them, joined by broken bars")
aliases = operator("glyph_digits", "lines", """
WITH g AS (SELECT conv_id, turn, CAST(i AS BIGINT) AS place, substr(text, CAST(i AS INT) + 1, 1) AS glyph FROM (SELECT conv_id, turn, text, length(text) AS n FROM {lines} WHERE length(text) > 0) AS x [[each_below:n|i]])
SELECT conv_id, turn, place, CAST(CASE WHEN glyph = '%' THEN 6 WHEN glyph = 'z' THEN 7 WHEN glyph IN ('i', 'I', 'l', 'L') THEN 1 WHEN glyph BETWEEN '0' AND '7' THEN CAST(glyph AS INT) END AS BIGINT) AS digit
FROM g WHERE glyph IN ('%', 'z', 'i', 'I', 'l', 'L') OR glyph IN ('0', '1', '2', '3', '4', '5', '6', '7')
""", "SC17: digits that look-alike glyphs are read as")
cleaned = operator("clean_lines", "lines", """
WITH r AS (SELECT conv_id, turn, lower(text) AS low, [[replace_all:text|'[gG][uU][iI][tT][aA][rR]'|'吉他']] AS renamed FROM {lines} WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN [[matches:low|'music *163 *[.]? *com']] OR low LIKE '%百度百科%' OR [[matches:low|'https?://']] OR low LIKE '%www.%' THEN NULL ELSE [[letters_of:renamed]] END AS cleaned FROM r
""", "SC13: lines with an address or a source's mark are null, others keep letters, digits and underscores")

#: Chroma of overlapping windows: 12 s every 6 s, with 4 s of sound at least.
WINDOWS = f"""
e AS (SELECT song_id, CAST(floor(start_s / 6e0) AS BIGINT) AS slot, ((CAST(floor(pitch_center + 5e-1) AS BIGINT) % 12) + 12) % 12 AS pc, end_s - start_s AS seconds FROM {{note_events}} WHERE {VALID}),
x AS (SELECT e.song_id, e.slot - d.i AS win, e.pc, e.seconds FROM e CROSS JOIN (VALUES (0), (1)) AS d(i) WHERE e.slot >= d.i),
c AS (SELECT song_id, win, pc, sum(seconds) AS seconds FROM x GROUP BY song_id, win, pc),
v AS (SELECT song_id, win, sum(seconds) AS total FROM c GROUP BY song_id, win HAVING round(sum(seconds), 6) >= 4e0),
w AS (SELECT v.song_id, v.win, v.total, p.pc, coalesce(c.seconds, 0e0) / v.total AS weight FROM v CROSS JOIN {PC12} AS p(pc) LEFT JOIN c ON c.song_id = v.song_id AND c.win = v.win AND c.pc = p.pc)"""
#: Correlation of twelve weights with the profile of each of 24 keys: of {group} columns of table {name}.
KEYS = f"""(SELECT i, v, 'major' AS mode, 0 AS up FROM {rows(MAJOR, 'a', 'i', 'v')} UNION ALL SELECT i, v, 'minor', 3 FROM {rows(MINOR, 'b', 'i', 'v')})"""


def ranked_keys(name: str, group: str) -> str:
    cols = ", ".join(f"q.{g.strip()}" for g in group.split(","))
    return f"""(SELECT {cols}, t.d AS tonic, f.mode, (t.d + f.up) % 12 AS do_pc, round(coalesce(CASE WHEN max(q.weight) - min(q.weight) > 1e-9 THEN covar_pop(q.weight, f.v) / nullif(stddev_pop(q.weight) * stddev_pop(f.v), 0e0) END, 0e0), 6) + 0e0 AS score,
       round(coalesce(sum(CASE WHEN (f.mode = 'major' AND f.i IN (0, 2, 4, 5, 7, 9, 11)) OR (f.mode = 'minor' AND f.i IN (0, 2, 3, 5, 7, 8, 10)) THEN q.weight ELSE 0e0 END) / nullif(sum(q.weight), 0e0), 0e0) + 1e-9, 6) AS scale_energy
       FROM {name} AS q CROSS JOIN {PC12} AS t(d) JOIN {KEYS} AS f ON f.i = (q.pc - t.d + 12) % 12 GROUP BY {cols}, t.d, f.mode, f.up)"""


chroma_windows = operator("chroma_windows", "note_events", f"WITH {WINDOWS.strip()} SELECT song_id, win * 6e0 AS start_s, round(total, 3) AS seconds, CAST(pc AS BIGINT) AS pc, round(weight, 6) AS weight FROM w", "SG5: normalized pitch-class weights of overlapping windows")
candidates = operator("window_key_candidates", "note_events", f"""
WITH {WINDOWS.strip()}, k AS {ranked_keys('w', 'song_id, win')}, r AS (SELECT *, row_number() OVER (PARTITION BY song_id, win ORDER BY score DESC, mode, tonic) AS rank FROM k)
SELECT song_id, win * 6e0 AS start_s, CAST(rank AS BIGINT) AS rank, CAST(tonic AS BIGINT) AS tonic, mode, score FROM r WHERE rank <= 10
""", "K3: ten best candidates of each window")
key_votes = operator("key_ranking", "note_events", f"""
WITH {WINDOWS.strip()}, a AS (SELECT song_id, pc, avg(weight) AS weight FROM w GROUP BY song_id, pc), k AS {ranked_keys('a', 'song_id')},
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, mode, tonic) AS rank, max(score) OVER (PARTITION BY song_id, do_pc) AS do_score FROM k),
l AS (SELECT song_id, do_pc FROM r WHERE rank = 1), kw AS {ranked_keys('w', 'song_id, win')},
b AS (SELECT *, row_number() OVER (PARTITION BY song_id, win ORDER BY score DESC, mode, tonic) AS rank FROM kw),
g AS (SELECT b.song_id, avg(CASE WHEN b.do_pc = l.do_pc THEN 1e0 ELSE 0e0 END) AS agreement FROM b JOIN l ON l.song_id = b.song_id WHERE b.rank = 1 GROUP BY b.song_id),
s AS (SELECT song_id, count(CASE WHEN round(weight, 9) >= 55e-3 THEN 1 END) AS support FROM a GROUP BY song_id), f AS (SELECT song_id, sum(seconds) AS seconds FROM e GROUP BY song_id)
SELECT r.song_id, CAST(r.rank AS BIGINT) AS rank, CAST(r.tonic AS BIGINT) AS tonic, n.name AS tonic_name, r.mode, CAST(r.do_pc AS BIGINT) AS do_pc, r.score, r.scale_energy, round(g.agreement, 6) AS agreement, s.support, s.support >= 3 AND round(f.seconds, 6) >= 6e0 AS suggested
FROM r JOIN g ON g.song_id = r.song_id JOIN s ON s.song_id = r.song_id JOIN f ON f.song_id = r.song_id JOIN {rows(KEY_NAMES, 'n', 'pc', 'name')} ON n.pc = r.tonic
""", "AG8, AG10: 24 keys by profile correlation, the share of windows that agree on Do, and whether the evidence suffices")
alternatives = operator("close_alternatives", "note_events", f"""
WITH {WINDOWS.strip()}, k AS {ranked_keys('w', 'song_id, win')}, r AS (SELECT *, max(score) OVER (PARTITION BY song_id, win) AS best, row_number() OVER (PARTITION BY song_id, win ORDER BY score DESC, mode, tonic) AS place FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY song_id, win, tonic ORDER BY score DESC, mode) AS of_label FROM r WHERE place > 1 AND round(best - score, 9) <= 12e-2 AND scale_energy >= 5e-1),
t AS (SELECT *, row_number() OVER (PARTITION BY song_id, win ORDER BY score DESC, tonic) AS rank FROM u WHERE of_label = 1)
SELECT song_id, win * 6e0 AS start_s, CAST(tonic AS BIGINT) AS label, round(best - score, 6) AS score_gap, scale_energy AS support, CAST(rank AS BIGINT) AS rank FROM t WHERE rank <= 2
""", "K2: at most two other labels within .12 of the best with half of the support")
modulation = operator("early_late_keys", "note_events", f"""
WITH span AS (SELECT song_id, min(start_s) AS a, max(end_s) AS b FROM {{note_events}} GROUP BY song_id),
e AS (SELECT e.song_id, p.part, ((CAST(floor(e.pitch_center + 5e-1) AS BIGINT) % 12) + 12) % 12 AS pc, (e.end_s - e.start_s) * least(1e0, {RELIABILITY}) AS weight
  FROM {{note_events}} AS e JOIN span AS s ON s.song_id = e.song_id CROSS JOIN (VALUES ('early'), ('late')) AS p(part)
  WHERE {VALID} AND ((p.part = 'early' AND e.start_s < s.a + (s.b - s.a) * 5e-1) OR (p.part = 'late' AND e.start_s >= s.a + (s.b - s.a) * 2 / 3))),
g AS (SELECT song_id, part, pc, sum(weight) AS weight FROM e GROUP BY song_id, part, pc), n AS (SELECT song_id, part, sum(weight) AS seconds FROM g GROUP BY song_id, part),
h AS (SELECT n.song_id, n.part, n.seconds, q.pc, coalesce(g.weight, 0e0) AS weight FROM n CROSS JOIN {PC12} AS q(pc) LEFT JOIN g ON g.song_id = n.song_id AND g.part = n.part AND g.pc = q.pc),
s AS (SELECT h.song_id, h.part, h.seconds, d.d, sum(CASE WHEN (h.pc - d.d + 12) % 12 IN ({', '.join(map(str, SCALE))}) THEN h.weight ELSE 0e0 END) / h.seconds AS inside, sum(CASE WHEN h.pc = d.d THEN h.weight WHEN h.pc = (d.d + 9) % 12 THEN 8e-1 * h.weight ELSE 0e0 END) / h.seconds AS tonic,
  greatest(coalesce(CASE WHEN max(h.weight) - min(h.weight) > 1e-9 THEN covar_pop(h.weight, ma.v) / nullif(stddev_pop(h.weight) * stddev_pop(ma.v), 0e0) END, 0e0), coalesce(CASE WHEN max(h.weight) - min(h.weight) > 1e-9 THEN covar_pop(h.weight, mi.v) / nullif(stddev_pop(h.weight) * stddev_pop(mi.v), 0e0) END, 0e0)) AS profile
  FROM h CROSS JOIN {PC12} AS d(d) JOIN {rows(MAJOR, 'ma', 'i', 'v')} ON ma.i = (h.pc - d.d + 12) % 12 JOIN {rows(MINOR, 'mi', 'i', 'v')} ON mi.i = (h.pc - d.d + 15) % 12 GROUP BY h.song_id, h.part, h.seconds, d.d),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id, part ORDER BY round(65e-2 * inside + 25e-2 * (profile + 1) / 2 + 1e-1 * tonic, 6) DESC, d) AS rank FROM s)
SELECT x.song_id, CAST(x.d AS BIGINT) AS early_do, CAST(y.d AS BIGINT) AS late_do, x.seconds >= 4 AND y.seconds >= 4 AND x.d <> y.d AS suspected
FROM r AS x JOIN r AS y ON x.song_id = y.song_id AND x.part = 'early' AND y.part = 'late' AND x.rank = 1 AND y.rank = 1
""", "AG6: best Do of the first half and of the last third by the distribution alone; a change is suspected where both have 4 s of sound")
measured = operator("measured_note", "note_events", """
WITH b AS (SELECT song_id, CAST(floor(pitch_center + 5e-1) AS BIGINT) AS midi, round(sum(greatest(confidence, 1e-2)), 6) AS weight, count(*) AS n FROM {note_events} WHERE NOT uncertain GROUP BY 1, 2),
r AS (SELECT *, sum(weight) OVER (PARTITION BY song_id) AS total, row_number() OVER (PARTITION BY song_id ORDER BY weight DESC, midi) AS rank FROM b), t AS (SELECT * FROM r WHERE rank = 1),
c AS (SELECT song_id, avg(CASE WHEN NOT uncertain THEN 1e0 ELSE 0e0 END) AS coverage, avg(CASE WHEN NOT uncertain THEN confidence END) AS probability FROM {note_events} GROUP BY song_id),
o AS (SELECT e.song_id, t.midi, e.pitch_center, median(e.pitch_center) OVER (PARTITION BY e.song_id) AS center FROM {note_events} AS e JOIN t ON t.song_id = e.song_id AND CAST(floor(e.pitch_center + 5e-1) AS BIGINT) = t.midi WHERE NOT e.uncertain),
d AS (SELECT song_id, median(abs(pitch_center - center)) * 100 AS spread FROM o GROUP BY song_id)
SELECT t.song_id, t.midi, t.n, round(t.weight / t.total, 6) AS purity, round(d.spread, 4) AS mad_cents, round(c.coverage, 6) AS coverage,
       round(c.coverage, 9) >= 55e-2 AND round(t.weight / t.total, 9) >= 75e-2 AND round(d.spread, 6) <= 30 AND round(c.probability, 9) >= 5e-1 AND t.n >= 5 AS reliable
FROM t JOIN c ON c.song_id = t.song_id JOIN d ON d.song_id = t.song_id
""", "AG17: weighted mode, purity, median deviation and coverage of a note, and whether all suffice")
bar_fit = operator("manual_bar_fit", "note_events", """
WITH b AS (SELECT song_id, event_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) - 1 AS DOUBLE) AS bar, start_s AS t FROM {note_events} WHERE event_id % 2 = 0),
f AS (SELECT song_id, count(*) AS bars, regr_slope(t, bar) AS bar_s, regr_intercept(t, bar) AS anchor_s FROM b GROUP BY song_id HAVING count(*) >= 2),
x AS (SELECT f.song_id, max(abs(b.t - (f.anchor_s + b.bar * f.bar_s))) AS err FROM b JOIN f ON f.song_id = b.song_id GROUP BY f.song_id)
SELECT f.song_id, f.bars, round(f.bar_s, 5) AS bar_s, round(f.anchor_s, 4) AS anchor_s, round(24e1 / f.bar_s, 3) AS bpm, round(x.err, 4) AS error_s,
       CASE WHEN round(24e1 / f.bar_s, 6) < 40 OR round(24e1 / f.bar_s, 6) > 240 THEN 'tempo' WHEN round(x.err, 6) > greatest(12e-2, 6e-2 * f.bar_s) THEN 'uneven' ELSE 'accepted' END AS decision FROM f JOIN x ON x.song_id = f.song_id
""", "AG18: bar length, anchor and tempo by regression over marked bars of four beats; rejected beyond 40 to 240 bpm or where a mark is off by more than .12 s and 6 % of a bar")
gap_votes = operator("gap_pitch_votes", "note_events song_keys", f"""
WITH g AS (SELECT song_id, event_id, end_s AS a, lead(start_s) OVER (PARTITION BY song_id ORDER BY start_s, event_id) AS b FROM {{note_events}} WHERE NOT uncertain),
p AS (SELECT *, CAST(floor(a / 2e0) AS BIGINT) AS first_slot, CAST(floor(b / 2e0) AS BIGINT) - CAST(floor(a / 2e0) AS BIGINT) + 1 AS slots FROM g WHERE round(b - a, 9) >= 8e-2),
q AS (SELECT song_id, event_id, a, b, first_slot + i AS slot FROM p [[each_below:slots|i]]),
v AS (SELECT q.song_id, q.event_id, e.midi, count(*) AS n, round(sum(e.confidence), 6) AS weight FROM q JOIN {{song_keys}} AS k ON k.song_id = q.song_id JOIN {{note_events}} AS e ON e.song_id = q.song_id AND CAST(floor(e.start_s / 2e0) AS BIGINT) = q.slot AND e.start_s >= q.a AND e.start_s < q.b
  WHERE e.uncertain AND e.confidence >= 35e-2 AND (((e.midi - k.do_pc) % 12) + 12) % 12 IN ({', '.join(map(str, SCALE))}) GROUP BY q.song_id, q.event_id, e.midi),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id, event_id ORDER BY weight DESC, midi) AS rank FROM v WHERE n >= 2)
SELECT song_id, event_id, midi, n, weight FROM r WHERE rank = 1
""", "AG28: pitch of a gap by weighted votes of uncertain frames in it, of two at least, degrees of the song's own key alone")

#: Nearest note of each character within 1.2 s of its middle, by slots of 4 s: the distance to the note's span, the earliest on a tie.
PLACED_CHARS = """
n AS (SELECT song_id, event_id, start_s, end_s, CAST(floor((start_s - 12e-1) / 4e0) AS BIGINT) AS first_slot, CAST(floor((end_s + 12e-1) / 4e0) AS BIGINT) - CAST(floor((start_s - 12e-1) / 4e0) AS BIGINT) + 1 AS slots FROM {note_events}),
s AS (SELECT song_id, event_id, start_s, end_s, first_slot + i AS slot FROM n [[each_below:slots|i]]),
c AS (SELECT *, round((start_s + end_s) / 2, 6) AS t, CAST(floor(round((start_s + end_s) / 2, 6) / 4e0) AS BIGINT) AS slot FROM {characters}),
m AS (SELECT c.song_id, c.char_id, c.text, c.t, s.event_id, s.start_s, round(greatest(0e0, s.start_s - c.t, c.t - s.end_s), 6) AS gap FROM c JOIN s ON s.song_id = c.song_id AND s.slot = c.slot),
a AS (SELECT *, row_number() OVER (PARTITION BY song_id, char_id ORDER BY gap, start_s, event_id) AS rank FROM m WHERE gap <= 12e-1)"""
placed = operator("timed_lyrics", "note_events characters", f"""
WITH {PLACED_CHARS.strip()}
SELECT song_id, event_id, count(*) AS characters, [[joined_by:text|t, char_id]] AS text FROM a WHERE rank = 1 GROUP BY song_id, event_id
""", "J6, X11: characters go to the nearest note within 1.2 s, and stand there in order")
unplaced = operator("unplaced_characters", "note_events characters", f"""
WITH {PLACED_CHARS.strip()} SELECT c.song_id, c.char_id, c.text FROM c LEFT JOIN a ON a.song_id = c.song_id AND a.char_id = c.char_id AND a.rank = 1 WHERE a.char_id IS NULL
""", "X11: characters that no note is near enough for")
preserved = operator("preserved_manual_lyrics", "characters", """
WITH m AS (SELECT * FROM {characters} WHERE manual), o AS (SELECT * FROM {characters} WHERE NOT manual),
d AS (SELECT m.char_id AS manual_id, o.char_id, round(abs(o.start_s - m.start_s), 6) AS distance FROM m JOIN o ON o.song_id = m.song_id AND o.text = m.text AND CAST(floor(o.start_s / 5e0) AS BIGINT) BETWEEN CAST(floor(m.start_s / 5e0) AS BIGINT) - 1 AND CAST(floor(m.start_s / 5e0) AS BIGINT) + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY manual_id ORDER BY distance, char_id) AS rank FROM d WHERE distance < 5e0), gone AS (SELECT DISTINCT char_id FROM r WHERE rank = 1)
SELECT c.song_id, c.char_id, c.text, c.manual FROM {characters} AS c LEFT JOIN gone ON gone.char_id = c.char_id WHERE c.manual OR gone.char_id IS NULL
""", "X14, X13: manual characters stay, and the nearest equal one within 5 s goes")
kept_places = operator("kept_placements", "characters", """
WITH prior AS (SELECT char_id, text, char_id % 50 AS note_id, manual FROM {characters} WHERE char_id % 3 > 0), fresh AS (SELECT song_id, char_id, CASE WHEN char_id % 10 = 0 THEN '新' ELSE text END AS text FROM {characters})
SELECT f.song_id, f.char_id, f.text, p.note_id AS placed_at FROM fresh AS f LEFT JOIN prior AS p ON p.char_id = f.char_id AND p.text = f.text AND p.manual
""", "X12: a character keeps its manual place when a rerun gives the same id and text")
uncovered = operator("uncovered_events", "note_events characters", """
WITH l AS (SELECT song_id, line_id, min(start_s) AS a, max(end_s) AS b FROM {characters} WHERE line_id % 2 = 0 GROUP BY song_id, line_id),
p AS (SELECT *, CAST(floor(a / 4e0) AS BIGINT) AS first_slot, CAST(floor(b / 4e0) AS BIGINT) - CAST(floor(a / 4e0) AS BIGINT) + 1 AS slots FROM l), s AS (SELECT song_id, a, b, first_slot + i AS slot FROM p [[each_below:slots|i]]),
e AS (SELECT song_id, event_id, (start_s + end_s) / 2 AS t FROM {note_events})
SELECT e.song_id, e.event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.song_id = e.song_id AND s.slot = CAST(floor(e.t / 4e0) AS BIGINT) AND e.t >= s.a AND e.t < s.b)
""", "J10: events whose middle lies in no line, by slots of 4 s")
melisma_ends = operator("tie_chain_ends", "notes", """
WITH c AS (SELECT score_id, note_id, m_idx, n_idx, CASE WHEN coalesce(lag(tie) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx), FALSE) THEN 0 ELSE 1 END AS fresh FROM {notes}),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS chain FROM c)
SELECT score_id, note_id, last_value(note_id) OVER (PARTITION BY score_id, chain ORDER BY m_idx, n_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_note_id FROM g
""", "X10: the note on which a chain of ties ends")
INTRO = f"""
p AS (SELECT score_id, source_s, m_idx, n_idx, sum({TICKS}) OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) - {TICKS} AS elapsed FROM {{notes}}),
f AS (SELECT score_id, source_s, elapsed, row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS rank FROM p WHERE source_s IS NOT NULL),
z AS (SELECT f.score_id, round(f.source_s - f.elapsed * 60e0 / s.bpm / 16, 6) AS end_s, 60e0 / s.bpm * s.meter AS bar_s, s.meter FROM f JOIN {{scores}} AS s ON s.score_id = f.score_id WHERE f.rank = 1)"""
intro_range = operator("zero_intro_range", "notes scores", f"WITH {INTRO.strip()} SELECT score_id, end_s, end_s > 0 AS usable FROM z", "X23: where the first timed note's measure begins in the recording, counted back from that note")
intro = operator("zero_intro_measures", "notes scores", f"""
WITH {INTRO.strip()}, k AS (SELECT score_id, end_s, meter, CAST(greatest(1, floor(end_s / bar_s + 5e-1)) AS BIGINT) AS bars FROM z WHERE end_s > 0),
m AS (SELECT score_id, end_s, meter, bars, CAST(i AS BIGINT) AS bar FROM k [[each_below:bars|i]]), b AS (SELECT score_id, end_s, meter, bars, bar, CAST(j AS BIGINT) AS beat FROM m [[each_below:meter|j]])
SELECT score_id, bar, beat, round(end_s * (bar + beat * 1e0 / meter) / bars, 5) AS start_s, round(end_s * (bar + (beat + 1) * 1e0 / meter) / bars, 5) AS end_s FROM b
""", "U3: measures of rests, a beat each, that fill the time before the first one")
distinct_ids = operator("distinct_anchors", "notes", f"SELECT score_id, count(DISTINCT degree) AS degrees, count(DISTINCT {MIDI}) AS pitches, count(*) AS anchors FROM {{notes}} WHERE degree > 0 GROUP BY score_id", "U4: distinct degrees and pitches of a score's anchors")
projects = operator("project_list", "library", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY revision DESC) AS latest FROM {library} WHERE title IS NOT NULL AND audio_offset IS NOT NULL),
p AS (SELECT project_id, revision, title, published_at, coalesce(CAST(published_at AS DATE), DATE '0001-01-01') AS day FROM r WHERE latest = 1),
d AS (SELECT day, coalesce(sum(count(*)) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM p GROUP BY day)
SELECT p.project_id, p.revision, p.title, p.published_at, CAST(row_number() OVER (PARTITION BY p.project_id % 64 ORDER BY p.revision DESC, p.project_id) AS BIGINT) AS place,
       CAST(d.later + row_number() OVER (PARTITION BY p.day ORDER BY p.published_at DESC NULLS LAST, p.project_id) AS BIGINT) AS list_place FROM p JOIN d ON d.day = p.day
""", "IO10: each project's latest readable record; its place on its shelf, the most changed first, and in the whole list, the latest changed first, by days and within them")
mono = operator("mono_channels", "note_events", """
WITH s AS (SELECT song_id, pitch_center - 6e1 AS left_x, CASE WHEN song_id % 3 = 0 THEN 59e0 - pitch_center ELSE midi - 6e1 END AS right_x FROM {note_events}),
a AS (SELECT song_id, sqrt(avg(left_x * left_x)) AS left_rms, sqrt(avg(right_x * right_x)) AS right_rms, sqrt(avg((left_x + right_x) * (left_x + right_x) / 4)) AS mixed FROM s GROUP BY song_id)
SELECT song_id, round(mixed / greatest(left_rms, right_rms, 1e-9), 6) AS phase_ratio, CASE WHEN round(mixed / greatest(left_rms, right_rms, 1e-9), 9) >= 35e-2 THEN 'mean' WHEN round(left_rms - right_rms, 9) >= 0 THEN 'channel-0' ELSE 'channel-1' END AS channel FROM a
""", "SG12: the mean of two channels, or the louder one where they cancel each other")


def listed(library: DataFrame) -> DataFrame:
    """IO10: the projects of `library`, the latest changed first; unreadable records are left out."""
    return projects(library).orderBy(F.desc("published_at"), "project_id")
