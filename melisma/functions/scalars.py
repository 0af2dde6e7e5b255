"""Row-wise notation and pitch functions."""

from ..plans.sqlop import operator
from .fixed import KEY_NAMES, SCALE, rows

TICKS = "64e0 / base * (CASE WHEN dots = 1 THEN 15e-1 ELSE 1e0 END)"
#: MIDI of a written note with Do at 60; null for a rest.
MIDI = f"CASE WHEN degree > 0 THEN 60 + CASE degree {' '.join(f'WHEN {i + 1} THEN {v}' for i, v in enumerate(SCALE))} END + 12 * octave + accidental END"

note_ticks = operator("note_ticks", "notes", f"SELECT note_id, {TICKS} AS ticks FROM {{notes}}", "SC1: length of a note, a whole note being 64")
note_midi = operator("note_midi", "notes", f"SELECT note_id, CAST({MIDI} AS BIGINT) AS midi FROM {{notes}} WHERE degree > 0", "SC4: degree to MIDI")
midi_degree = operator("midi_degree", "note_events", f"""
WITH d AS (SELECT event_id, midi - 60 AS distance, ((midi - 60) % 12 + 12) % 12 AS pc FROM {{note_events}})
SELECT d.event_id, CAST(coalesce(s.i + 1, u.i + 1) AS BIGINT) AS degree, CAST(floor(d.distance / 12) AS BIGINT) AS octave, CASE WHEN s.i IS NULL THEN 1 ELSE 0 END AS accidental
FROM d LEFT JOIN {rows(SCALE, 's', 'i', 'v')} ON s.v = d.pc LEFT JOIN {rows(SCALE, 'u', 'i', 'v')} ON u.v = d.pc - 1
""", "SC4: MIDI to degree, sharps for notes outside the scale")
pitch_label = operator("pitch_label", "note_events", f"""
SELECT e.event_id, concat(k.name, CAST(CAST(floor(e.midi / 12) AS BIGINT) - 1 AS VARCHAR(8))) AS label, round(440e0 * power(2e0, (e.midi - 69) / 12e0), 6) AS hz,
       round(69 + 12 * log2(440e0 * power(2e0, (e.midi - 69) / 12e0) / 440e0), 6) AS midi_again
FROM {{note_events}} AS e JOIN {rows(KEY_NAMES, 'k', 'pc', 'name')} ON k.pc = ((e.midi % 12) + 12) % 12
""", "SC2, SC3, SC6: pitch class, name and frequency")
clock_label = operator("clock_label", "note_events", """
SELECT event_id, concat(lpad(CAST(CAST(floor(t / 60) AS BIGINT) AS VARCHAR(12)), 2, '0'), ':', lpad(CAST(CAST(floor(t) AS BIGINT) % 60 AS VARCHAR(4)), 2, '0')) AS clock
FROM (SELECT event_id, start_s - min(start_s) OVER (PARTITION BY song_id) AS t FROM {note_events}) AS e
""", "SC6: mm:ss since the song's first event")
envelope = operator("peak_envelope", "note_events", """
SELECT song_id, bucket, min(pitch_center) AS low, max(pitch_center) AS high, count(*) AS n
FROM (SELECT song_id, pitch_center, CAST(floor((row_number() OVER (PARTITION BY song_id ORDER BY start_s, event_id) - 1) / 64) AS BIGINT) AS bucket FROM {note_events}) AS e
GROUP BY song_id, bucket
""", "SC19: least and largest value of every 64 samples")
line_words = operator("line_word_counts", "lines", """
SELECT conv_id, turn, CAST([[length_of:[[words:text]]]] AS BIGINT) AS n_words FROM {lines} WHERE text IS NOT NULL AND trim(text) <> ''
""".replace("[[length_of:[[words:text]]]]", "[[word_count:text]]"), "SC11: words of a line")
