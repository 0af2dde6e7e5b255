"""Timelines of a score: as written, with ties and grace notes; as recorded, with rests and what was never sung; and MIDI files of them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MIDI, TICKS
from ..plans.sqlop import operator
from ..sources import adapters

#: Where each note stands as written: measures keep their silent rest, missing ones their whole length.
_WRITTEN = f"""
WITH m AS (SELECT n.score_id, n.m_idx, coalesce(max(n.manual_ticks), max(s.meter) * 16) AS length, max(s.meter) * 16 AS capacity FROM {{played_notes}} AS n JOIN {{plays}} AS s ON s.score_id = n.score_id GROUP BY n.score_id, n.m_idx)[[stored:m|*]],
b AS (SELECT *, sum(length) OVER (w) - length + (m_idx - row_number() OVER (w) + 1) * capacity AS before FROM m WINDOW w AS (PARTITION BY score_id ORDER BY m_idx)),
o AS (SELECT[[merged:b]] p.score_id, coalesce(min(CASE WHEN b.m_idx = p.first_measure THEN b.before - (b.m_idx - p.start_measure) * b.capacity END), 0) AS origin FROM (SELECT[[merged:x]] y.score_id, y.start_measure, min(x.m_idx) AS first_measure FROM {{plays}} AS y LEFT JOIN m AS x ON x.score_id = y.score_id AND x.m_idx >= y.start_measure GROUP BY y.score_id, y.start_measure) AS p LEFT JOIN b ON b.score_id = p.score_id GROUP BY p.score_id),
n AS (SELECT[[merged:b]] p.*, {TICKS} AS ticks, b.before + sum({TICKS}) OVER (PARTITION BY p.score_id, p.m_idx ORDER BY p.n_idx) - {TICKS} AS placed, row_number() OVER (PARTITION BY p.score_id ORDER BY p.m_idx, p.n_idx) AS i FROM {{played_notes}} AS p JOIN b ON b.score_id = p.score_id AND b.m_idx = p.m_idx),
w AS (SELECT n.*, s.bpm, s.start_measure, s.clip_start, 60e0 / s.bpm / 16 AS unit, s.do_midi, n.placed - o.origin AS at_tick FROM n JOIN {{plays}} AS s ON s.score_id = n.score_id JOIN o ON o.score_id = n.score_id)
"""
timeline = operator("score_timeline", "played_notes plays", f"""{_WRITTEN.rstrip()},
t AS (SELECT *, at_tick * unit AS a, (at_tick + ticks) * unit AS z, lag(tie AND degree > 0 AND at_tick + ticks >= 0) OVER p AS held, lag(at_tick + ticks) OVER p AS held_to, {MIDI} - 60 + do_midi AS midi, do_midi + (CASE grace_degree WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 7 WHEN 6 THEN 9 WHEN 7 THEN 11 END) + 12 * grace_octave AS grace_midi FROM w WHERE m_idx >= start_measure WINDOW p AS (PARTITION BY score_id ORDER BY i))[[stored:t|score_id, note_id, m_idx, i, bpm, degree, at_tick, a, z, held, held_to, midi, grace_degree, grace_midi]],
e AS (SELECT *, CASE WHEN degree = 0 THEN 0 WHEN coalesce(held, false) AND abs(held_to - at_tick) < 1e-6 AND grace_degree IS NULL THEN 0 ELSE 1 END AS begins FROM t),
g AS (SELECT *, sum(begins) OVER (PARTITION BY score_id ORDER BY i) AS event FROM e WHERE degree > 0),
h AS (SELECT score_id, event, min(i) AS i, max(z) AS z FROM g GROUP BY score_id, event),
x AS (SELECT[[merged:h]] g.*, h.z AS event_end, CASE WHEN g.grace_degree IS NOT NULL THEN least((g.z - g.a) / 4, 15e0 / g.bpm) ELSE 0e0 END AS leans FROM g JOIN h ON h.score_id = g.score_id AND h.event = g.event AND h.i = g.i)[[stored:x|score_id, note_id, m_idx, midi, grace_degree, grace_midi, a, leans, event_end]]
SELECT score_id, 'mark' AS kind, note_id, m_idx, CAST(NULL AS BIGINT) AS midi, round(a, 6) AS start_s, round(z, 6) AS end_s FROM t
UNION ALL SELECT score_id, 'note', note_id, m_idx, CAST(midi AS BIGINT), round(a + leans, 6), round(event_end, 6) FROM x
UNION ALL SELECT score_id, 'grace', note_id, m_idx, CAST(grace_midi AS BIGINT), round(a, 6), round(a + leans, 6) FROM x WHERE grace_degree IS NOT NULL
""", "X1: marks of all notes and rests, sounding events with ties joined, grace notes that lean on their main note for a quarter of it, a sixteenth at most; bars keep their silent beats")

segments = operator("recording_segments", "played_notes plays", f"""{_WRITTEN.rstrip()},
r AS (SELECT *, coalesce(grid_start, source_s) AS begun, CASE WHEN grid_start IS NOT NULL THEN grid_end ELSE source_end END AS ended, grid_start IS NOT NULL AS gridded, grid_start IS NOT NULL OR source_s IS NOT NULL AS known FROM w),
c AS (SELECT *, sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY i) AS k, CASE WHEN known THEN CASE WHEN NOT gridded AND coalesce(lag(known AND NOT gridded) OVER p, false) AND lag(source_s) OVER p = source_s AND coalesce(lag(source_end) OVER p, -1e0) = coalesce(source_end, -1e0) THEN 0 ELSE 1 END ELSE 0 END AS fresh FROM r WINDOW p AS (PARTITION BY score_id ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY score_id ORDER BY i) AS grp FROM c)[[stored:g|score_id, note_id, i, k, grp, known, begun, ended, ticks, unit, at_tick, degree, clip_start]],
q AS (SELECT score_id, grp, min(begun) AS begun, max(ended) AS ended, sum(ticks) AS ticks, max(unit) AS unit FROM g WHERE known GROUP BY score_id, grp),
l AS (SELECT *, lead(begun) OVER (PARTITION BY score_id ORDER BY grp) AS next_begun FROM q),
d AS (SELECT score_id, grp, begun, ticks, coalesce(ended, CASE WHEN next_begun > begun THEN least(next_begun, begun + ticks * unit) ELSE begun + ticks * unit END) AS ended FROM l),
s AS (SELECT[[merged:d]] g.score_id, g.note_id, g.i, g.k, g.ticks, g.unit, g.at_tick, d.begun + (d.ended - d.begun) * (sum(g.ticks) OVER (u) - g.ticks) / d.ticks AS a, d.begun + (d.ended - d.begun) * sum(g.ticks) OVER (u) / d.ticks AS z FROM g JOIN d ON d.score_id = g.score_id AND d.grp = g.grp WHERE g.known WINDOW u AS (PARTITION BY g.score_id, g.grp ORDER BY g.i))[[stored:s|score_id, note_id, k, ticks, at_tick, a, z]],
f AS (SELECT score_id, max(k) AS last_k FROM s GROUP BY score_id),
v AS (SELECT g.*, sum(g.ticks) OVER (PARTITION BY g.score_id, g.k) AS gap_ticks, sum(g.ticks) OVER (PARTITION BY g.score_id, g.k ORDER BY g.i) AS so_far, max(g.degree) OVER (PARTITION BY g.score_id, g.k) AS loudest FROM g WHERE NOT g.known),
y AS (SELECT[[merged:x, n]] v.score_id, v.note_id, v.i, v.ticks, v.gap_ticks, v.so_far, v.loudest, v.unit, v.at_tick, v.clip_start, v.k, f.last_k, x.a AS left_a, x.z AS left_z, x.at_tick + x.ticks AS left_tick, n.a AS right_a, n.at_tick AS right_tick
      FROM v JOIN f ON f.score_id = v.score_id LEFT JOIN s AS x ON x.score_id = v.score_id AND x.k = v.k LEFT JOIN s AS n ON n.score_id = v.score_id AND n.k = v.k + 1)[[stored:y|*]],
z AS (SELECT score_id, note_id, 'rest' AS timing, left_z + (right_a - left_z) * (so_far - ticks) / gap_ticks AS a, left_z + (right_a - left_z) * so_far / gap_ticks AS b, clip_start FROM y WHERE k > 0 AND k < last_k AND loudest = 0 AND right_a > left_z
      UNION ALL SELECT score_id, note_id, 'estimated-prefix', right_a + (at_tick - right_tick) * unit, right_a + (at_tick - right_tick + ticks) * unit, clip_start FROM y WHERE k = 0
      UNION ALL SELECT score_id, note_id, 'estimated-suffix', left_z + (at_tick - left_tick) * unit, left_z + (at_tick - left_tick + ticks) * unit, clip_start FROM y WHERE k = last_k)
SELECT score_id, note_id, 'recorded' AS timing, round(a, 4) + 0e0 AS start_s, round(z, 4) + 0e0 AS end_s FROM s
UNION ALL SELECT score_id, note_id, timing, round(CASE WHEN timing <> 'rest' THEN greatest(a, -clip_start) ELSE a END, 4) + 0e0, round(b, 4) + 0e0 FROM z WHERE timing = 'rest' OR b > -clip_start
""", "X2, W7, W8: notes of one recorded time share it by their written lengths; rests fill the silence between; what has no time before the first and after the last is estimated outward from them")

positions = operator("recording_positions", "segments_of moments", """
WITH s AS (SELECT *, CAST(floor(start_s / 2e0) AS BIGINT) AS first_slot, CAST(floor(end_s / 2e0) AS BIGINT) - CAST(floor(start_s / 2e0) AS BIGINT) + 1 AS slots FROM {segments_of} WHERE end_s > start_s),
h AS (SELECT score_id, note_id, start_s, end_s, first_slot + i AS slot FROM s [[each_below:slots|i]]),
f AS (SELECT t.score_id, t.moment, h.note_id, h.start_s, h.end_s, row_number() OVER (PARTITION BY t.score_id, t.moment ORDER BY h.start_s, h.note_id) AS place FROM (SELECT DISTINCT score_id, moment FROM {moments}) AS t JOIN h ON h.score_id = t.score_id AND h.slot = CAST(floor(t.moment / 2e0) AS BIGINT) AND t.moment >= h.start_s AND t.moment < h.end_s)
SELECT m.score_id, m.moment, f.note_id, round((m.moment - f.start_s) / (f.end_s - f.start_s), 6) AS share FROM (SELECT DISTINCT score_id, moment FROM {moments}) AS m LEFT JOIN f ON f.score_id = m.score_id AND f.moment = m.moment AND f.place = 1
""", "X3: the note that sounds at a moment, start <= t < end, and how far it is; none in silence")

#: Fixed values of the file format: ticks of a quarter note, velocity of notes.
PPQ, VELOCITY = 480, 88
#: Scores whose events are Python objects at once.
TOGETHER = 64


def variable_length(value: int) -> bytes:
    """Seven bits a byte, high first; all but the last carry the eighth bit."""
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def midi_bytes(events: list[tuple[int, float, float]], bpm: float, meter: tuple[int, int], duration: float) -> bytes:
    """A file of format 0: tempo, meter and program first, at one tick ends before beginnings."""
    tick = lambda s: round(s * bpm / 60 * PPQ)
    tempo = round(60_000_000 / bpm)
    messages = [(0, 0, b"\xff\x51\x03" + tempo.to_bytes(3, "big")), (0, 0, b"\xff\x58\x04" + bytes([meter[0], meter[1].bit_length() - 1, 36 if meter[1] == 8 else 24, 8])), (0, 0, b"\xc0\x00")]
    for midi, a, b in events:
        messages += [(tick(a), 2, bytes([144, midi, VELOCITY])), (tick(b), 1, bytes([128, midi, 0]))]
    messages.append((tick(duration), 3, b"\xff\x2f\x00"))
    track, last = b"", 0
    for at, _, data in sorted(messages, key=lambda m: m[:2]):
        track, last = track + variable_length(at - last) + data, at
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, PPQ) + b"MTrk" + struct.pack(">I", len(track)) + track


def midi_files(marks: DataFrame, heads: DataFrame) -> DataFrame:
    """IO14 over score_timeline and heads (score_id, bpm, beats, beat_unit, duration_s): (score_id, midi), a file for each score; one
    without sounding notes has the tempo alone. A row holds one score's events."""
    sounding = marks.where("kind <> 'mark' AND midi BETWEEN 0 AND 127").groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "midi"))).alias("events"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                score, bpm, beats, unit, duration, events = (part[i].to_pylist() for i in range(6))
                files = [midi_bytes([(e["midi"], e["start_s"], e["end_s"]) for e in own or []], float(b), (int(n), int(u)), float(d)) for b, n, u, d, own in zip(bpm, beats, unit, duration, events, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(score, pa.int64()), pa.array(files, pa.binary())], names=["score_id", "midi"])

    return heads.select("score_id", "bpm", "beats", "beat_unit", "duration_s").join(sounding.hint("merge"), "score_id", "left").select("score_id", "bpm", "beats", "beat_unit", "duration_s", "events").mapInArrow(run, "score_id long, midi binary")


_N = adapters.VIEWS["notes"]
_KEY = "CASE score_key WHEN 'C' THEN 60 WHEN 'Db' THEN 61 WHEN 'D' THEN 62 WHEN 'Eb' THEN 63 WHEN 'E' THEN 64 WHEN 'F' THEN 65 WHEN 'Gb' THEN 66 WHEN 'G' THEN 67 WHEN 'Ab' THEN 68 WHEN 'A' THEN 69 WHEN 'Bb' THEN 70 ELSE 71 END"
_PLAYED = f"""SELECT score_id, m_idx, n_idx, note_id, degree, base, octave, dots, accidental, tie, CASE WHEN note_id % 17 = 0 AND degree > 0 THEN degree % 7 + 1 END AS grace_degree, CAST(0 AS BIGINT) AS grace_octave, CAST(NULL AS DOUBLE) AS grid_start, CAST(NULL AS DOUBLE) AS grid_end,
    CASE WHEN m_idx BETWEEN 2 AND 20 AND degree > 0 AND note_id % 5 > 0 THEN m_idx * 2e0 + floor(n_idx / 2e0) * 5e-1 END AS source_s, CASE WHEN m_idx BETWEEN 2 AND 20 AND degree > 0 AND note_id % 5 > 0 AND n_idx % 4 < 2 THEN m_idx * 2e0 + floor(n_idx / 2e0) * 5e-1 + 4e-1 END AS source_end, CASE WHEN m_idx % 6 = 5 THEN 48 END AS manual_ticks FROM ({_N}) AS n"""
_SCORES = adapters.VIEWS["scores"].replace("{orders}", "(SELECT l_orderkey AS o_orderkey FROM {lineitem}) AS x")
adapters.VIEWS |= {
    "played_notes": _PLAYED,
    "plays": f"SELECT score_id, bpm, meter, {_KEY} AS do_midi, score_id % 3 AS start_measure, score_id % 4 * 1e0 AS clip_start FROM ({_SCORES}) AS s",
    "segments_of": f"SELECT score_id, note_id, source_s AS start_s, source_s + 45e-2 AS end_s FROM ({_PLAYED}) AS p WHERE source_s IS NOT NULL",
    "moments": f"SELECT score_id, source_s + (note_id % 10) * 1e-1 AS moment FROM ({_PLAYED}) AS p WHERE source_s IS NOT NULL AND note_id % 3 = 0",
}
adapters.TABLES |= {name: "lineitem" for name in ("played_notes", "plays", "segments_of", "moments")}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = timeline.query(spark, sf_dir)
    heads = adapters.view(spark, sf_dir, "plays").join(marks.groupBy("score_id").agg(F.max("end_s").alias("duration_s")), "score_id").select("score_id", "bpm", F.col("meter").alias("beats"), F.lit(4).alias("beat_unit"), "duration_s")
    return midi_files(marks, heads)


QUERIES = {"midi_files": _files}
