"""A song's fixed grid: overlapping windows of beats fitted robustly, pooled where they agree, and the phase of its first beat."""

from ..plans.sqlop import operator
from ..sources import adapters

WINDOW = "OVER (PARTITION BY song_id, rank, first)"
#: One of three rounds: beats within three median residuals (.05 s at least) are fitted again, if 65 % of the window are.
ROUND = f"""
k{{n}} AS (SELECT *, CASE WHEN resid <= greatest(5e-2, 3 * middle) THEN x END AS kept FROM (SELECT *, median(resid) {WINDOW} AS middle FROM r{{p}}) AS q{{n}}),
f{{n}} AS (SELECT song_id, rank, first, bpm, score, meter, width, beat_s, x, CASE WHEN count(kept) {WINDOW} >= width * 65e-2 THEN regr_slope(beat_s, kept) {WINDOW} ELSE slope END AS slope, CASE WHEN count(kept) {WINDOW} >= width * 65e-2 THEN regr_intercept(beat_s, kept) {WINDOW} ELSE base END AS base FROM k{{n}}),
r{{n}} AS (SELECT *, abs(beat_s - base - slope * x) AS resid FROM f{{n}}),
"""
fits = operator("grid_fits", "beats tempi", f"""
WITH b AS (SELECT song_id, beat_s, CAST(row_number() OVER (PARTITION BY song_id ORDER BY beat_s) - 1 AS BIGINT) AS i, beat_s - lag(beat_s) OVER (PARTITION BY song_id ORDER BY beat_s) AS gap, count(*) OVER (PARTITION BY song_id) AS n FROM {{beats}}),
p AS (SELECT b.song_id, b.beat_s, b.i, b.n, t.rank, t.bpm, t.score, t.meter, least(b.n, 20 * t.meter + 1) AS width, sum(CASE WHEN b.gap IS NULL THEN 0 ELSE greatest(1, CAST(floor(b.gap * t.bpm / 6e1 + 5e-1) AS BIGINT)) END) OVER (PARTITION BY b.song_id, t.rank ORDER BY b.i) AS place FROM b JOIN {{tempi}} AS t ON t.song_id = b.song_id WHERE b.n >= 8),
s AS (SELECT *, greatest(0, CAST(floor((i - width) / (1e0 * meter)) AS BIGINT) + 1) AS k0, CAST(floor(least(i, n - width) / (1e0 * meter)) AS BIGINT) + 1 - greatest(0, CAST(floor((i - width) / (1e0 * meter)) AS BIGINT) + 1) AS ways FROM p),
w AS (SELECT song_id, rank, bpm, score, meter, width, beat_s, place, (k0 + d) * meter AS first FROM (SELECT * FROM s WHERE ways > 0) AS t [[each_below:ways|d]]),
x AS (SELECT song_id, rank, first, bpm, score, meter, width, beat_s, CAST(place - min(place) {WINDOW} AS DOUBLE) AS x FROM w),
f0 AS (SELECT *, regr_slope(beat_s, x) {WINDOW} AS slope, regr_intercept(beat_s, x) {WINDOW} AS base FROM x),
r0 AS (SELECT *, abs(beat_s - base - slope * x) AS resid FROM f0),
{"".join(ROUND.format(n=n, p=n - 1) for n in (1, 2, 3)).strip()}
o AS (SELECT *, median(resid) {WINDOW} AS error FROM r3),
a AS (SELECT *, round(score - least(error * 4, 2e0), 9) AS worth FROM o WHERE abs(slope * bpm / 6e1 - 1) <= 12e-2),
c AS (SELECT *, dense_rank() OVER (PARTITION BY song_id ORDER BY worth DESC, rank, first) AS place FROM a),
e AS (SELECT *, max(CASE WHEN place = 1 THEN slope END) OVER (PARTITION BY song_id) AS best FROM c),
g AS (SELECT *, abs(best / slope - 1) <= 6e-3 AS agrees FROM e),
m AS (SELECT *, median(CASE WHEN agrees THEN slope END) OVER (PARTITION BY song_id) AS period, count(CASE WHEN agrees THEN 1 END) OVER (PARTITION BY song_id) AS agreeing FROM g)
SELECT song_id, max(meter) AS meter, round(max(period), 8) AS period, round(median(beat_s - period * x), 6) AS base, max(rank) AS rank, max(first) AS first, round(max(error), 6) AS error, CAST(round(max(agreeing) / (1e0 * max(width))) AS BIGINT) AS agreeing, round(max(x) / max(meter), 6) AS fit_measures, min(beat_s) AS fit_from, max(beat_s) AS fit_to
FROM m WHERE place = 1 GROUP BY song_id
""", "AG19: windows of 20 measures, each tempo's whole beat positions fitted with three trims; the best window, its period pooled with all within .6 %")

phases = operator("grid_phases", "grids downbeats envelope", """
WITH h AS (SELECT * FROM (SELECT song_id, meter, period, base, CAST(round(fit_measures * meter) AS BIGINT) AS beats_of FROM {grids}) AS q [[each_below:meter|phase]]),
n AS (SELECT *, CAST(floor((beats_of - phase) / (1e0 * meter)) AS BIGINT) + 1 AS times FROM h WHERE phase <= beats_of),
c AS (SELECT *, CAST(round((base + period * (phase + k * meter)) / 1e-2) AS BIGINT) AS frame, k FROM n [[each_below:times|k]]),
v AS (SELECT song_id, frame, pulse, bass, CAST(floor(frame / 1e2) AS BIGINT) + d AS slot FROM {envelope} CROSS JOIN (VALUES (-1), (0), (1)) AS y(d)),
e AS (SELECT c.song_id, c.phase, c.k, c.meter, c.period, c.base, coalesce(max(CASE WHEN abs(v.frame - c.frame) <= greatest(1, round(8 * c.period)) THEN v.pulse END), 0e0) AS pulse, coalesce(max(CASE WHEN abs(v.frame - c.frame) <= greatest(1, round(9 * c.period)) THEN v.bass END), 0e0) AS bass
      FROM c LEFT JOIN v ON v.song_id = c.song_id AND v.slot = CAST(floor(c.frame / 1e2) AS BIGINT) GROUP BY c.song_id, c.phase, c.k, c.meter, c.period, c.base),
m AS (SELECT song_id, phase, meter, period, base, avg(pulse) AS pulse, avg(bass) AS bass FROM e GROUP BY song_id, phase, meter, period, base),
d AS (SELECT m.song_id, m.phase, m.meter, m.period, m.base, m.pulse, m.bass, min(x.beat_s) AS first_at, count(CASE WHEN ((CAST(round((x.beat_s - m.base) / m.period) AS BIGINT) % m.meter) + m.meter) % m.meter = m.phase THEN 1 END) AS hits FROM m LEFT JOIN {downbeats} AS x ON x.song_id = m.song_id GROUP BY m.song_id, m.phase, m.meter, m.period, m.base, m.pulse, m.bass),
s AS (SELECT *, hits / greatest(1e0 * max(hits) OVER w, 1e-8) AS model, pulse / greatest(max(pulse) OVER w, 1e-8) AS pulses, CASE WHEN max(bass) OVER w > 1e-5 THEN bass / max(bass) OVER w ELSE 0e0 END AS basses FROM d WINDOW w AS (PARTITION BY song_id)),
t AS (SELECT *, round(CASE WHEN first_at IS NOT NULL THEN 6e-1 * model + 2e-1 * pulses + 2e-1 * basses WHEN max(basses) OVER w > 0 AND max(pulses) OVER w > 0 THEN 7e-1 * pulses + 3e-1 * basses ELSE pulses END, 6) AS score FROM s WINDOW w AS (PARTITION BY song_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, phase) AS place FROM t),
z AS (SELECT *, max(CASE WHEN place = 1 THEN phase END) OVER (PARTITION BY song_id) AS best FROM b)
SELECT song_id, CAST(phase AS BIGINT) AS phase, score, place = 1 AS chosen, round(CASE WHEN first_at IS NOT NULL THEN first_at + round((base - first_at) / (period * meter)) * period * meter ELSE base + best * period END, 6) AS anchor FROM z
""", "AG20: how well each beat of the measure is a first one: marked first beats .6, pulse .2 and bass .2; without marks pulse .7 and bass .3")


def stable_grid(beats, tempi, downbeats, envelope):
    """AG19, AG20: each song's fixed grid and how well each beat begins its measures; songs of under 8 beats have none."""
    return phases(fits(beats, tempi), downbeats, envelope)


_BEATS = "SELECT user_id AS song_id, round(12e-1 + r * 6e1 / 79 + (event_id % 9 - 4) * 5e-3 + CASE WHEN r % 40 BETWEEN 20 AND 22 THEN 16e-2 ELSE 0e0 END, 4) AS beat_s, r, event_id FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) - 1 AS r FROM {events}) AS e WHERE event_id % 37 > 0"
adapters.VIEWS |= {
    "beats": f"SELECT song_id, beat_s FROM ({_BEATS}) AS b",
    "tempi": "SELECT song_id, rank, CASE rank WHEN 0 THEN 792e-1 WHEN 1 THEN 396e-1 ELSE 158e0 END AS bpm, 1e0 - rank * 25e-2 AS score, 2 + song_id % 3 AS meter FROM (SELECT DISTINCT user_id AS song_id FROM {events}) AS s CROSS JOIN (VALUES (0), (1), (2)) AS d(rank)",
    "downbeats": f"SELECT song_id, beat_s FROM ({_BEATS}) AS b WHERE song_id % 2 = 0 AND r % (2 + song_id % 3) = 1",
    "grids": "SELECT DISTINCT user_id AS song_id, 2 + user_id % 3 AS meter, round(6e1 / 79, 8) AS period, 12e-1 + user_id % 5 * 1e-2 AS base, 1e1 AS fit_measures FROM {events}",
    "envelope": f"SELECT song_id, CAST(round(beat_s / 1e-2) AS BIGINT) AS frame, CASE WHEN r % (2 + song_id % 3) = 0 THEN 1e0 ELSE 25e-2 END AS pulse, CASE WHEN song_id % 5 = 0 THEN 0e0 WHEN r % (2 + song_id % 3) = 1 THEN 5e0 ELSE 5e-2 END AS bass FROM ({_BEATS}) AS b",
}
adapters.TABLES |= {name: "events" for name in ("beats", "tempi", "downbeats", "envelope", "grids")}
