"""Notes out of continuous pitch: stable cores by two thresholds, a second lane that fills gaps only, and passes over what they found.

Frames become islands, steady frames and runs by window functions; a run and an island with its cores are one row each, and batches of
such rows are cut into cores and events. No row holds more than a song's island, none a song's whole search.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import kept
from ..plans.sqlop import operator
from ..sources import adapters
from .decoders import segment_events, spread

#: Fixed values of the analysis, in seconds, half tones and probabilities.
STEP = 0.016
VIBRATO, CORE, SHORT_CORE = 0.208, 0.08, 0.048
SPREAD, DRIFT, TOLERANCE = 0.32, 0.22, 0.45
DIP, MERGE = 0.65, 0.7
#: Frames before and after an attack in which energy must dip and rise.
BEFORE, AFTER = round(0.09 / STEP), round(0.08 / STEP)


@dataclass(frozen=True)
class Lane:
    """What a frame needs to go on with a note, and one of its frames to begin it; the shortest core; the longest gap bridged."""

    going_on: float
    seed: float
    min_core: float
    gap: float


STRICT, WEAK = Lane(0.35, 0.65, 0.048, 0.096), Lane(0.01, 0.01, 0.08, 0.0)

observed = operator("observed_frames", "frames", """
SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY frame) - 1 AS BIGINT) AS i, CASE WHEN NOT isnan(pitch) THEN pitch END AS pitch, coalesce(voiced, false) AS voiced, coalesce(confidence, 0e0) AS confidence, energy, coalesce(onset, false) AS onset,
       greatest(8e-4, max(energy) OVER (PARTITION BY song_id) * 25e-3) AS quiet, max(energy) OVER (PARTITION BY song_id) IS NULL OR coalesce(energy, 0e0) >= greatest(8e-4, max(energy) OVER (PARTITION BY song_id) * 25e-3) AS audible
FROM {frames}
""", "SG11: frames in order, with the song's level of silence; without any energy nothing is silent")

tuning = operator("song_tuning", "frames", f"""
WITH o AS (SELECT song_id, i, CASE WHEN pitch IS NOT NULL AND voiced AND audible AND confidence >= {STRICT.seed} THEN pitch END AS x, count(*) OVER (PARTITION BY song_id) AS n FROM ({observed.text}) AS f),
w AS (SELECT song_id, i, n, count(x) OVER r AS k, [[lower_of:x|r]] AS q1, [[middle_of:x|r]] AS q2, [[upper_of:x|r]] AS q3 FROM o WINDOW r AS (PARTITION BY song_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT song_id, CASE WHEN i % 5 = 2 AND i < n - 2 AND k >= 4 AND q3 - q1 <= 25e-2 THEN q2 END AS m FROM w),
a AS (SELECT song_id, count(m) AS samples, count(DISTINCT floor(m + 5e-1)) AS distinct_notes, avg(cos(2 * pi() * m)) AS c, avg(sin(2 * pi() * m)) AS s FROM s GROUP BY song_id),
d AS (SELECT song_id, samples, distinct_notes, sqrt(c * c + s * s) AS concentration, atan2(s, c) / (2 * pi()) * 100 AS cents FROM a),
e AS (SELECT *, CASE WHEN samples < 60 THEN 'insufficient-evidence' WHEN distinct_notes < 5 THEN 'too-few-distinct-notes' WHEN concentration < 65e-2 THEN 'diffuse-offsets' WHEN abs(cents) > 35 THEN 'offset-out-of-safe-range' ELSE 'reliable-consensus' END AS reason FROM d)
SELECT song_id, samples, distinct_notes, round(coalesce(concentration, 0e0), 6) AS concentration, reason, CASE WHEN reason = 'reliable-consensus' THEN round(cents, 6) ELSE 0e0 END AS cents FROM e
""", "AG15: a song's cents off concert pitch, from steady frames thinned to 80 ms, or the first of four reasons why there is no estimate")

#: Frame k is struck: an onset where energy dips before and rises after.
STRUCK = f"onset AND min(energy) OVER (PARTITION BY song_id ORDER BY i ROWS BETWEEN {BEFORE} PRECEDING AND 1 PRECEDING) < {DIP} * max(energy) OVER (PARTITION BY song_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {AFTER - 1} FOLLOWING)"


def _quantile(xs: list[float], p: float) -> float:
    """Of sorted numbers, between the two that stand around the place."""
    at = (len(xs) - 1) * p
    low = int(at)
    return xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)


def weighted_median(x: np.ndarray, weights: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)])


def _steady(pitches: list, at: int) -> tuple[bool, float | None]:
    """Is the frame at place at of its surroundings (None: no pitch) steady, and the mean it swings around, if it does."""
    for seconds in (VIBRATO, CORE, SHORT_CORE):
        radius = max(1, int(seconds / STEP / 2))
        around = pitches[max(0, at - radius) : at + radius + 1]
        x = [p for p in around if p is not None]
        if len(x) < 3 or len(x) / len(around) < 0.7:
            continue
        third, ordered = max(1, len(x) // 3), sorted(x)
        drift, spread = abs(_quantile(sorted(x[:third]), 0.5) - _quantile(sorted(x[-third:]), 0.5)), _quantile(ordered, 0.75) - _quantile(ordered, 0.25)
        steps = [b - a for a, b in zip(x, x[1:], strict=False) if abs(b - a) > 0.025]
        swings = seconds == VIBRATO and sum(a * b < 0 for a, b in zip(steps, steps[1:], strict=False)) >= 2 and spread < 1.25
        if drift <= DRIFT and (spread <= SPREAD or swings):
            return True, sum(x) / len(x) if swings else None
    return False, None


@F.pandas_udf(T.StructType([T.StructField("steady", T.BooleanType()), T.StructField("swing", T.DoubleType())]))
def _steadiness(around: pd.Series, at: pd.Series) -> pd.DataFrame:
    found = [_steady([None if p is None or p != p else p for p in xs], int(k)) for xs, k in zip(around, at, strict=True)]
    return pd.DataFrame({"steady": [s for s, _ in found], "swing": pd.array([m for _, m in found], dtype="Float64")})


def islands(frames: DataFrame, lane: Lane) -> DataFrame:
    """Frames with valid, and the island of those that are valid or in a bridged gap: short, still sounding, between like pitches.

    frames: observed_frames, and allowed: whether the lane may use a frame.
    """
    song = Window.partitionBy("song_id").orderBy("i")
    valid = F.col("allowed") & F.col("pitch").isNotNull() & F.col("voiced") & F.col("audible") & (F.col("confidence") >= lane.going_on)
    marked = frames.withColumn("valid", valid)
    marked = marked.withColumn("run", F.sum(F.when(F.col("valid") == F.lag("valid").over(song), 0).otherwise(1)).over(song))
    runs = marked.groupBy("song_id", "run").agg(F.first("valid").alias("ok"), F.count(F.lit(1)).alias("n"), F.min("energy").alias("least"), *[f(c, "i").alias(f"{side}_{c}") for c in ("pitch", "energy") for side, f in (("first", F.min_by), ("last", F.max_by))])
    order = Window.partitionBy("song_id").orderBy("run")
    near = {f"{w}_{c}": (F.lag(f"last_{c}") if w == "before" else F.lead(f"first_{c}")).over(order) for c in ("pitch", "energy") for w in ("before", "after")}
    runs = runs.withColumns(near)
    bridged = (F.col("n") * STEP <= lane.gap + 1e-9) & (F.abs(F.col("before_pitch") - F.col("after_pitch")) < 0.5) & (F.col("least") >= 0.45 * F.least("before_energy", "after_energy"))
    runs = runs.withColumn("held", F.col("ok") | F.coalesce(bridged, F.lit(False)))
    runs = runs.withColumn("island", F.sum(F.when(~F.col("held"), 1).otherwise(0)).over(order)).where("held").select("song_id", "run", "island")
    joined = marked.join(runs.hint("merge"), ["song_id", "run"], "left").drop("run")
    seeded = F.max(F.col("valid") & (F.col("confidence") >= lane.seed)).over(Window.partitionBy("song_id", "island"))
    return joined.withColumn("island", F.when(F.col("island").isNotNull() & seeded, F.col("island")))


def _together(frames: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """One row for each group of frames, with the columns as doubles in the order of i, which comes first (null: NaN): many small
    groups go to Python in one batch, a large one is one row."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]
    return frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *values))).alias("x")).select(*keys, F.flatten(F.transform("x", lambda s: F.array(s["i"].cast("double"), *[s[c] for c in columns]))).alias("frames"))


def _matrix(frames: np.ndarray, width: int = 3) -> np.ndarray:
    return np.asarray(frames, dtype=float).reshape(-1, width)


def _cut(lane: Lane):
    def run(song: int, island: int, frames: np.ndarray) -> list[tuple]:
        """A steady run's cores: cut where the trend leaves the median of the core so far. Rows of frames: place, trend, confidence."""
        at, trend, prob = frames.T
        out, start, seen = [], 0, [trend[0]]
        for k in range(1, len(at) + 1):
            middle = (seen[len(seen) // 2] + seen[(len(seen) - 1) // 2]) / 2
            if k == len(at) or abs(trend[k] - middle) > TOLERANCE:
                if (k - start) * STEP >= lane.min_core and (prob[start:k] >= lane.seed).any():
                    out.append((song, island, int(at[start]), int(at[k - 1]) + 1, weighted_median(trend[start:k], prob[start:k])))
                start, seen = k, []
            if k < len(at):
                bisect.insort(seen, trend[k])
        return out

    def batch(batches):
        for rows in batches:
            out = [core for r in rows.itertuples() for core in run(r.song_id, r.island, _matrix(r.frames))]
            yield pd.DataFrame(out, columns=["song_id", "island", "a", "b", "center"])

    return batch


def raw_cores(frames: DataFrame, lane: Lane) -> DataFrame:
    """(song_id, island, a, b, center): cores of frames a to b-1, out of islands()."""
    own = frames.where("island IS NOT NULL")
    reach = max(1, int(VIBRATO / STEP / 2))
    near = Window.partitionBy("song_id", "island").orderBy("i").rowsBetween(-reach, reach)
    place = F.least(F.row_number().over(Window.partitionBy("song_id", "island").orderBy("i")) - 1, F.lit(reach))
    heard = F.when(F.col("valid"), F.col("pitch"))
    around = own.withColumn("around", F.collect_list(F.struct(heard.alias("p"))).over(near)).withColumn("around", F.transform("around", lambda s: s["p"])).withColumn("at", place)
    found = around.withColumn("s", _steadiness("around", "at")).withColumn("steady", F.col("valid") & F.col("s.steady")).withColumn("swing", F.when(F.col("valid"), F.col("s.swing")))
    # an unsteady frame beside swinging ones belongs to them
    swings = F.array_sort(F.collect_list("swing").over(near))
    n = F.size("swings")
    middle = (F.get("swings", F.floor((n - 1) / 2).cast("int")) + F.get("swings", F.floor(n / 2).cast("int"))) / 2
    found = found.withColumn("swings", swings).withColumn("middle", F.when(n > 0, middle))
    joins = F.coalesce(F.col("valid") & ~F.col("steady") & (F.abs(F.col("pitch") - F.col("middle")) < 0.9), F.lit(False))
    trend = F.when(joins, F.col("middle")).otherwise(F.coalesce("swing", "pitch"))
    found = found.select("song_id", "island", "i", "confidence", trend.alias("trend"), (F.col("steady") | joins).alias("steady"))
    order = Window.partitionBy("song_id", "island").orderBy("i")
    runs = found.withColumn("run", F.sum(F.when(F.col("steady") == F.lag("steady").over(order), 0).otherwise(1)).over(order)).where("steady")
    return _together(runs, ["song_id", "island", "run"], "trend", "confidence").select("song_id", "island", "frames").mapInPandas(_cut(lane), "song_id long, island long, a long, b long, center double")


transitions = operator("transition_cores", "cores frames_of_cores", f"""
WITH n AS (SELECT *, lead(a) OVER w AS next_a, lead(b) OVER w AS next_b, lead(center) OVER w AS next_center FROM {{cores}} WINDOW w AS (PARTITION BY song_id, island ORDER BY a)),
c AS (SELECT *, next_a - a + {AFTER} AS reach FROM n WHERE (b - a) * {STEP} <= 1e-1 + 1e-8 AND (next_b - next_a) * {STEP} >= 112e-3 - 1e-8 AND (next_a - b) * {STEP} <= 96e-3 + 1e-8 AND abs(next_center - center) BETWEEN 6e-1 AND 25e-1),
e AS (SELECT c.song_id, c.a, c.b, c.center, c.next_a, c.next_b, c.next_center, c.a + d AS i FROM c [[each_below:reach|d]]),
p AS (SELECT e.*, f.pitch, f.valid, f.energy, f.onset, CASE WHEN e.i > e.a THEN (f.pitch - lag(f.pitch) OVER (PARTITION BY e.song_id, e.a ORDER BY e.i)) * sign(e.next_center - e.center) END AS rise FROM e JOIN {{frames_of_cores}} AS f ON f.song_id = e.song_id AND f.i = e.i),
s AS (SELECT song_id, a, min(CASE WHEN valid AND pitch IS NOT NULL THEN 1 ELSE 0 END) AS whole, max(abs(rise)) AS step, sum(greatest(0e0, -rise)) AS back, sum(rise) AS way FROM p WHERE i <= next_a GROUP BY song_id, a),
k AS (SELECT song_id, a, b, next_b, i AS k FROM p WHERE onset AND i BETWEEN b AND next_a),
h AS (SELECT k.song_id, k.a, k.k, min(CASE WHEN p.i < k.k THEN p.energy END) AS low, max(CASE WHEN p.i >= k.k AND p.i < k.next_b THEN p.energy END) AS high FROM k JOIN p ON p.song_id = k.song_id AND p.a = k.a AND p.i BETWEEN k.k - {BEFORE} AND k.k + {AFTER - 1} GROUP BY k.song_id, k.a, k.k),
r AS (SELECT DISTINCT song_id, a FROM h WHERE low < {DIP} * high)
SELECT n.song_id, n.island, n.a, n.b, n.center, s.a IS NOT NULL AND s.whole = 1 AND s.step <= {TOLERANCE} AND s.back <= 25e-2 AND s.way >= 6e-1 AND r.a IS NULL AS absorbed
FROM n LEFT JOIN s ON s.song_id = n.song_id AND s.a = n.a LEFT JOIN r ON r.song_id = n.song_id AND r.a = n.a
""", "W22: a short core inside a smooth one-way scoop to a longer core is no note of its own, unless it was struck again between them")


def _groups(cores: list[tuple[int, int, float]]) -> list[list[tuple[int, int, float]]]:
    """Cores of one note together: each group costs MERGE and 8 times its weighted squared residual; 24 cores at most, within TOLERANCE."""
    cost, came = [0.0] + [np.inf] * len(cores), [0] * (len(cores) + 1)
    for end in range(1, len(cores) + 1):
        for start in range(end - 1, max(-1, end - 24), -1):
            centers, weights = np.array([c for _, _, c in cores[start:end]]), np.array([b - a for a, b, _ in cores[start:end]])
            if np.ptp(centers) > TOLERANCE:
                break
            middle = weighted_median(centers, weights)
            total = cost[start] + MERGE + 8 * float((weights * (centers - middle) ** 2).sum() / weights.sum())
            if total < cost[end]:
                cost[end], came[end] = total, start
    out, end = [], len(cores)
    while end:
        out.append(cores[came[end] : end])
        end = came[end]
    return out[::-1]


EVENTS = "song_id long, a long, b long, midi long, center double, core_a long, core_b long, spread double, voicing double, uncertain boolean, core_frames long, scoop_b long, fall_a long"


def _island_events(song: int, frames: np.ndarray, found: list[tuple[int, int, float]]) -> list[tuple]:
    at, pitch, prob, valid, energy, onset = frames.T
    at, valid = at.astype(int), valid > 0
    first, last, onsets = int(at[0]), int(at[-1]) + 1, at[onset > 0].tolist()
    groups = _groups(found) or [[]]
    middles = [weighted_median(np.array([c for _, _, c in g]), np.array([b - a for a, b, _ in g])) if g else None for g in groups]
    bounds = [first]
    for left, right, middle in zip(groups, groups[1:], middles, strict=False):
        away = [k for k in range(left[-1][1], right[0][0]) if valid[k - first] and abs(pitch[k - first] - middle) > TOLERANCE]
        bounds.append(away[0] if away else left[-1][1])
    out = []
    for group, left, right in zip(groups, bounds, [*bounds[1:], last], strict=True):
        cuts = [left]
        for k in onsets:
            if left < k < right and k - cuts[-1] >= round(0.12 / STEP) and right - k >= round(0.09 / STEP):
                before, after = energy[max(left, k - BEFORE) - first : k - first], energy[k - first : min(right, k + AFTER) - first]
                if len(before) and before.min() < DIP * after.max():
                    cuts.append(k)
        for a, b in zip(cuts, [*cuts[1:], right], strict=True):
            own = [(max(a, x), min(b, y)) for x, y, _ in group if x < b and y > a]
            rows = np.concatenate([np.arange(x - first, y - first) for x, y in own]) if own else np.flatnonzero(valid[a - first : b - first]) + a - first
            rows = rows[np.isfinite(pitch[rows])]
            if not len(rows):
                continue
            center = weighted_median(pitch[rows], prob[rows])
            spread = float(np.median(np.abs(pitch[rows] - center))) * 100
            midi = int(np.floor(center + 0.5))
            core_a, core_b = (own[0][0], own[-1][1]) if own else (None, None)
            far = np.abs(pitch - center) > 0.6
            scoop = core_b is not None and far[a - first : core_a - first].any()
            fall = core_b is not None and far[core_b - first : b - first].any()
            uncertain = not own or abs(center - midi) > 0.35 or spread > 35
            out.append((song, a, b, midi, round(center, 4), core_a, core_b, round(spread, 1), round(float(prob[rows].mean()), 3), uncertain, sum(y - x for x, y in own), core_a if scoop else None, core_b if fall else None))
    return out


def _events_of_islands(batches):
    for rows in batches:
        out = [e for r in rows.itertuples() for e in _island_events(r.song_id, _matrix(r.frames, 6), [(int(a), int(b), c) for a, b, c in _matrix([] if r.cores is None else r.cores).tolist()])]
        named = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
        yield named.astype({c: "Int64" for c in ("core_a", "core_b", "scoop_b", "fall_a")})


def lane_events(frames: DataFrame, lane: Lane) -> DataFrame:
    """EVENTS of one lane, out of islands(): a note for each group of cores, cut where it is struck again; a coreless island is one
    uncertain event. Times are frames; scoop_b and fall_a tell where a scoop ends and a fall begins."""
    own = frames.where("island IS NOT NULL")
    cores = transitions(kept(raw_cores(frames, lane), "raw-cores"), frames).where("NOT absorbed")
    found = cores.groupBy("song_id", "island").agg(F.array_sort(F.collect_list(F.struct("a", "b", "center"))).alias("x")).select("song_id", "island", F.flatten(F.transform("x", lambda s: F.array(s["a"].cast("double"), s["b"].cast("double"), s["center"]))).alias("cores"))
    whole = _together(own, ["song_id", "island"], "pitch", "confidence", "valid", "energy", "onset")
    return spread(whole.join(found, ["song_id", "island"], "left"), "song_id").select("song_id", "frames", "cores").mapInPandas(_events_of_islands, EVENTS)


#: Events of both lanes in order: a weak tail that touches a strict event of the same pitch, and wasn't struck, goes on with it.
joined_tails = operator("joined_tails", "lane_events frames_of_cores", f"""
WITH f AS (SELECT song_id, i, max(struck) OVER (PARTITION BY song_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS struck FROM (SELECT song_id, i, CASE WHEN {STRUCK} THEN 1 ELSE 0 END AS struck FROM {{frames_of_cores}}) AS x),
e AS (SELECT e.*, lag(e.b) OVER w AS before, sum(CASE WHEN e.recovered THEN 0 ELSE 1 END) OVER w AS head FROM {{lane_events}} AS e WINDOW w AS (PARTITION BY e.song_id ORDER BY e.a)),
h AS (SELECT e.*, first_value(CASE WHEN e.recovered THEN NULL ELSE e.midi END) OVER g AS head_midi, first_value(e.center) OVER g AS head_center FROM e WINDOW g AS (PARTITION BY e.song_id, e.head ORDER BY e.a)),
t AS (SELECT h.*, CASE WHEN NOT h.recovered THEN 1 WHEN h.head > 0 AND h.a = h.before AND h.midi = h.head_midi AND abs(h.center - h.head_center) <= 3e-1 AND coalesce(f.struck, 0) = 0 THEN 1 ELSE 0 END AS joins FROM h LEFT JOIN f ON f.song_id = h.song_id AND f.i = h.a),
c AS (SELECT t.*, min(joins) OVER (PARTITION BY song_id, head ORDER BY a) AS held FROM t),
p AS (SELECT *, CASE WHEN held = 1 AND head > 0 THEN first_value(a) OVER (PARTITION BY song_id, head ORDER BY a) ELSE a END AS whole FROM c)
SELECT song_id, whole AS a, max(b) AS b, max(CASE WHEN a = whole THEN midi END) AS midi, max(CASE WHEN a = whole THEN center END) AS center, max(CASE WHEN a = whole THEN core_a END) AS core_a, max(CASE WHEN a = whole THEN core_b END) AS core_b,
       max(CASE WHEN a = whole THEN spread END) AS spread, max(CASE WHEN a = whole THEN voicing END) AS voicing, max(CASE WHEN a = whole AND (uncertain OR recovered) THEN 1 ELSE 0 END) = 1 AS uncertain, max(CASE WHEN a = whole AND recovered THEN 1 ELSE 0 END) = 1 AS recovered,
       min(scoop_b) AS scoop_b, max(fall_a) AS fall_a, count(*) - 1 AS tails FROM p GROUP BY song_id, whole
""", "SG11: a weak tail that touches a strict event of the same pitch and wasn't struck goes on with it")

COLUMNS = "song_id, a, b, midi, center, core_a, core_b, spread, voicing, uncertain, recovered, scoop_b, fall_a"
crests = operator("attack_crests", "core_events frames_of_cores", f"""
WITH c AS (SELECT song_id, a AS event_a, midi, center, greatest(a, core_a - {round(0.5 / STEP)}) AS low, core_a - greatest(a, core_a - {round(0.5 / STEP)}) AS n FROM {{core_events}}
           WHERE NOT uncertain AND NOT recovered AND core_a IS NOT NULL AND (core_b - core_a) * {STEP} >= 8e-2 - 1e-9 AND scoop_b IS NOT NULL AND core_a > greatest(a, core_a - {round(0.5 / STEP)})),
e AS (SELECT c.song_id, c.event_a, c.midi, c.center, c.low, c.low + c.n AS high, c.low + d AS i FROM c [[each_below:n|d]]),
x AS (SELECT e.*, f.pitch, f.valid, f.confidence, row_number() OVER (PARTITION BY e.song_id, e.event_a ORDER BY CASE WHEN f.valid THEN 0 ELSE 1 END, f.pitch DESC, e.i) AS place, min(CASE WHEN f.valid THEN e.i END) OVER v AS first_i, max(CASE WHEN f.valid THEN e.i END) OVER v AS last_i, count(CASE WHEN f.valid THEN 1 END) OVER v AS n_valid
      FROM e JOIN {{frames_of_cores}} AS f ON f.song_id = e.song_id AND f.i = e.i WINDOW v AS (PARTITION BY e.song_id, e.event_a)),
p AS (SELECT song_id, event_a, max(CASE WHEN place = 1 THEN i END) AS peak, max(CASE WHEN place = 1 THEN pitch END) AS top, max(CASE WHEN i = first_i THEN pitch END) AS begun, max(CASE WHEN i = last_i THEN pitch END) AS ended, max(first_i) AS first_i, max(last_i) AS last_i, max(n_valid) AS n_valid FROM x GROUP BY song_id, event_a),
q AS (SELECT x.*, p.peak, p.top, x.valid AND p.top - x.pitch <= 35e-2 AS near FROM x JOIN p ON p.song_id = x.song_id AND p.event_a = x.event_a
      WHERE p.n_valid >= 5 AND p.peak > p.first_i AND p.peak < p.last_i AND p.top - x.center BETWEEN 7e-1 AND 3e0 AND p.top - p.begun >= 7e-1 AND p.top - p.ended >= 5e-1),
r AS (SELECT song_id, event_a, coalesce(max(CASE WHEN NOT near AND i < peak THEN i + 1 END), min(low)) AS lo, coalesce(min(CASE WHEN NOT near AND i > peak THEN i - 1 END), max(high) - 1) AS hi FROM q GROUP BY song_id, event_a),
w AS (SELECT q.song_id, q.event_a, q.midi, r.lo, r.hi, q.top, q.center, q.pitch, sum(q.confidence) OVER (PARTITION BY q.song_id, q.event_a ORDER BY q.pitch, q.i) AS so_far, sum(q.confidence) OVER (PARTITION BY q.song_id, q.event_a) AS whole, avg(q.confidence) OVER (PARTITION BY q.song_id, q.event_a) AS voicing
      FROM q JOIN r ON r.song_id = q.song_id AND r.event_a = q.event_a WHERE q.i BETWEEN r.lo AND r.hi AND r.hi - r.lo + 1 >= 3),
m AS (SELECT song_id, event_a, max(midi) AS midi, max(hi) + 1 AS cut, max(lo) AS lo, max(top) AS top, max(center) AS center, max(hi) - max(lo) + 1 AS near_frames, min(CASE WHEN so_far >= whole / 2 - 1e-12 THEN pitch END) AS crest, max(voicing) AS voicing FROM w GROUP BY song_id, event_a),
k AS (SELECT * FROM m WHERE CAST(floor(crest + 5e-1) AS BIGINT) <> midi)
SELECT e.song_id, coalesce(k.cut, e.a) AS a, e.b, e.midi, e.center, e.core_a, e.core_b, e.spread, e.voicing, e.uncertain, e.recovered, CASE WHEN k.cut IS NULL OR e.scoop_b > k.cut THEN e.scoop_b END AS scoop_b, e.fall_a, false AS crest
FROM {{core_events}} AS e LEFT JOIN k ON k.song_id = e.song_id AND k.event_a = e.a
UNION ALL SELECT song_id, event_a, cut, CAST(floor(crest + 5e-1) AS BIGINT), round(crest, 4), NULL, NULL, NULL, round(voicing, 3), true, false, NULL, NULL, true FROM k
""", "W22: a rise and fall of three frames or more near its peak, before a core, is an uncertain short note of its own; the observed crest, not a wished-for one")

noise = operator("absorbed_noise", "crest_events frames_of_cores", f"""
WITH s AS (SELECT song_id, i, energy, quiet, CASE WHEN {STRUCK} THEN 1 ELSE 0 END AS struck FROM {{frames_of_cores}}),
g AS (SELECT song_id, i, min(energy) OVER w >= quiet AND max(struck) OVER w = 0 AS open FROM s WINDOW w AS (PARTITION BY song_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
e AS (SELECT *, uncertain AND core_a IS NULL AND NOT crest AND (b - a) * {STEP} <= 12e-2 + 1e-8 AS brief, NOT uncertain AND core_a IS NOT NULL AND (core_b - core_a) * {STEP} >= 16e-2 - 1e-9 AS main, lag(b) OVER o AS before_b, lead(a) OVER o AS after_a FROM {{crest_events}} WINDOW o AS (PARTITION BY song_id ORDER BY a, b)),
h AS (SELECT *, sum(CASE WHEN brief THEN 0 ELSE 1 END) OVER (PARTITION BY song_id ORDER BY a, b) AS head, CASE WHEN NOT brief THEN a END AS own_a FROM e),
t AS (SELECT h.*, first_value(h.main AND NOT h.brief) OVER w AS head_main, first_value(h.center) OVER w AS head_center, first_value(h.a) OVER w AS head_a, CASE WHEN NOT h.brief OR (h.a = h.before_b AND coalesce(f.open, false)) THEN 1 ELSE 0 END AS touches, h.b = h.after_a AND coalesce(l.open, false) AS touches_next
      FROM h LEFT JOIN g AS f ON f.song_id = h.song_id AND f.i = h.a LEFT JOIN g AS l ON l.song_id = h.song_id AND l.i = h.b WINDOW w AS (PARTITION BY h.song_id, h.head ORDER BY h.a, h.b)),
n AS (SELECT *, head > 0 AND head_main AND min(touches) OVER (PARTITION BY song_id, head ORDER BY a, b) = 1 AS left_ok, lead(main) OVER o AS next_main, lead(center) OVER o AS next_center, lead(a) OVER o AS next_a FROM t WINDOW o AS (PARTITION BY song_id ORDER BY a, b)),
d AS (SELECT *, CASE WHEN NOT brief THEN a WHEN touches_next AND next_main AND (NOT left_ok OR abs(center - next_center) < abs(center - head_center)) THEN next_a WHEN left_ok THEN head_a ELSE a END AS goes_to FROM n)
SELECT song_id, min(a) AS a, max(b) AS b, {", ".join(f"max(CASE WHEN a = goes_to THEN {c} END) AS {c}" for c in ("midi", "center", "core_a", "core_b", "spread", "voicing"))},
       {", ".join(f"max(CASE WHEN a = goes_to AND {c} THEN 1 ELSE 0 END) = 1 AS {c}" for c in ("uncertain", "recovered", "crest"))}, max(CASE WHEN a = goes_to THEN scoop_b END) AS scoop_b, max(CASE WHEN a = goes_to THEN fall_a END) AS fall_a, count(*) - 1 AS absorbed FROM d GROUP BY song_id, goes_to
""", "W22: brief coreless noise that touches a long note without silence or attack between goes into its performed range, not into its core")

contour = operator("contour_targets", "crest_events", f"""
WITH n AS (SELECT *, lag(uncertain) OVER w AS left_uncertain, lag(center) OVER w AS left_center, lag(b) OVER w AS left_b, lead(uncertain) OVER w AS right_uncertain, lead(center) OVER w AS right_center, lead(a) OVER w AS right_a, lead(midi) OVER w AS right_midi FROM {{crest_events}} WINDOW w AS (PARTITION BY song_id ORDER BY a, b)),
t AS (SELECT *, uncertain AND core_a IS NOT NULL AND (core_b - core_a) * {STEP} >= 96e-3 - 1e-8 AND spread <= 15 AND voicing >= 65e-2 AND NOT left_uncertain AND NOT right_uncertain AND (right_a - b) * {STEP} <= 3e-1 + 1e-9 AND (a - left_b) * {STEP} <= 15e-2 + 1e-9
             AND center - midi >= 35e-2 AND center - midi < 5e-1 AND midi = right_midi AND center - left_center >= 15e-1 AND center - right_center BETWEEN 28e-2 AND 8e-1 AS raised FROM n)
SELECT song_id, a, b, CASE WHEN raised THEN midi + 1 ELSE midi END AS midi, CASE WHEN raised THEN midi END AS nearest_midi, center, core_a, core_b, uncertain, recovered FROM t
""", "W13: an uncertain flat peak just under a rounding boundary, before a distinct lower core of the same rounded pitch, is proposed a half tone higher")


def stable_events(frames: DataFrame) -> DataFrame:
    """SG11 over (song_id, frame, pitch, voiced, confidence, energy, onset), a frame each STEP seconds: (song_id, start_s, end_s, midi,
    nearest_midi, center, core_start_s, core_end_s, uncertain, recovered, crest, absorbed, tails).

    Strict cores make events; frames that no strict event covers are examined again with a lower threshold, and what is found
    there, uncertain, fills gaps only; then tails, crests, noise and contour targets, each reading the pass before. A song's
    cents off concert pitch are taken off first. Songs without a seeding frame have no rows. Null pitch, voicing, confidence,
    onset: none; a song without any energy has no silence, attacks or second lane.
    """
    seen = observed(frames)
    cents = tuning(frames).select("song_id", F.col("cents").alias("off")).hint("merge")
    seen = seen.join(cents, "song_id").withColumn("pitch", F.col("pitch") - F.col("off") / 100).drop("off")
    strict = kept(islands(seen.withColumn("allowed", F.lit(True)), STRICT), "strict-frames")
    first = kept(lane_events(strict, STRICT), "strict-events")
    ends = first.groupBy("song_id").agg(F.min("a").alias("first_a"), F.max("b").alias("last_b"))
    lookback = int(0.8 / STEP)
    free = strict.join(ends, "song_id").withColumn("allowed", F.col("island").isNull() & F.col("energy").isNotNull() & (F.col("i") >= F.col("first_a") - lookback) & (F.col("i") < F.col("last_b")))
    weak = kept(islands(free.drop("valid", "island", "last_b"), WEAK), "weak-frames")
    second = lane_events(weak, WEAK).where(((F.col("b") - F.col("a")) * STEP >= 0.16 - 1e-8) & (F.col("core_frames") * STEP >= 0.12 - 1e-8)).join(ends, "song_id")
    # a weak first note needs an onset within 80 ms
    near = strict.where("onset").select("song_id", F.explode(F.sequence(F.col("i") - 5, F.col("i") + 5)).alias("a")).distinct()
    second = second.join(near.withColumn("begun", F.lit(True)), ["song_id", "a"], "left").where(F.col("begun") | (F.col("a") >= F.col("first_a")))
    both = kept(first.withColumn("recovered", F.lit(False)).unionByName(second.drop("first_a", "last_b", "begun").withColumn("recovered", F.lit(True))), "events-of-both-lanes")
    whole = kept(joined_tails(both, strict), "joined-events")
    passed = kept(noise(kept(crests(whole, strict), "crest-events"), strict), "passed-events")
    out = contour(passed).join(passed.select("song_id", "a", "b", "crest", "absorbed"), ["song_id", "a", "b"]).join(whole.groupBy("song_id", "core_a").agg(F.max("tails").alias("tails")), ["song_id", "core_a"], "left")
    second_of = lambda c: F.round(F.col(c) * STEP, 4)
    return out.select("song_id", second_of("a").alias("start_s"), second_of("b").alias("end_s"), "midi", "nearest_midi", "center", second_of("core_a").alias("core_start_s"), second_of("core_b").alias("core_end_s"), "uncertain", "recovered", "crest", "absorbed", F.coalesce("tails", F.lit(0)).alias("tails"))


def replayed(frames: DataFrame, after: float = 0.0, before: float | None = None) -> DataFrame:
    """X31 over the same frames, from after to before seconds: (song_id, decoder, start_s, end_s, midi, uncertain) of the baseline and of
    the stable-core decoder, times from the first of the frames kept. Songs of under three frames there have no rows."""
    time = F.col("frame") * STEP
    own = frames.where((time >= after) & ((time < before) if before is not None else F.lit(True)))
    own = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("song_id"))).where("n >= 3").drop("n")
    own = own.withColumn("frame", F.row_number().over(Window.partitionBy("song_id").orderBy("frame")) - 1)
    heard = own.select("song_id", "frame", F.when(F.col("voiced"), F.col("pitch")).alias("pitch"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("energy", F.lit(0.0)).alias("energy"), F.coalesce("onset", F.lit(False)).alias("onset"))
    old = segment_events(heard, STEP).select("song_id", F.lit("baseline").alias("decoder"), "start_s", "end_s", F.col("midi").cast("long").alias("midi"), F.lit(False).alias("uncertain"))
    return old.unionByName(stable_events(own).select("song_id", F.lit("stable cores").alias("decoder"), "start_s", "end_s", "midi", "uncertain"))


def compared(events: DataFrame, frames: DataFrame) -> DataFrame:
    """X31: of each song the events of both decoders, the uncertain ones, and the stable-core events at whose middle the baseline has
    the same pitch; warning: `energy` where frames lack it, so that no gap was bridged and no attack told. No truth is claimed."""
    missing = frames.groupBy("song_id").agg(F.max(F.col("energy").isNull()).alias("lacking"))
    both = events.withColumn("middle", (F.col("start_s") + F.col("end_s")) / 2).withColumn("slot", F.explode(F.sequence(F.floor("start_s"), F.floor("end_s"))))
    new, old = both.where("decoder = 'stable cores'"), both.where("decoder = 'baseline'").select("song_id", "slot", "midi", F.col("start_s").alias("a"), F.col("end_s").alias("b"))
    same = new.where(F.floor("middle") == F.col("slot")).join(old, ["song_id", "slot", "midi"]).where("middle >= a AND middle < b").select("song_id", "start_s").distinct().groupBy("song_id").agg(F.count(F.lit(1)).alias("same"))
    count = lambda c: F.count_if(c).alias
    totals = events.groupBy("song_id").agg(count(F.col("decoder") == "baseline")("baseline"), count(F.col("decoder") == "stable cores")("stable_cores"), count((F.col("decoder") == "stable cores") & F.col("uncertain"))("uncertain"))
    return totals.join(same, "song_id", "left").join(missing, "song_id").select("song_id", "baseline", "stable_cores", "uncertain", F.coalesce("same", F.lit(0)).cast("long").alias("same"), F.when(F.col("lacking"), "energy").alias("warning"))


_FRAMES = f"SELECT song_id, i, pitch, voiced, confidence, energy, onset, quiet, audible AND voiced AND pitch IS NOT NULL AND confidence >= 35e-2 AS valid FROM ({observed.text.replace('{frames}', '(' + adapters.VIEWS['frames'] + ') AS f')}) AS o"
_BLOCKS = f"SELECT *, CAST(floor(i / 2e1) AS BIGINT) AS block, i % 20 AS k FROM ({_FRAMES}) AS f WHERE pitch IS NOT NULL"
_MAINS = f"""SELECT song_id, block * 20 AS a, block * 20 + 16 AS b, max(CASE WHEN k = 12 THEN CAST(floor(pitch + 5e-1) AS BIGINT) END) AS midi, round(max(CASE WHEN k >= 9 AND k < 16 THEN pitch END), 4) AS center, CASE WHEN block % 3 = 0 THEN block * 20 + 2 ELSE block * 20 + 9 END AS core_a, block * 20 + 16 AS core_b,
    CAST(block % 5 AS DOUBLE) AS spread, 8e-1 AS voicing, block % 7 = 6 AS uncertain, false AS recovered, CASE WHEN block % 3 > 0 THEN block * 20 + 9 END AS scoop_b, CAST(NULL AS BIGINT) AS fall_a FROM ({_BLOCKS}) AS x WHERE k < 16 GROUP BY song_id, block HAVING max(CASE WHEN k = 12 THEN 1 END) = 1"""
_TAILS = f"""SELECT song_id, block * 20 + 16 AS a, block * 20 + 20 AS b, max(CAST(floor(pitch + 5e-1) AS BIGINT)) AS midi, round(max(pitch), 4) AS center, CAST(NULL AS BIGINT) AS core_a, CAST(NULL AS BIGINT) AS core_b, 4e1 AS spread, 4e-1 AS voicing, true AS uncertain, block % 4 = 3 AS recovered,
    CAST(NULL AS BIGINT) AS scoop_b, CAST(NULL AS BIGINT) AS fall_a FROM ({_BLOCKS}) AS x WHERE k >= 16 AND block % 2 = 0 OR k >= 16 AND block % 4 = 3 GROUP BY song_id, block"""
_BLOCK_EVENTS = f"{_MAINS} UNION ALL {_TAILS}"
#: What the passes read when they are registered alone: cores and events laid over the frames in blocks of 20.
adapters.VIEWS |= {
    "frames_of_cores": _FRAMES,
    "cores": f"SELECT song_id, block AS island, min(i) AS a, max(i) + 1 AS b, round(min(pitch), 4) AS center FROM ({_BLOCKS}) AS x WHERE k < 5 OR k >= 9 GROUP BY song_id, block, k < 5",
    "core_events": _BLOCK_EVENTS,
    "lane_events": f"SELECT * FROM ({_BLOCK_EVENTS}) AS e",
    "crest_events": f"SELECT *, a % 11 = 0 AND core_a IS NULL AS crest FROM ({_BLOCK_EVENTS}) AS e",
}
adapters.TABLES |= {name: "events" for name in ("frames_of_cores", "cores", "core_events", "lane_events", "crest_events")}


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.view(spark, sf_dir, "frames")


QUERIES = {"stable_core_events": lambda s, d: stable_events(_frames(s, d)), "decoders_compared": lambda s, d: compared(kept(replayed(_frames(s, d)), "replayed"), _frames(s, d))}
