"""Two scores compared by the lyrics they share, and reads of one page merged."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import adapters
from .decoders import spread

#: Lengths of lyric phrases that may be landmarks.
SIZES = (5, 4, 3)
#: Pages whose observations are Python objects at once.
TOGETHER = 64


def _own(df: DataFrame, **types: str) -> DataFrame:
    """The same rows as columns of their own, so that tables made from one another can meet."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.expr(f"`{c}` AS `{c}`") for c in df.columns])


def landmarks(sung: DataFrame, written: DataFrame) -> DataFrame:
    """J13: phrases of 5, 4 and 3 characters that stand once on both sides of a pair, as (pair_id, left_at, right_at, time, position,
    size) of their middle characters, the longest of each pair of places. sung: (pair_id, place, text, at); written: (pair_id,
    place, text, note_place, position). Phrases whose middle has no time are left out."""

    def phrases(df: DataFrame, size: int, *kept: str) -> DataFrame:
        w = Window.partitionBy("pair_id").orderBy("place")
        gram = F.concat(*[F.lead("text", i).over(w) for i in range(size)])
        middle = [F.lead(c, size // 2).over(w).alias(c) for c in kept]
        once = F.count(F.lit(1)).over(Window.partitionBy("pair_id", "gram")) == 1
        return df.select("pair_id", gram.alias("gram"), *middle).where("gram IS NOT NULL").withColumn("once", once).where("once").drop("once")

    sung, written = _own(sung, at="double"), _own(written, position="double")
    found = None
    for size in SIZES:
        left = phrases(sung, size, "place", "at").withColumnRenamed("place", "left_at").withColumnRenamed("at", "time")
        right = phrases(written, size, "note_place", "position").withColumnRenamed("note_place", "right_at")
        part = left.join(right, ["pair_id", "gram"]).where("time IS NOT NULL AND position IS NOT NULL").select("pair_id", "left_at", "right_at", "time", "position", F.lit(size).alias("size"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("pair_id", "left_at", "right_at").agg(F.max(F.struct("size", "time", "position")).alias("x")).select("pair_id", "left_at", "right_at", "x.time", "x.position", "x.size")


def heaviest_rise(points: np.ndarray, weight: np.ndarray) -> list[int]:
    """Places of the heaviest chain of points in which every column rises strictly; the first of equal ones."""
    best, before = weight.astype(float).copy(), np.full(len(weight), -1)
    for i in range(1, len(weight)):
        ok = np.flatnonzero((points[:i] < points[i]).all(1))
        if len(ok):
            best[i], before[i] = best[at := ok[best[ok].argmax()]] + weight[i], at
    at, chain = int(best.argmax()) if len(best) else -1, []
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return chain[::-1]


def thinned(position: np.ndarray, time: np.ndarray, size: np.ndarray) -> list[int]:
    """Landmarks of one place and moment (.7 whole beats, 2 s) count once: the longest, then the first."""
    kept: list[int] = []
    for i in range(len(position)):
        if kept and position[i] - position[kept[-1]] < 0.7 and time[i] - time[kept[-1]] < 2:
            if size[i] > size[kept[-1]]:
                kept[-1] = i
        else:
            kept.append(i)
    return kept


def anchored_times(sung: DataFrame, written: DataFrame, notes: DataFrame) -> DataFrame:
    """X7: recording times of written notes (pair_id, note_place, start, end) between landmarks of shared lyrics, straight lines
    between neighbouring ones and on beyond the first and the last. Pairs with fewer than two landmarks give no row."""

    def run(key: tuple, marks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        marks, rows = marks.sort_values(["right_at", "left_at"]), rows.sort_values("note_place")
        p = marks[["right_at", "left_at", "time", "position"]].to_numpy(float)
        chain = heaviest_rise(p, marks["size"].to_numpy())
        t, x, size = p[chain, 2], p[chain, 3], marks["size"].to_numpy()[chain]
        kept = thinned(x, t, size)
        t, x = t[kept], x[kept]
        if len(t) < 2:
            return pd.DataFrame({"pair_id": [], "note_place": [], "start_s": [], "end_s": [], "anchors": []})

        def mapped(at: np.ndarray) -> np.ndarray:
            i = np.clip(np.searchsorted(x, at), 1, len(x) - 1)
            return np.round(t[i - 1] + (at - x[i - 1]) / (x[i] - x[i - 1]) * (t[i] - t[i - 1]), 4)

        return pd.DataFrame({"pair_id": key[0], "note_place": rows["note_place"], "start_s": mapped(rows["start"].to_numpy(float)), "end_s": mapped(rows["end"].to_numpy(float)), "anchors": len(t)})

    schema = "pair_id long, note_place long, start_s double, end_s double, anchors long"
    return landmarks(sung, written).groupBy("pair_id").cogroup(_own(notes).groupBy("pair_id")).applyInPandas(run, schema)


def merged_reads(notes: DataFrame, near: float = 13.0) -> DataFrame:
    """J7, U5 over (measure_id, place, second, x, lyric): notes of two reads of a measure. One of the second read that lies within
    `near` pixels of the nearest note kept so far is that note, and gives it its lyric where it has none."""
    note = "struct<x:double,place:bigint,lyric:string,second:boolean>"
    kept = f"array<{note}>"
    one = lambda r: F.struct(r["x"].alias("x"), r["place"].alias("place"), r["lyric"].alias("lyric"), (r["second"] > 0).alias("second"))

    def met(acc, r):
        nearest = F.array_min(F.transform(acc, lambda k, i: F.struct(F.abs(k["x"] - r["x"]).alias("apart"), i.alias("i"))))
        given = F.transform(acc, lambda k, i: F.struct(k["x"].alias("x"), k["place"].alias("place"), F.when(i == nearest["i"], F.coalesce(k["lyric"], r["lyric"])).otherwise(k["lyric"]).alias("lyric"), k["second"].alias("second")).cast(note))
        return F.when((r["second"] > 0) & F.coalesce(nearest["apart"] < near, F.lit(False)), given).otherwise(F.concat(acc, F.array(one(r).cast(note)))).cast(kept)

    # the notes of one measure are few; they stay one row
    row = F.struct(F.col("second").cast("int").alias("second"), F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"), F.col("lyric").alias("lyric"))
    reads = notes.groupBy("measure_id").agg(F.array_sort(F.collect_list(row)).alias("reads"))
    merged = reads.select("measure_id", F.explode(F.aggregate("reads", F.array().cast(kept), met)).alias("k"))
    return merged.select("measure_id", "k.place", "k.x", "k.lyric", "k.second")


def _insorted(values: list[float], new: list[float], clean: bool) -> None:
    """Values stay sorted, as numpy does it where some are no numbers."""
    if clean:
        for v in new:
            insort(values, v)
    else:
        values[:] = np.sort(np.array([*values, *new], dtype=float)).tolist()


def _rows_of_page(place: list, y: list, height: list, lyric: list, music: list, ys: list, heights: list) -> list[int]:
    """The row of each observation of one page, numbered from the top."""
    number = lambda v: math.nan if v is None else v
    y, height = [number(v) for v in y], [number(v) for v in height]
    ys, heights = ([[number(v) for v in g or ()] for g in c] for c in (ys, heights))
    clean = not any(v != v for c in (*ys, *heights) for v in c)
    groups: list[dict] = []
    found = [0] * len(place)
    for i in sorted(range(len(place)), key=lambda i: (place[i] is None, place[i])):
        at, tall, sung, played = y[i], height[i], lyric[i], music[i]
        for g in groups:
            if (g["lyric"] == sung or (g["music"] and played)) and abs(g["y"] - at) < max(0.018, 0.55 * min(g["height"], tall)):
                _insorted(g["ys"], ys[i], clean)
                _insorted(g["heights"], heights[i], clean)
                g["y"], g["height"] = g["ys"][len(g["ys"]) // 2], g["heights"][len(g["heights"]) // 2]
                break
        else:
            g = {"y": at, "height": tall, "lyric": sung, "music": played, "ys": [], "heights": []}
            _insorted(g["ys"], ys[i], clean)
            _insorted(g["heights"], heights[i], clean)
            groups.append(g)
        g.setdefault("members", []).append(i)
    groups.sort(key=lambda g: g["y"])
    for n, g in enumerate(groups):
        for i in g["members"]:
            found[i] = n
    return found


def baseline_rows(observations: DataFrame) -> DataFrame:
    """X24 over (page_id, place, y, height, lyric, music): the printed row of each observation, by its middle. An observation joins
    the first row of its kind (lyrics or not, or both mostly music) whose median lies within .55 of the smaller height, .018 at
    least; rows are numbered from the top. Where observations have ys and heights, those of their glyphs, a row's medians are over
    glyphs; of an even number, the upper one. A row of a batch holds one page."""

    y, height = (F.col(c).cast("double").alias(c) for c in ("y", "height"))
    one = lambda c: F.col(f"{c}s").cast("array<double>") if f"{c}s" in observations.columns else F.array(F.col(c).cast("double"))
    row = F.struct("place", y, height, F.col("lyric"), F.col("music"), one("y").alias("ys"), one("height").alias("heights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                pages, lists = batch.slice(start, TOGETHER).columns
                place, *columns = (c.to_pylist() for c in lists.flatten().flatten())
                ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
                number: list[int] = []
                for a, z in zip([0, *ends], ends, strict=False):
                    number += _rows_of_page(place[a:z], *(c[a:z] for c in columns))
                page = np.repeat(np.arange(len(pages)), np.diff([0, *ends]))
                yield pa.RecordBatch.from_arrays([pages.cast(pa.int64()).take(pa.array(page)), pa.array(place, pa.int64()), pa.array(number, pa.int64())], names=["page_id", "place", "page_row"])

    pages = spread(observations.withColumn("seen", row), "page_id").groupBy("page_id").agg(F.collect_list("seen").alias("seen"))
    return pages.mapInArrow(run, "page_id long, place long, page_row long")


def _pair(spark, sf_dir):
    """Characters as sung, and the same written out with every eleventh left out and a new one at every thirteenth."""
    c = adapters.view(spark, sf_dir, "characters").withColumnRenamed("song_id", "pair_id")
    sung = c.selectExpr("pair_id", "char_id AS place", "text", "start_s AS at")
    order = "row_number() OVER (PARTITION BY pair_id ORDER BY char_id)"
    written = c.where("char_id % 11 > 0").selectExpr("pair_id", "char_id AS place", "CASE WHEN char_id % 13 = 0 THEN '雪' ELSE text END AS text", f"CAST({order} AS BIGINT) AS note_place", f"{order} * 0.5 AS position")
    return sung, written, written.selectExpr("pair_id", "note_place", "position AS start", "position + 0.5 AS end")


def _reads(spark, sf_dir):
    n = adapters.view(spark, sf_dir, "notes").selectExpr("measure_id", "note_id", "n_idx", "degree")
    return n.where("n_idx % 4 > 0").selectExpr("measure_id", "note_id AS place", "0 AS second", "n_idx * 20.0 AS x", "CAST(NULL AS STRING) AS lyric").unionByName(
        n.selectExpr("measure_id", "note_id AS place", "1 AS second", "n_idx * 20.0 + degree * 2 - 7 AS x", "CASE WHEN degree > 2 THEN CAST(degree AS STRING) END AS lyric"))


def _observed(spark, sf_dir):
    n = adapters.view(spark, sf_dir, "notes")
    return n.selectExpr("score_id AS page_id", "note_id AS place", "m_idx * 0.03 + degree * 0.001 AS y", "0.012 + base * 0.0004 AS height", "degree = 0 AS lyric", "accidental = 0 AS music")


QUERIES = {
    "anchored_times": lambda s, d: anchored_times(*_pair(s, d)),
    "merged_reads": lambda s, d: merged_reads(_reads(s, d)),
    "baseline_rows": lambda s, d: baseline_rows(_observed(s, d)),
}
