"""Onsets on a grid: which events of a slot are sung, evidence that an early entry belongs to the bar after it, and one path for a song."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import adapters
from .decoders import spread

#: Grid units of a bar; the least core in seconds that counts as stable.
BAR, CORE = 16, 0.08
PLACED = "song_id long, event_id long, unit long, reason string, core_share double, energy_share double, pickups long, moved boolean"


def _unit(time: str) -> Column:
    return (F.col(time) - F.col("anchor_s")) / F.col("step_s")


def sung_events(events: DataFrame) -> DataFrame:
    """Of each grid slot, the events that count: a recovered one that another covers by half is an alternative reading, no second
    note; all that are manual, crests, or last half a unit stay; if none does, the one of highest priority, then weight."""
    slot = Window.partitionBy("song_id", "slot")
    own = events.withColumns({"u": _unit("start_s"), "u_end": _unit("end_s"), "u_a": _unit("core_start_s"), "u_b": _unit("core_end_s")}).where("end_s > start_s")
    own = own.withColumns({"slot": F.floor(F.col("u") + 0.5), "priority": F.when(F.col("manual"), 3).when(F.col("recovered"), 1).otherwise(2), "worth": (F.col("end_s") - F.col("start_s")) * F.coalesce("confidence", F.lit(0.0))})
    firm = F.collect_list(F.when(~F.col("recovered"), F.struct("event_id", "start_s", "end_s"))).over(slot)
    covered = F.exists("firm", lambda o: (o["event_id"] != F.col("event_id")) & (F.least(F.col("end_s"), o["end_s"]) - F.greatest(F.col("start_s"), o["start_s"]) > (F.col("end_s") - F.col("start_s")) * 0.5))
    own = own.withColumn("firm", firm).withColumn("eligible", ~F.col("recovered") | F.col("manual") | F.col("crest") | ~covered).drop("firm")
    own = own.withColumn("sustained", F.col("eligible") & (F.col("manual") | F.col("crest") | (F.col("u_end") - F.col("u") >= 0.5)))
    order = slot.orderBy(F.desc("eligible"), F.desc("priority"), F.desc("worth"), "start_s", "event_id")
    own = own.withColumns({"any_sustained": F.max("sustained").over(slot), "place": F.row_number().over(order)})
    return own.where("sustained OR NOT any_sustained AND place = 1").drop("any_sustained", "place", "sustained", "eligible", "slot")


def bar_evidence(sung: DataFrame, bar: int = BAR) -> DataFrame:
    """sung_events with boundary and bonus where an early entry is evidence for the bar line after it, and what the evidence is.

    Ordinary: under .9 units early, core and energy mostly beyond the line. A phrase's entry may be a whole unit early if it
    is short, rests before it, and three stable attacks follow on the eighths. Two pickups in the same melodic context
    that were sung before their line on purpose lessen the bonus.
    """
    song = Window.partitionBy("song_id").orderBy("start_s", "event_id")
    stable = F.coalesce(~F.col("manual") & ~F.col("recovered") & ~F.col("uncertain") & (F.col("core_end_s") - F.col("core_start_s") >= CORE), F.lit(False))
    e = sung.withColumns({"stable": stable, "boundary": F.ceil(F.col("u") / bar) * bar}).withColumn("early", F.col("boundary") - F.col("u"))
    share = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b - F.greatest(a, F.col("boundary"))) / (b - a)))
    width = (F.col("u_end") - F.col("u")) / F.size("weights")
    good = F.transform("weights", lambda w: F.when(w.isNotNull() & ~F.isnan(w) & (w >= 0), w).otherwise(0.0))
    parts = F.transform(good, lambda w, i: w * share(F.col("u") + i * width, F.col("u") + (i + 1) * width))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    e = e.withColumns({"core_share": share(F.col("u_a"), F.col("u_b")), "energy_share": F.when(total(good) > 0, total(parts) / total(good))})
    ahead = {f"next_{j}": F.lead(F.struct("u", "stable"), j).over(song) for j in (1, 2, 3)}
    e = e.withColumns({"before": F.lag("u_end").over(song), "left": F.lag("midi").over(song), "right": F.lead("midi").over(song), **ahead})
    offset = lambda j: F.col(f"next_{j}.u") - F.col("boundary")
    at = lambda j: F.floor(offset(j) / 2 + 0.5) * 2
    follows = F.lit(True)
    for j in (1, 2, 3):
        follows &= F.col(f"next_{j}.stable") & at(j).between(2, 8) & (F.abs(offset(j) - at(j)) <= 0.4) & ((at(j) > at(j - 1)) if j > 1 else F.lit(True))
    ordinary = (F.col("early") <= 0.9) & (F.col("u_a") >= F.col("boundary") - 0.85) & (F.col("u_end") >= F.col("boundary") + 0.5) & (F.col("core_share") >= 0.6) & F.when(F.col("energy_share").isNotNull(), F.col("energy_share") >= 0.6).otherwise(F.col("core_share") >= 0.65)
    entry = (F.col("early") >= 0.5) & (F.col("before").isNull() | (F.col("u") - F.col("before") >= 8)) & (F.col("u_end") - F.col("u") <= 4) & (F.col("u_end") >= F.col("boundary") + 1) & (F.col("core_share") >= 0.55) & (F.col("energy_share") >= 0.5) & follows
    open_ = F.col("stable") & (F.col("early") > 0) & (F.col("early") <= 1.15)
    e = e.withColumns({"entry": F.coalesce(open_ & entry, F.lit(False)), "ordinary": F.coalesce(open_ & ordinary, F.lit(False))})
    pickup = F.coalesce(~F.col("uncertain") & F.col("early").between(0.85, 1.15) & (F.col("u_a") < F.col("boundary") - 0.75) & F.col("u_b").isNotNull(), F.lit(False)).cast("long")
    e = e.withColumns({"pickup": pickup, "length": F.round((F.col("end_s") - F.col("start_s")) * 1e6).cast("long")})
    alike = Window.partitionBy("song_id", "left", "midi", "right").orderBy("length").rangeBetween(-119_999, 119_999)
    e = e.withColumn("pickups", F.sum("pickup").over(alike) - F.col("pickup"))
    bonus = F.greatest(F.lit(0.0), F.when(F.col("entry"), 1.4).otherwise(0.75 * F.col("core_share") + 0.45 * F.coalesce("energy_share", "core_share") - 0.05) - F.when(F.col("pickups") >= 2, 0.8).otherwise(0.0))
    held = F.col("entry") | F.col("ordinary")
    return e.select("song_id", "event_id", "start_s", "u", "manual", "priority", "worth", "entry", "core_share", "energy_share", "pickups", F.when(held, F.col("boundary")).cast("long").alias("boundary"), F.when(held, bonus).alias("bonus"))


def _path(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The cheapest rising path: squared distances, .08 for an odd length over one, less the bonus of a boundary."""
    rows = rows.sort_values(["start_s", "event_id"]).reset_index(drop=True)
    states: list[tuple[float, float, tuple | None]] = [(float("-inf"), 0.0, None)]  # unit, cost, (state before, row)
    for r in rows.itertuples():
        nearest = max(0, int((r.u + 0.5) // 1))
        wanted = [nearest] if r.manual else [x for x in sorted({max(0, int(r.u // 1)), max(0, int(-(-r.u // 1)))}) if abs(x - r.u) <= 0.8]
        marked = not pd.isna(r.boundary)
        if marked and int(r.boundary) not in wanted:
            wanted.append(int(r.boundary))
        found = []
        for unit in wanted:
            best = None
            for state in states:
                if unit <= state[0]:
                    continue
                length = unit - state[0]
                odd = 0.08 if length != float("inf") and length > 1 and length % 2 == 1 else 0.0
                cost = state[1] + (unit - r.u) ** 2 + odd - (r.bonus if marked and unit == int(r.boundary) else 0.0)
                if best is None or cost < best[1]:
                    best = (unit, cost, (state, r))
            if best:
                found.append(best)
        if not found:
            # a collision is settled here alone: the better of the two keeps the place
            held = min(states, key=lambda s: s[1])
            before, other = held[2]
            better = (r.priority, r.worth) > (other.priority, other.worth)
            found = [(nearest, before[1] + (nearest - r.u) ** 2, (before, r))] if better and nearest > before[0] else [held]
        states = found
    at, out = min(states, key=lambda s: s[1]), []
    while at[2]:
        before, r = at[2]
        unit, on_line = int(at[0]), not pd.isna(r.boundary) and at[0] == r.boundary
        reason = "manual-position" if r.manual else ("phrase-entry-to-downbeat" if r.entry else "early-entry-to-downbeat") if on_line else "nearest-grid-with-context"
        evidence = (round(r.core_share, 6), None if pd.isna(r.energy_share) else round(r.energy_share, 6), int(r.pickups)) if not pd.isna(r.boundary) else (None, None, None)
        out.append((key[0], int(r.event_id), unit, reason, *evidence, unit != max(0, int((r.u + 0.5) // 1))))
        at = before
    return pd.DataFrame(out[::-1], columns=[c.split()[0] for c in PLACED.split(", ")]).astype({"pickups": "Int64"})


def placed_onsets(events: DataFrame, bar: int = BAR) -> DataFrame:
    """DP5 over events (song_id, event_id, start_s, end_s, midi, confidence, core_start_s, core_end_s, manual, uncertain, recovered,
    crest, weights: energy from start to end, anchor_s, step_s: the grid): PLACED, a row for each event that has a place.

    Pitches and times of events stay; only their places on the grid are chosen. Manual ones keep the nearest place. Slots,
    shares, contexts and bonuses are windows; the path is a fold over a song's events.
    """
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("manual", "uncertain", "recovered", "crest")}
    evidence = bar_evidence(sung_events(events.withColumns(flags)), bar)
    return spread(evidence, "song_id").groupBy("song_id").applyInPandas(_path, PLACED)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.view(spark, sf_dir, "note_events")
    weights = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("event_id") + i * 3) % 5 + i * (F.col("event_id") % 3)).cast("double"))
    return e.select("song_id", "event_id", "start_s", "end_s", "midi", "confidence", F.col("core_start").alias("core_start_s"), F.col("core_end").alias("core_end_s"), (F.col("event_id") % 19 == 0).alias("manual"), "uncertain", F.col("recovery_reason").isNotNull().alias("recovered"), (F.col("event_id") % 37 == 0).alias("crest"), weights.alias("weights"), F.lit(0.0).alias("anchor_s"), F.lit(0.125).alias("step_s"))


QUERIES = {"placed_onsets": lambda s, d: placed_onsets(_events(s, d))}
