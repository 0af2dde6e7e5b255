"""Mixing sources to target weights: pivotal dependent rounding with a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import set_aside, table, whole_row, with_copies, written

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents in one unit of rounding, and residuals that one unit of the next level takes.
UNIT_ROWS = 4096

_ROUNDED = "source_rank int, unit long, row_key long, doc_id long, size long, base int, share double, copies int"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(doc_id: Column, size: Column, source: Column) -> Column:
    return F.xxhash64(doc_id, size, source)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): size is the number of runs of non-space in the text, 0 for null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_rank, source_size, n_rows, target) of each source, null last.

    All sources together get total times all sizes, by weight. No target exceeds cap times its source's size; the excess goes
    to the others by weight until none is above: the target is min(cap * size, level * weight) for one level, found by
    summing sources in the order in which they reach their caps. Sources of size 0 get 0.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = own.withColumn("source_rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_rank") % len(weights) + 1))
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("full_at", "source_rank")
    ranked = ranked.withColumn("budget", F.lit(float(total)) * F.sum("source_size").over(everything))
    ranked = ranked.withColumn("full", F.sum("most").over(by_level)).withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(by_level))
    # source i and all before it are full at its own level if the level then needed is not below it
    level_if_before_full = (F.col("budget") - (F.col("full") - F.col("most"))) / (F.col("left") + F.col("weight"))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("full_at") > level_if_before_full, F.struct("full_at", "source_rank", level_if_before_full.alias("level")))).over(everything)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return ranked.select("source", "source_rank", "source_size", "n_rows", target.alias("target"))


def _round_unit(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs in descending size: words move at random, without bias, from one to the other until one holds whole copies."""
        pdf = pdf.sort_values(["size", "doc_id", "row_key"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        key = [seed, level, int(pdf["source_rank"].iat[0]), int(pdf["unit"].iat[0]) & 0xFFFFFFFF]
        luck = np.random.default_rng(key).random(len(pdf)).tolist()
        size, share = pdf["size"].to_numpy(dtype=float).tolist(), pdf["share"].to_numpy(dtype=float).tolist()
        copies = [-1] * len(size)
        held = -1
        for i, s in enumerate(size):
            if s == 0 or share[i] <= 1e-12 or share[i] >= 1 - 1e-12:
                copies[i] = int(share[i] > 0.5)
                continue
            if held < 0:
                held = i
                continue
            a, b = held, i
            up = min((1 - share[a]) * size[a], share[b] * s)  # words that a can gain from b
            down = min(share[a] * size[a], (1 - share[b]) * s)
            gain = up if luck[i] * (up + down) < down else -down
            share[a] += gain / size[a]
            share[b] -= gain / s
            held = -1
            for j in (a, b):
                if share[j] <= 1e-9 or share[j] >= 1 - 1e-9:
                    copies[j] = int(share[j] > 0.5)
                else:
                    held = j
        pdf["share"], pdf["copies"] = share, copies
        return pdf[["source_rank", "unit", "row_key", "doc_id", "size", "base", "share", "copies"]]

    return run


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: float = 2.0, seed: int = 11, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Whole copies of each row of sizes (doc_id, source, size): (doc_id, row_key, size, source, source_size, target, copies, taken).

    A row of a source is expected target/source_size times: its whole part surely, its fraction by pivotal rounding. Pairs of
    fractions within a unit exchange words until one is whole; a unit's last fraction goes on to the next level of the tree,
    until each source has one, which is rounded to the nearer side. So a source's taken words differ from its target by at
    most half that row's size, and units go through their rows by falling size to leave a small one. Units take hashed rows, unit_rows on average, whichever source is large, and copies of a row apart. The same rows give the same
    result. Rows of size 0 are taken 0 words; null ids are rows like others; an empty table gives no rows.
    """
    sizes = written(with_copies(sizes), "mix-sizes")
    goal = written(targets(sizes, weights, total, cap), "mix-targets")
    rows = sizes.withColumn("row_key", row_key(sizes["doc_id"], sizes["size"], sizes["source"])).join(goal, sizes["source"].eqNullSafe(goal["source"]), "inner").drop(goal["source"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(each).cast("int")).withColumn("share", each - F.floor(each))
    units = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / unit_rows)).cast("long")
    level = rows.select("source_rank", F.pmod(F.xxhash64(F.lit(seed), "row_key", "copy"), units).alias("unit"), "row_key", "doc_id", "size", "base", "share")
    done, depth = None, 0
    most = goal.agg(F.max("n_rows")).first()[0] or 0
    units_left = -(-most // unit_rows)
    while True:
        out = written(level.groupBy("source_rank", "unit").applyInPandas(_round_unit(seed, depth), _ROUNDED), f"mix-level{depth}")
        last = units_left <= 1
        copies = F.when(F.col("copies") >= 0, F.col("copies"))
        if last:
            copies = F.coalesce(copies, (F.col("share") >= 0.5).cast("int"))
        whole = out.withColumn("copies", copies).where(F.col("copies").isNotNull())
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        level = out.where(F.col("copies") < 0).withColumn("unit", F.expr(f"unit div {unit_rows}")).drop("copies")
        units_left, depth = -(-units_left // unit_rows), depth + 1
    copies = F.col("base") + F.col("copies")
    return done.join(goal, "source_rank").select("doc_id", "row_key", "size", "source", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows of no copies go, rows of two stand twice. Equal rows count as a group;
    columns beside those of documents, whatever their names, go along."""
    docs, back = set_aside(docs)
    own = docs.withColumn("_key", row_key(F.col("doc_id").cast("long"), word_count("text"), F.col("source").cast("string")))
    picked = mix(sized(docs)).groupBy(F.col("row_key").alias("_match")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    joined = own.join(picked, own["_key"] == picked["_match"])
    # rows that share a key share its copies: each gets the whole part, the first ones one more
    place = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id", whole_row(docs)))
    joined = joined.withColumn("_place", F.when(F.col("_rows") > 1, place).otherwise(1))
    times = F.expr("_copies div _rows") + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("int")
    return joined.withColumn("_times", times.cast("int")).where("_times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))).transform(back)
