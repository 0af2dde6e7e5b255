"""Reproducible shuffle into shards: a Feistel permutation of global row numbers. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, with_copies

ROUNDS = 6
#: Rows in one numbering block on average; a block is one window partition.
BLOCK_ROWS = 10_000


def _round(x: Column, left: int, right: int, rounds: int, seed: int) -> Column:
    """One pass over the domain [0, left*right): halves x div right and x mod right take turns, each moved by a hash of the other."""
    a, b = F.floor(x / F.lit(right)).cast("long"), x % F.lit(right)
    for i in range(rounds):
        key = F.lit(seed * 1_000_003 + i).cast("long")
        if i % 2 == 0:
            a = F.pmod(a + F.pmod(F.xxhash64(b, key), F.lit(left).cast("long")), F.lit(left).cast("long"))
        else:
            b = F.pmod(b + F.pmod(F.xxhash64(a, key), F.lit(right).cast("long")), F.lit(right).cast("long"))
    return a * F.lit(right) + b


def _unrolled(df: DataFrame, col: str, out: str, left: int, right: int, rounds: int, seed: int) -> DataFrame:
    """The same pass with a column for each half and round, so that no expression is repeated within another."""
    df = df.withColumn("_a", F.expr(f"{col} div {right}L")).withColumn("_b", F.col(col) % F.lit(right).cast("long"))
    for i in range(rounds):
        key = F.lit(seed * 1_000_003 + i).cast("long")
        one, other, size = ("_a", "_b", left) if i % 2 == 0 else ("_b", "_a", right)
        size = F.lit(size).cast("long")
        df = df.withColumn(one, F.pmod(F.col(one) + F.pmod(F.xxhash64(F.col(other), key), size), size))
    return df.withColumn(out, F.col("_a") * F.lit(right).cast("long") + F.col("_b")).drop("_a", "_b")


def permuted(df: DataFrame, number: str, total: int, out: str, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Column out: a permutation of 0..total-1 of the column number, computable from number, total and seed alone.

    The Feistel domain left*right is the smallest near-square that holds total, so that fewer than left of its points lie
    outside. A point outside is permuted again until it falls inside (cycle walking); it needs as many walks as there are
    points outside at most, so the walk always ends.
    """
    if total <= 0:
        return df.withColumn(out, F.col(number).cast("long"))
    left = max(1, math.isqrt(total - 1) + 1)
    right = -(-total // left)
    outside = left * right - total
    df = _unrolled(df, number, out, left, right, rounds, seed)
    if not outside:
        return df
    last = F.lit(total).cast("long")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), F.col(out), lambda at, _: F.when(at < last, at).otherwise(_round(at, left, right, rounds, seed)))
    return df.withColumn(out, F.when(F.col(out) < last, F.col(out)).otherwise(walk))


def numbered(df: DataFrame, order: list[str], total: int, out: str = "row_number", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Global row numbers 0..total-1, the same however the rows are partitioned.

    Rows are ordered by (hash block, order columns). Blocks hold about block_rows rows each, and only their counts are summed
    in one place. df has no other columns than those of order; equal rows are told apart by a number among them.
    """
    blocks = max(64, -(-total // block_rows))
    # equal rows part too: a large group of them is no large block
    df = with_copies(df, "_copy").withColumn("_block", F.pmod(F.xxhash64(*[F.col(c) for c in order], F.col("_copy")), F.lit(blocks).cast("long")))
    counts = df.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*order, "_copy")) - 1
    return df.withColumn("_within", within).join(before, "_block").withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).drop("_block", "_within", "_before", "_copy")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into shards whose row counts differ by one at most (law `rows`): columns as op2 returns them.

    Shard and slot are the permuted row number modulo and divided by the number of shards, so slots run gapless from 0.
    Null ids sort first, a null text is as long as an empty one and has checksum 0, repeated rows get a slot each, an empty
    table gives no rows. Rows are named by (id, size, checksum): the shuffle never moves the texts. Copies of a text are
    separate rows here; the law for row counts leaves no room for keeping a large group of copies in one shard.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    total = docs.count()
    out = permuted(numbered(rows, ["doc_id", "size", "text_crc32"], total), "row_number", total, "place", seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)
