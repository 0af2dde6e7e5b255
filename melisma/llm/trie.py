"""Prefix trie of conversations, with subtree sums by heavy-path decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, table, written

#: Turns of one conversation, and nodes of one path array, that a window holds at most; longer ones are cut into such blocks.
BLOCK = 65_536
#: Conversation ids in one piece of text of a node's members.
IDS = 4096
#: Conversations that share the first turns of one.
GROUP = 20
#: Most shared turns, plus one.
SHARED = 4


def _streamed(keys: list[str], names: list[str]):
    """Number the rows of each run of equal keys from 1, in a partition that is sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(n, dtype=bool)
            new[0] = tuple(c[0] for c in cols) != last
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.arange(n)
            begun = np.maximum.accumulate(np.where(new, at, -1))
            number = np.where(begun < 0, at + 1 + count, at - begun + 1)
            last, count = tuple(c[-1] for c in cols), int(number[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(number.astype(np.int64))], names=[*names, "at"])

    return run


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, a, b, words): every turn's place in its conversation from 1, two hashes of its role and text, its words.

    Rows are dealt by ranges of (conversation, turn), so a conversation with a large part of all turns is numbered by many
    tasks; those between two partitions are put together from counts, two for each partition at most.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    small = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("b"), text, role).alias("b"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "a", "b", "row"]
    names = ["part", "conv_id", "a", "b", "words"]
    # written, so that texts are read once, and not again to find the ranges
    parts = written(small, "turn-hashes").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    numbered = written(parts.select(*names).mapInArrow(_streamed(["conv_id"], names), "part int, conv_id long, a long, b long, words long, at long"), "turns")
    edges = Window.partitionBy("conv_id").orderBy("part")
    counts = numbered.groupBy("conv_id", "part").agg(F.max("at").alias("n"))
    carried = counts.withColumn("before", F.sum("n").over(edges) - F.col("n")).where("before > 0").select("conv_id", "part", "before")
    # one conversation at most is carried into a partition
    return numbered.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("i"), "a", "b", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): each conversation c as the first h turns of conversation c - c % group, then its own after h.

    h = crc32(c in decimal) % shared. rows: (conv_id, depth, a, b, words), depth from 1; conversations: (conv_id, length).
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = written(convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_own", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "own", "h", "m", "length"), "conversations")
    heads = turns.where(F.col("i") < shared).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "m"), "base").where("i <= m")
    # a conversation's row here stands for one block of its turns
    blocks = convs.select("conv_id", "h", "m", F.explode(F.expr(f"sequence(0L, own div {BLOCK}L)")).alias("block"))
    own = turns.withColumn("block", F.expr(f"i div {BLOCK}L")).join(blocks, ["conv_id", "block"]).where("i > h")
    rows = heads.select("conv_id", F.col("i").alias("depth"), "a", "b", "words").unionByName(own.select("conv_id", (F.col("i") - F.col("h") + F.col("m")).alias("depth"), "a", "b", "words"))
    return rows, convs.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with (a, b) that name the whole sequence of turns so far, and (pa, pb) that name it without the last turn.

    A prefix is the exclusive or of hashes of its turns and their places: 128 bits, which add up in any order and so in
    blocks of a long conversation.
    """
    block = F.expr(f"depth div {BLOCK}L")
    placed = rows.select("conv_id", "depth", block.alias("block"), "words", F.xxhash64("a", "b", "depth").alias("x"), F.xxhash64("depth", "b", "a", F.lit(1)).alias("y"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = written(placed.withColumn("a", F.bit_xor("x").over(so_far)).withColumn("b", F.bit_xor("y").over(so_far)), "prefixes")
    long = within.where(F.col("depth") >= BLOCK - 1).select("conv_id").distinct()
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = within.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    carried = totals.select("conv_id", "block", F.bit_xor("x").over(earlier).alias("ca"), F.bit_xor("y").over(earlier).alias("cb")).where("ca is not null")
    zero = F.lit(0).cast("long")
    whole = within.join(carried, ["conv_id", "block"], "left").withColumn("a", F.col("a").bitwiseXOR(F.coalesce("ca", zero))).withColumn("b", F.col("b").bitwiseXOR(F.coalesce("cb", zero)))
    return whole.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words")


NODE = ["depth", "a", "b"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation, as comma-joined pieces of at most IDS ids."""
    key, ids = None, []
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "first", "ids"])
        out.clear()
        return found

    for batch in batches:
        for *k, c in zip(*(batch[n].to_pylist() for n in (*NODE, "conv_id")), strict=True):
            if k != key or len(ids) == IDS:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = k, []
            ids.append(c)
        if out:
            yield flushed()
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    yield flushed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a node follow each other: one digest runs along them."""
    key, running = None, None
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out = []
        for *k, ids in zip(*(batch[n].to_pylist() for n in (*NODE, "ids")), strict=True):
            if k != key:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = k, hashlib.sha256()
                running.update(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=kind) for i, kind in enumerate(kinds)], names=[*NODE, "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=kind) for x, kind in zip((*key, running.hexdigest()), kinds, strict=True)], names=[*NODE, "ends_sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) for rows (node, conv_id): SHA-256 of each node's ids in decimal, ascending, comma-joined.

    Ids are joined to pieces where ranges of (node, id) put them, so a node with a large part of all ids sends its task one
    row for each IDS of them, and the digest runs along the pieces without holding them.
    """
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def chained(parts: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, start, last_conv, last_start, values): for each part of a path the path's last part, and sums of values over
    the part and all parts after it.

    parts: (conv_id, start, next_conv, next_start, values); each is next of one part at most. Pointers double, so the rounds
    grow with the logarithm of a path's number of parts; only parts that haven't reached the end take part.
    """
    at = parts.select("conv_id", "start", "next_conv", "next_start", F.col("conv_id").alias("last_conv"), F.col("start").alias("last_start"), *values)
    at = written(at, "path-parts")
    while at.where("next_conv is not null").limit(1).count():
        ahead = at.select(*[F.col(c).alias(f"_{c}") for c in at.columns])
        near = at.where("next_conv is not null").join(ahead, (F.col("next_conv") == F.col("_conv_id")) & (F.col("next_start") == F.col("_start")))
        moved = near.select("conv_id", "start", F.col("_next_conv").alias("next_conv"), F.col("_next_start").alias("next_start"), F.col("_last_conv").alias("last_conv"), F.col("_last_start").alias("last_start"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
        at = written(at.where("next_conv is null").unionByName(moved), "path-parts")
    return at.drop("next_conv", "next_start")


def _sum(columns: list[str]) -> list:
    return [F.sum(c).alias(c) for c in columns]


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes with each of values summed over a node's subtree, itself included.

    nodes: (conv_id, depth), which name a node; parent_conv, its parent's conv_id (null: root); heavy_conv, the conv_id of its
    largest child (null: childless). Heavy edges make path arrays; a light child holds half of its parent's members at most,
    so light paths hang below each other at most log2(members) deep, and their totals climb in as many rounds. On a path,
    sums are taken within parts (consecutive nodes of one conv_id, BLOCK at most) and then along the chain of parts.
    """
    cut = nodes.withColumn("ends", F.col("heavy_conv").isNull() | (F.col("heavy_conv") != F.col("conv_id")) | (F.col("depth") % BLOCK == BLOCK - 1)).withColumn("block", F.expr(f"depth div {BLOCK}L"))
    # a part is named by its first depth: behind the last end before, or where the block or the conversation begins
    earlier = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("depth").over(Window.partitionBy("conv_id", "block"))
    placed = written(cut.withColumn("start", F.coalesce(F.max(F.when(F.col("ends"), F.col("depth") + 1)).over(earlier), first)), "trie-parts")
    parts = placed.groupBy("conv_id", "start").agg(F.max(F.when(F.col("ends"), F.col("heavy_conv"))).alias("next_conv"), F.max("depth").alias("bottom"), F.max(F.when(F.col("depth") == F.col("start"), F.col("parent_conv"))).alias("parent_conv"), *_sum(values))
    parts = written(parts.withColumn("next_start", F.when(F.col("next_conv").isNotNull(), F.col("bottom") + 1)), "trie-path-parts")
    ranked = chained(parts.select("conv_id", "start", "next_conv", "next_start", *values), values)
    # the top of a path is no part's next; its totals climb to the part that holds its parent
    tops = parts.select("conv_id", "start", "parent_conv").join(parts.where("next_conv is not null").select(F.col("next_conv").alias("conv_id"), F.col("next_start").alias("start")), ["conv_id", "start"], "left_anti")
    tops = tops.join(ranked, ["conv_id", "start"]).where("parent_conv is not null")
    tops = written(tops.select("last_conv", "last_start", "parent_conv", (F.col("start") - 1).alias("parent_depth"), *values), "trie-paths")
    holders = tops.select(F.col("parent_conv").alias("conv_id"), F.col("parent_depth").alias("depth")).distinct().join(placed.select("conv_id", "depth", "start"), ["conv_id", "depth"])
    holders = written(holders.join(ranked.select("conv_id", "start", "last_conv", "last_start"), ["conv_id", "start"]).select(F.col("conv_id").alias("parent_conv"), F.col("depth").alias("parent_depth"), "last_conv", "last_start"), "trie-parents")
    climbing, attached = tops, None
    path_of = tops.select("last_conv", "last_start", "parent_conv", "parent_depth")
    while True:
        here = written(climbing.groupBy("parent_conv", "parent_depth").agg(*_sum(values)), "trie-attached")
        attached = here if attached is None else attached.unionByName(here)
        totals = here.join(holders, ["parent_conv", "parent_depth"]).groupBy("last_conv", "last_start").agg(*_sum(values))
        climbing = written(totals.join(path_of, ["last_conv", "last_start"]), "trie-climbing")
        if not climbing.limit(1).count():
            break
    light = attached.groupBy(F.col("parent_conv").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(*[F.sum(v).alias(f"light_{v}") for v in values])
    whole = placed.join(light, ["conv_id", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"light_{v}", F.lit(0)) for v in values}).drop(*[f"light_{v}" for v in values])
    whole = written(whole, "trie-whole")
    sums = whole.groupBy("conv_id", "start").agg(*_sum(values))
    after = chained(parts.select("conv_id", "start", "next_conv", "next_start").join(sums, ["conv_id", "start"]), values).join(sums.select("conv_id", "start", *[F.col(v).alias(f"part_{v}") for v in values]), ["conv_id", "start"])
    below = Window.partitionBy("conv_id", "start").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = whole.withColumns({v: F.sum(v).over(below) for v in values})
    carry = after.select("conv_id", "start", *[(F.col(v) - F.col(f"part_{v}")).alias(f"after_{v}") for v in values])
    return summed.join(carry, ["conv_id", "start"]).withColumns({v: F.col(v) + F.col(f"after_{v}") for v in values}).drop("start", "ends", "block", *[f"after_{v}" for v in values])


def trie(df: DataFrame, group: int = GROUP, shared: int = SHARED, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations (columns as op12 returns them).

    Turns are ordered by turn, null first, repeated turns by a hash of role and text; null role or text counts as empty.
    Rows with a null conversation belong to none. An empty table gives no rows: there is no conversation, so no root.
    Repeated rows are turns of their own. A sequence is named by its depth and 128 bits of hashes. Other columns are not read.
    """
    rows, convs = rebuilt(ordered_turns(df, conv_col, turn_col, role_col, text_col), group, shared)
    pre = written(prefixes(rows), "trie-rows")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("words"))
    found = pre.unionByName(root).groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("words").alias("words"))
    nodes = written(found, "trie-nodes")
    # children of a parent: how many, and the largest (ties: the smaller conv_id)
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    families = written(nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"))).alias("largest")).select(*NODE, "n_children", (-F.col("largest")["col2"]).alias("heavy_conv")), "trie-families")
    parents = nodes.join(families, NODE).select(*[F.col(c).alias(f"p_{c}") for c in NODE], F.col("conv_id").alias("parent_conv"), "n_children")
    asking = nodes.where("depth > 0").select(*NODE, (F.col("depth") - 1).alias("p_depth"), F.col("pa").alias("p_a"), F.col("pb").alias("p_b"))
    asked = looked_up(asking, written(parents, "trie-parents-of"), ["p_depth", "p_a", "p_b"], "n_children", nodes.count()).select(*NODE, "parent_conv")
    lengths = convs.withColumnRenamed("length", "depth")
    ends = pre.select(*NODE, "conv_id").join(lengths, ["conv_id", "depth"], "left_semi").unionByName(lengths.where("depth = 0").select("depth", zero.alias("a"), zero.alias("b"), "conv_id"))
    full = nodes.join(families, NODE, "left").join(asked, NODE, "left").join(member_digests(ends), NODE, "left")
    full = full.select(
        "conv_id", "depth", F.col("parent_conv"), "heavy_conv", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.when(F.col("heavy_conv").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    out = subtree_sums(written(full, "trie-full"), ["n_leaves", "saved_tokens"])
    return out.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of an ASCII text, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda s, x: list_reduce(range(8), lambda t, i: xor(t >> 1, 3988292384 * (t & 1)), xor(s, x)), CAST(4294967295 AS BIGINT)), 4294967295)"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC.format(c="conv_id")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1 AS own, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), p AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS path, text FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, [], '' FROM c
), l AS (
  SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id
), n AS MATERIALIZED (
  SELECT p.path, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = l.length), '')) AS ends_sha256,
    (count(*) - 1) * len(regexp_extract_all(any_value(p.text), '[^\\x20\\x09-\\x0D]+')) AS saved
  FROM p JOIN l USING (conv_id) GROUP BY p.path
), k AS (
  SELECT a.path, any_value(b.conv_id) AS parent_conv_id FROM n a JOIN n b ON b.path = a.path[:len(a.path) - 1] AND a.depth > 0 GROUP BY a.path
), f AS (
  SELECT path[:len(path) - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), s AS (
  SELECT n.path[:d] AS path, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE f.path IS NULL) AS n_leaves
  FROM n LEFT JOIN f ON f.path = n.path, LATERAL (SELECT unnest(range(n.depth + 1)) AS d) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, k.parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN k ON k.path = n.path LEFT JOIN f ON f.path = n.path JOIN s ON s.path = n.path
"""
