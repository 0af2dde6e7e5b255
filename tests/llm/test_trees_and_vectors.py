"""Nearest neighbours, prefix trie, centroids, and large scores of the top-k search."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.llm import clustering, neighbours, search, trie

VECTORS = "vec_id long, embedding array<double>"


# top-k search -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [24, 30])
def test_search_scores_are_exact_above_doubles(spark, bits):
    rng = random.Random(bits)
    rows = [(i, [float(2**bits + rng.randrange(-9, 9)) for _ in range(4)]) for i in range(120)]
    rows += [(i, rows[20][1]) for i in range(120, 150)]  # ties
    df = spark.createDataFrame(rows, VECTORS)
    whole = {i: [int(x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for blocks in (8, 4096):
        assert sorted(map(tuple, search.top_k(df.where("vec_id % 20 = 0"), df, 7, scale=1, block_rows=blocks).collect())) == sorted(want)


def test_search_score_beyond_a_long_stands_at_its_end(spark):
    df = spark.createDataFrame([(0, [2.0**40, 0.0]), (1, [2.0**40, 1.0]), (2, [1.0, 1.0]), (3, [-(2.0**40), 0.0])], VECTORS)
    got = search.top_k(df.where("vec_id = 0"), df, 3, scale=1).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (2, 2**40), (3, -(2**63 - 1))]


# nearest neighbours ------------------------------------------------------------------------------------------------------


def brute_neighbours(rows, k, is_query):
    fine = [(i, np.array(v)) for i, v in rows]
    out = {}
    for q, x in fine:
        if is_query(q):
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in fine if i != q and len(y) == len(x))
            out[q] = d[:k]
    return out


def test_neighbours_have_recall_and_exact_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 24)) * 3
    rows = [(i, (centers[i % 30] + rng.normal(size=24) * 0.4).tolist()) for i in range(3000)]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 16)
    monkeypatch.setattr(neighbours, "SLICE", 4)
    df = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(n) for n in ("block", "cell", "x", "known", "rank", "hashed")})
    got = collections.defaultdict(list)
    for r in neighbours.neighbours(df.where("vec_id % 50 = 0"), df, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert len(got[r["query_id"]]) == r["rank"]
    want = brute_neighbours(rows, 10, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    whole = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        assert all(s == float(np.sqrt(((np.array(whole[q]) - np.array(whole[i])) ** 2).sum())) for s, i in found)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.93


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 40)]
    rows += [(i, rows[3][1]) for i in range(100, 140)] + [(100, rows[3][1])] * 3  # ties, repeated rows, repeated queries
    rows += [(200, [1.0, 2.0]), (201, [1.0, 2.5]), (202, [0.0, 3.0])]  # another length
    bad = [(300, None), (400, [0.0] * 6), (500, [float("nan")] * 6), (600, [None] * 6), (700, [float("inf")] * 6), (800, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, VECTORS)
    got = collections.defaultdict(list)
    for r in neighbours.neighbours(df.where("vec_id % 100 = 0"), df, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == {100, 200}
    assert got[200] == [(0.5, 201), (float(np.sqrt(2.0)), 202)]
    assert got[100] == [(0.0, 4), (0.0, 101), (0.0, 102), (0.0, 103), (0.0, 104)]
    assert neighbours.neighbours(df.limit(0), df, k=5).count() == 0 and neighbours.neighbours(df, df.limit(0), k=5).count() == 0


def test_chi_square_quantiles():
    assert abs(neighbours.chi_square(0.95, 8) - 15.50731) < 1e-4 and abs(neighbours.chi_square(0.5, 2) - 1.386294) < 1e-5


def test_every_row_is_in_one_cell_of_the_tree():
    y = np.random.default_rng(1).normal(size=(500, 4))
    y[:200] = y[0]
    tree = neighbours.grown(y, 16)
    cells = neighbours.found_cell(tree, y)
    assert cells.min() == 0 and cells.max() == 15 and len(set(cells[:200])) == 1
    order, starts = neighbours._ordered(y)
    assert sorted(order) == list(range(500)) and starts[0] == 0 and max(np.diff([*starts, 500])) <= neighbours.LEAF


# prefix trie -------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - c % 20, [])
        made[c] = tuple(base[:h] + own[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


def got_trie(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [4, 65_536])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b b", "", None, "c d e\n f"])) for c in range(90) if c % 20 or c < 50 for t in range(rng.randrange(1, 9))]
    rows += [(100 + c, t, "user", "same words here") for c in range(40) for t in range(5)]  # copies
    rows += [(200, t, "user", f"turn {t}") for t in range(60)] + [(240, t, "user", f"turn {t}") for t in range(45)]  # long ones that share a beginning
    rows += [(300 + i, t, "u", "x" if t < i else "y") for i in range(12) for t in range(i + 1)]  # each leaves the others a turn later
    rng.shuffle(rows)
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", 3)
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(n) for n in ("depth", "a", "b", "row", "part", "words", "at")})
    assert got_trie(df.repartition(5)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 2, "user", "hi there"), (5, 1, "user", ""), (-3, 1, "user", "word " * 20_000), (7, 1, "user", "only turn"), (7, 1, "user", "only turn"), (7, 1, "user", "only turn"), (7, 1, "user", "only turn")]
    assert got_trie(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)
    # h of 27 is 3 and 20 is absent: its one turn falls away, and the root is all that is left
    lone = [(c, 1, "user", "x") for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 >= 1][:1]
    got = got_trie(spark.createDataFrame(lone, TURNS))
    assert got == brute_trie(lone) and len(got) == 1 and got[0][1] == 0
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0


# centroids ---------------------------------------------------------------------------------------------------------------


def brute_lloyd(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    cs = [v for _, v in start]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda j: (dist(v, cs[j]), j))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)].append(v)
        cs = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else cs[j] for j in range(len(cs))]
    found = [(i, j := near(v), dist(v, cs[j])) for i, v in kept]
    per = collections.Counter()
    for _, j, d in found:
        per[j] += d
    return sorted((-1 if i is None else i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize("size", [1.0, 3e5, 1e9])
def test_centroids_equal_brute_force(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * size).tolist()) for i in range(300)]
    rows += [(i, rows[8][1]) for i in range(300, 700)]  # most rows are one vector
    rows += [(9, rows[9][1])] * 2 + [(None, rows[3][1]), (800, [-0.5 * size] * 5)]
    bad = [(901, None), (902, [1.0] * 4), (903, [None] * 5), (904, [float("nan")] * 5), (905, [float("-inf")] * 5), (906, [])]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({n: F.lit(n) for n in ("v", "x", "weight", "cluster", "distance", "h")})
    got = clustering.lloyd(df, k=8, rounds=10, dims=5)
    found = sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())
    long = lambda x: x if not isinstance(x, int) or x < 2**63 else -1
    assert found == sorted(tuple(map(long, r)) for r in brute_lloyd(rows + bad, 8, 10, 5, 1024))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_centroids_of_few_and_no_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    got = sorted(map(tuple, clustering.lloyd(spark.createDataFrame(rows, VECTORS), dims=2).collect()))
    assert got == brute_lloyd(rows, 8, 10, 2, 1024)
    assert clustering.lloyd(spark.createDataFrame([], VECTORS), dims=2).count() == 0


def test_hot_keys_are_looked_up_apart(spark):
    from melisma.llm.common import looked_up

    many = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id % 2500) AS k")
    one = many.groupBy("k").count().withColumn("v", F.col("k") * 2)
    got = looked_up(many, one, ["k"], "count", 5000)
    assert got.count() == 5000 and got.where("v <> k * 2 OR v IS NULL").count() == 0


def test_copies_are_numbered_and_equal_rows_part(spark):
    from melisma.llm import common, packing, sharding

    df = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("source")).unionByName(spark.range(50).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source")))
    got = common.with_copies(df)
    assert got.count() == 20_050 and got.where("source = 's'").agg(F.count_distinct("copy"), F.min("copy"), F.max("copy")).first() == (20_000, 0, 19_999)
    assert got.where("source IS NULL").agg(F.max("copy")).first()[0] == 0
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(3).cast("long").alias("size"))
    numbered = sharding.numbered(rows, ["doc_id", "size"], 20_000, block_rows=1000)
    assert numbered.agg(F.count_distinct("row_number"), F.max("row_number")).first() == (20_000, 19_999)
    # 20,000 equal pieces, and 20,000 of null ids: no unit holds more than twice its share
    for doc in (F.lit(5), F.lit(None)):
        pieces = common.written(spark.range(20_000, numPartitions=8).select(F.lit(1).cast("long").alias("row_key"), doc.cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(512).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"), F.lit(512).cast("long").alias("doc_tokens")), "equal-pieces")
        out = packing.pack(pieces)
        most = out.groupBy(F.shiftright("sequence_id", 32).alias("unit")).agg(F.sum("length").alias("tokens")).agg(F.max("tokens")).first()[0]
        assert out.count() == 20_000 and most <= 2 * packing.UNIT_TOKENS
        assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_equal_rows_part_in_mixing(spark):
    from melisma.llm import mixing

    sizes = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("size")).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), (F.col("id") % 7).alias("size")))
    runs = [sorted(map(str, mixing.mix(sizes.repartition(n)).drop("row_key").collect())) for n in (3, 8)]
    assert runs[0] == runs[1] and len(runs[0]) == 23_000
    for r in mixing.mix(sizes).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 10
