"""Top-k search, Jaccard join, components, mixing, packing, pipeline."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from melisma.llm import jaccard, mixing, packing, search
from melisma.llm.common import written
from melisma.llm.components import components

from .helpers import clashing, documents, frame, own_names, saved


def brute_search(rows, k):
    whole = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in whole if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=10))]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(150, 190)]  # many ties
    bad = [(500, None), (520, [float("nan")] * 10), (540, [float("inf")] + [0.0] * 9), (560, [None] * 10), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", search.F.lit(1)).withColumn("block", search.F.lit(1))
    for blocks in (16, 4096):
        got = search.top_k(df.where("vec_id % 20 = 0"), df, 5, block_rows=blocks).collect()
        assert sorted(tuple(r) for r in got) == brute_search(rows, 5)
    assert search.top_k(df.limit(0), df.limit(0)).count() == 0


def brute_links(docs, k, num, den):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[root(i)].append(d)
    return sorted((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(docs))


def families(seed):
    """Texts with large groups of near copies, a passage that many share, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(25)]
    docs = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 25)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            docs.append(own + (passage if rng.random() < 0.5 else []))
    docs += [passage + [word() for _ in range(rng.randint(0, 30))] for _ in range(20)]
    docs += [[word() for _ in range(n)] for n in (0, 1, 1, 2, 2, 3, 3, 4)] + [["a"], ["a"], ["a", "b"], ["A", "b"]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_jaccard_equals_brute_force(spark):
    for seed, t, long_list in ((1, jaccard.Threshold(3, 90, 100), 64), (2, jaccard.Threshold(5, 80, 100), 4), (3, jaccard.Threshold(3, 70, 100), 3)):
        docs = families(seed)
        got, _ = jaccard.join(frame(spark, [(i, x, None, None, None) for i, x in docs]), t, long_list=long_list)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_links(docs, *t)


def test_jaccard_parts_of_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ENTRIES", 8)
    docs, t = families(4), jaccard.Threshold(3, 80, 100)
    got, _ = jaccard.join(frame(spark, [(i, x, None, None, None) for i, x in docs]), t, long_list=4)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_links(docs, *t)


def test_jaccard_long_lists_lose_no_link(spark, monkeypatch):
    t = jaccard.Threshold(3, 90, 100)
    docs = [(i, " ".join([f"w{j}" for j in range(20)] + [f"own{i}"])) for i in range(70)]
    rows = frame(spark, [(i, x, None, None, None) for i, x in docs])
    run = lambda long_list: sorted(tuple(r) for r in jaccard.join(rows, t, long_list=long_list)[0].select("doc_id", "n_shingles", "component_id").collect())
    assert run(64) == run(200) == brute_links(docs, *t) == [(i, 19, 0) for i in range(70)]
    monkeypatch.setattr(jaccard, "LIST_ENTRIES", 8)
    assert run(64) == [(i, 19, 0) for i in range(70)]


def test_jaccard_returns_all_links(spark):
    t = jaccard.Threshold(3, 80, 100)
    docs = families(5)
    got, links = jaccard.join(frame(spark, [(i, x, None, None, None) for i, x in docs]), t, long_list=4)
    node = {r["doc_id"]: r["node"] for r in got.collect()}
    sets = {}
    for i, x in docs:
        w = x.lower().split()
        if w:
            sets[node[i]] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))}
    want = sorted((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert sorted(tuple(r) for r in links.collect()) == want and len(want) > len(sets)


def test_jaccard_furthest_is_the_maximum():
    for t in (jaccard.Threshold(), jaccard.Threshold(3, 90, 100), jaccard.Threshold(3, 70, 100), jaccard.Threshold(3, 1, 2), jaccard.Threshold(3, 100, 100)):
        for n in range(1, 120):
            assert t.furthest(n) == max(t.most_apart(n, m) for m in range(1, 2 * n + 2) if t.sizes_fit(n, m))


def test_jaccard_odd_rows(spark):
    docs = clashing(spark)
    rows = jaccard.join(docs)[0].collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and by_id[3]["n_shingles"] == 0 and by_id[3]["component_id"] == 3 and by_id[8]["n_shingles"] == 1
    kept = jaccard.stage_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    assert jaccard.join(docs.limit(0))[0].count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (3, 1)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = (budget - sum(full.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return full


def test_mixing_meets_targets(spark, sf_dir):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), None, rng.choice(["a", "b", "c", "d", None, "ä"]), 0) for i in range(900)]
    docs = frame(spark, rows)
    got = mixing.mix(mixing.sized(docs), unit_rows=16).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(dict(sizes))
    assert len(got) == 900
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 31 for s in want)
    again = mixing.mix(mixing.sized(docs.repartition(3)), unit_rows=16).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixing_is_unbiased():
    import pandas as pd

    total = np.zeros(40)
    for seed in range(300):
        pdf = pd.DataFrame({"source_rank": 0, "unit": 0, "row_key": range(40), "doc_id": range(40), "size": [10 + i for i in range(40)], "base": 0, "share": 0.3})
        out = mixing._round_unit(seed, 0)(pdf).sort_values("doc_id")
        assert (out["copies"] < 0).sum() <= 1
        total += out["copies"].clip(lower=0).to_numpy() + np.where(out["copies"] < 0, out["share"], 0)
    assert abs(total.mean() / 300 - 0.3) < 0.02 and np.abs(total / 300 - 0.3).max() < 0.12


def test_mixing_odd_rows(spark):
    docs = clashing(spark)
    assert mixing.mix(mixing.sized(docs)).count() == docs.count()
    out = mixing.stage_mixing(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
    assert mixing.mix(mixing.sized(docs.limit(0))).count() == 0


PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END], dtype="<u4")
        for s, n in packing.cut(len(ids)):
            want[(i, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids))] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    return sum(r["length"] for r in rows) / (packing.WINDOW * len(at))


def test_packing_round_trip(spark, sf_dir):
    odd = [(1001, "It's DON'T we'll “quoted” naïve İstanbul ΣΑΣ é x9y8 <|endoftext|> a<|b 日本　語 \x00ctrl ﬁ ½ ǅ Ÿ ſ ß"), (1002, None), (1003, ""), (1004, "a" * 9000)]
    docs = documents(spark, sf_dir) + odd
    rows = packing.pack_documents(frame(spark, [(i, t, None, None, None) for i, t in docs]), PATH).collect()
    assert check_packing(rows, docs) > 0.95


def test_differencing():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (1, 3), (7, 3), (200, 20)):
        sizes = rng.integers(1, 500, n)
        window = packing.differencing(sizes, k)
        assert len(window) == n and window.min() >= 0 and window.max() < k
    loads = np.bincount(window, weights=sizes, minlength=20)
    assert loads.max() - loads.min() < 25
    window, k = packing.fit_windows(np.array([2000] * 7 + [30] * 9), 2048)
    assert k >= 7 and np.bincount(window, weights=[2000] * 7 + [30] * 9).max() <= 2048


def test_packing_odd_rows(spark):
    docs = clashing(spark)
    check_packing(packing.pack_documents(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["the", "and", "ing", "er", "on", "re"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(40))
        rows += [(2 * i, text, "en", f"s{i % 3}", len(text)), (2 * i + 1, text if i % 4 == 0 else text + " password=b7db7aa4a5fcc78305", "en", f"s{i % 3}", len(text))]
    rows += [(500, "1234 !!", "en", "s0", 7), (501, None, None, None, None)]
    folder = saved(spark, tmp_path, rows)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert name == "packing" or docs.columns == columns
        seen[name] = docs
    assert {r["doc_id"] for r in seen["language_id"].collect()} == set(range(120))
    # every second text is an exact or near copy of the one before
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == set(range(0, 120, 2))
    assert not any("b7db7aa4" in r["text"] for r in seen["secret_scan"].collect())
    mixed = [(r["doc_id"], r["text"]) for r in seen["mixing"].collect()]
    assert {i for i, _ in mixed} <= set(range(0, 120, 2)) and len(mixed) > 60
    check_packing(seen["packing"].collect(), mixed)
    assert corpus_pipeline.run(spark, folder).count() == seen["packing"].count()


def test_search_skips_blocks_that_cannot_hold_answers(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 16)) * 4
    rows = [(i, [float(x) for x in np.float32(centers[i % 8] + rng.normal(size=16) * 0.2)]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 20 = 0")
    got = search.top_k(queries, df, 5, block_rows=16)
    assert sorted(tuple(r) for r in got.collect()) == brute_search(rows, 5)
    known, blocks, pairs = search.plan(search.whole_vectors(queries, "vec_id", "embedding", 64), search.whole_vectors(df, "vec_id", "embedding", 64), 5, 16)
    assert pairs.count() < 0.6 * known.count() * blocks.count()


def test_search_with_repeated_query_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[20], rows[20]], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in search.top_k(df.where("vec_id = 20"), df, 5, block_rows=16).collect()]
    assert [r[1] for r in sorted(got)] == [1, 2, 3, 4, 5]


def test_stages_keep_columns_named_as_their_own(spark):
    names = own_names()
    assert {"_copies", "_match", "_rows", "_key", "_found", "_pieces", "_texts"} <= set(names)
    docs = frame(spark).withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce("doc_id", F.lit(0)).cast("string")) for n in names}).withColumn("a.b", F.create_map(F.lit("k"), "doc_id"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names, "a.b"]
        docs = written(docs, "clash")
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} of {r['doc_id'] or 0}" for r in rows for n in names) and all(r["a.b"] == {"k": r["doc_id"]} for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
