"""Language ID, sharding, secrets, licenses, LM scores, fingerprints."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from melisma.llm import fingerprints, forest, langid, licenses, lm, secrets, sharding
from melisma.llm.vectors import chunks

from .helpers import clashing, documents, frame, saved


def test_language_held_out_accuracy_and_und(spark, sf_dir):
    rows = langid.op1_language_id(spark, sf_dir).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] and 0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows_and_no_training(spark, tmp_path):
    docs = clashing(spark)
    rows = langid.predict(docs, langid.train(docs)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (3, 4, 5, 6))
    empty = langid.predict(docs.limit(0), langid.train(docs.limit(0)))
    assert empty.count() == 0
    blank = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(blank, langid.train(blank)).collect()} == {"und"}
    kept = langid.stage_language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 8, 9, 10, None}


def test_permutation_is_a_bijection(spark):
    for total in (1, 2, 3, 5, 17, 1000, 1001):
        got = sharding.permuted(spark.range(total).withColumnRenamed("id", "number"), "number", total, "place").select("place").collect()
        assert sorted(r["place"] for r in got) == list(range(total))


def test_sharding_law(spark):
    docs = clashing(spark)
    rows = sharding.shard_documents(docs, 8).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == 12 and max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
    again = sharding.shard_documents(docs.repartition(5), 8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_forest_expression_equals_prediction(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(int)
    trees = forest.fit(x, y, trees=5)
    frame_ = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r[0] for r in frame_.select(forest.as_column(trees, lambda i: langid.F.col("abc"[i]))).collect()]
    assert np.allclose(got, forest.predict(trees, x))
    assert np.mean((np.array(got) > 0.5) == y) > 0.95


def test_secrets_found_and_false_positives_removed(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [
        (1, f'set token = "{"1beb58b8af68854f0e01" * 2}" and go', "en", "src1", 0), (2, f"use {key} here", "en", "src1", 0), (3, "password=b7db7aa4a5fcc78305 x", "en", "src1", 0),
        (4, "card 4284250577320971 paid", "en", "src1", 0), (5, "see commit 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae", "en", "src1", 0), (6, None, "en", None, 0), (7, "", "en", "x", 0),
        (8, "123e4567-e89b-12d3-a456-426614174000 is the uuid", "en", "x", 0), (9, "a" * 200_000, "en", "x", 0),
    ]
    docs = frame(spark, rows)
    trees = secrets.train(spark)
    found = {r["doc_id"]: r for r in secrets.scan(docs, trees).collect()}
    assert {i for i, r in found.items() if r["is_secret"]} == {1, 2, 3}
    assert set(found) == {1, 2, 3, 4, 5, 8}
    text = {r[0]: r[1] for r in rows}
    assert all(text[i][r["start"] : r["start"] + r["length"]] == r["candidate"] for i, r in found.items())
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, trees).collect()}
    assert clean[3] == "password=[SECRET] x" and clean[2] == "use [SECRET] here" and clean[4] == text[4] and clean[6] is None and len(clean) == len(rows)


def test_secrets_held_out_accuracy(spark):
    trees = secrets.train(spark)
    fresh = spark.createDataFrame(secrets.default_findings(400, seed=99), "candidate string, before string, after string, path string, label int")
    F = secrets.F
    rows = fresh.select("label", *secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))).collect()
    got = forest.predict(trees, np.array([list(r)[1:] for r in rows], dtype=float)) >= secrets.LEAST_SCORE
    assert np.mean(got == np.array([r["label"] for r in rows])) >= 0.95


def test_secret_odd_rows(spark):
    docs = clashing(spark)
    trees = secrets.train(spark)
    assert secrets.scan(docs, trees).count() == 0
    stage = secrets.stage_secrets(spark, docs, "")
    assert stage.columns == docs.columns and stage.count() == docs.count()
    assert secrets.scan(docs.limit(0), trees).count() == 0


def brute_licenses(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licenses_equal_brute_force(spark, sf_dir):
    own = frame(spark, [(i, t, None, None, None) for i, t in documents(spark, sf_dir)])
    more = clashing(spark).select(own.columns).unionByName(frame(spark, [(50, "cc by cc by the MIT\nlicense, Apache-License gnu general public", "en", "a", 1)]))
    docs = own.limit(150).unionByName(more)
    text = collections.defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(brute_licenses(r["text"]))
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in text[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_spans_survive_edits(spark):
    notice = "this work is licensed under the gnu general public license version 3"
    edited = notice.replace("work is", "work really is")
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, [(1, notice, "", "", 0), (2, edited, "", "", 0), (3, "under the general license of this work", "", "", 0)])).collect()}
    assert "gpl-3.0" in rows[1]["labels"] and rows[1]["score"] == 1 and "gpl-3.0" in rows[2]["labels"] and rows[3]["labels"] == ""


def test_license_variants_are_told_apart(spark):
    gpl = "This work is licensed under the GNU General Public License, version "
    free = "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    cases = {
        gpl + "3.": "gpl,gpl-3.0", gpl + "2.": "gpl,gpl-2.0", gpl + "1.": "gpl", gpl + "number 3.": "gpl,gpl-3.0", gpl + "3. " + "words " * 9 + gpl + "2.": "gpl,gpl-2.0,gpl-3.0",
        gpl.replace("General", "Lesser General") + "3.": "", gpl.replace("General", "Affero General") + "3.": "",
        free: "gpl", free + ", either version 3 of the License": "gpl,gpl-3.0", free + ", either version 2 of the License": "gpl,gpl-2.0",
        "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Licensed under CC BY-SA 4.0.": "cc-by", "Licensed under CC BY-ND 4.0.": "cc-by",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by", "Licensed under CC BY (version) 4.0.": "cc-by,cc-by-4.0", "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "", "Released under the MIT License.": "mit,mit-notice",
    }
    rows = licenses.scan(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(cases)])).collect()
    assert {t: r["labels"] for t, r in zip(cases, sorted(rows, key=lambda r: r["doc_id"]), strict=True)} == cases


def test_license_words_out_of_order_give_no_label(spark):
    notices = {"x": ["a b c d e f"]}
    rows = licenses.scan(frame(spark, [(1, "b c a b d e c d", "", "", 0), (2, "a b c d e f", "", "", 0)]), notices).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "", 2: "x"}


def test_lm_base_equals_brute_force(spark, tmp_path, sf_dir):
    docs = documents(spark, sf_dir)[:80] + [(900, None), (901, ""), (902, "one two one")]
    tokens = lambda t: (t or "").encode().translate(bytes(lm.LOWER)).split() + [None]
    counts = collections.Counter(x for i, t in docs if zlib.crc32(str(i).encode()) % 10 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.score(frame(spark, [(i, t, None, None, None) for i, t in docs])).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        own = tokens(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[x] > 0 for x in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_probabilities_of_all_next_bytes_sum_to_one():
    texts = ["the cat sat on the mat", "the dog sat on the log"] * 20
    code = lm.code_of(texts)
    counter = lm.Counter(code)
    for chunk in chunks(pa.array(texts)):
        counter.add(lm.stream(chunk))
    tables = [lm.stretched(c) for c in counter.tables()]
    model = lm.Model(code, tables, lm.fit_weights(texts[:4], code, tables))
    stream = lm.stream(next(chunks(pa.array(["the c"]))))
    total, best = 0.0, None
    for byte in range(256):
        data = stream.data.copy()
        data[stream.at[4]] = byte
        p = math.exp(lm.byte_scores(stream._replace(data=data), model)[4])
        total += p
        best = max(best or (0, 0), (p, byte))
    assert abs(total - 1) < 1e-3 and chr(best[1]) in "cdml"


def test_lm_odd_rows(spark):
    assert lm.score(clashing(spark)).count() == 12
    assert lm.score(frame(spark).limit(0)).count() == 0


def jaccard(a, b):
    keys = set(a) | set(b)
    most = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / most if most else 1.0


def test_fingerprints_equal_brute_force(spark, sf_dir):
    docs = sorted(documents(spark, sf_dir), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(frame(spark, [(i, t, None, None, None) for i, t in docs]), unit_rows=16).collect()}
    assert len(got) == len(docs)
    count = lambda t: collections.Counter(t.encode().translate(bytes(lm.LOWER)).split())
    errors = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i]["near_edited"] - jaccard(count(text), count(edited)), got[i]["near_next"] - jaccard(count(text), count(after))]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_fingerprint_odd_rows(spark):
    docs = clashing(spark)
    rows = fingerprints.compare_edited(docs, unit_rows=2).collect()
    assert len(rows) == docs.count()
    by_text = collections.defaultdict(set)
    for r in fingerprints.fingerprint(docs).collect():
        by_text[r["doc_id"]].add(r["fingerprint"])
    assert by_text[1] == by_text[2] and by_text[3] == by_text[4] and len(by_text[9]) == 1
    one = fingerprints.compare_edited(frame(spark, [(5, "one text alone here", None, None, None)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0


def test_queries_read_whole_tables(spark, tmp_path):
    folder = saved(spark, tmp_path)
    assert sharding.op2_sharding(spark, folder).count() == 12 and licenses.op4_license_scan(spark, folder).count() == 12


def test_fingerprint_counts_have_no_cap(spark):
    """Over 65,535 copies of a word count as many as they are: likeness nears the ratio of the counts."""
    sigs = fingerprints.signatures([b"a " * 70_000, b"a " * 200_000, b"a " * 70_000 + b"b"])
    assert abs(fingerprints.likeness(sigs[0], sigs[1]) - 0.35) < 0.2
    assert fingerprints.likeness(sigs[0], sigs[2]) > 0.9


def test_lm_learns_from_every_training_text(spark):
    # far more texts than any sample of a fixed size held: a byte that few of them have still counts for the code
    docs = [(i, "aa bb" if i % 100 else "qq zz", None, None, None) for i in range(3000)]
    train = frame(spark, docs)
    text = "".join(t for _, t, *_ in docs)
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    counts[0] += len(docs)
    got, want = lm.learned_code(train), lm.code_from(counts)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    # all 30 rare texts count alike, whichever they are
    scores = {(r["held_out"], round(r["score"], 9)) for r in lm.score(train).collect() if r["doc_id"] % 100 == 0}
    assert len({s for held, s in scores if held}) <= 1 and len({s for held, s in scores if not held}) == 1


def test_lm_weights_are_fitted_on_all_training_texts(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    docs = documents(spark, sf_dir)
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    halves = dict(spark.createDataFrame([(t,) for t in train], "text string").select("text", F.expr("pmod(xxhash64(coalesce(text, '')), 2)")).collect())
    counts = np.bincount(lm.LOWER[np.frombuffer("".join(t or "" for t in train).encode(), dtype=np.uint8)], minlength=256)
    counts[0] += len(train)
    code, tables = lm.code_from(counts), []
    streams = [[lm.stream(c) for c in chunks(pa.array([t or "" for t in train if halves[t] == h]))] for h in (0, 1)]
    for own in streams:
        counter = lm.Counter(code)
        for s in own:
            counter.add(s)
        tables.append([lm.stretched(c) for c in counter.tables()])
    # each text is judged by what the other half's texts gave; no text is left out
    found = [lm.slopes(s, code, tables[1 - h], np.full(lm.INPUTS, lm.START)) for h in (0, 1) for s in streams[h]]
    want = lm.newton(np.full(lm.INPUTS, lm.START), sum(x for x, _ in found), sum(x for _, x in found))
    seen, scored = [], lm._scored
    monkeypatch.setattr(lm, "_scored", lambda model, n, v: (seen.append(model.weights), scored(model, n, v))[1])
    rows = frame(spark, [(i, t, None, None, None) for i, t in docs])
    assert lm.score(rows).count() == len(docs)
    assert np.allclose(seen[0], want, atol=2e-4) and np.abs(seen[0] - lm.START).max() > 0.02
    lm.score(rows.repartition(3, "text"))
    assert (seen[1] == seen[0]).all()
    lm.score(rows, weights=np.array([0.1, 0.2, 0.3, 0.4]))
    assert np.allclose(seen[2], [0.1, 0.2, 0.3, 0.4])
