"""License scans by diagonal voting between word k-grams of documents and of templates. DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of common licenses, as their authors ask users to state them, with the method's own labels.
NOTICES = {
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"],
    "gpl-2.0": ["this work is licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "mit-notice": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

K = 2
#: Diagonals that differ by this many words at most belong to one span.
NEIGHBOURS = 2
#: Share of a template's k-grams that a span must hold to give the template's label.
LEAST_SHARE = 0.8
#: Words that tell licenses apart: each must stand in a span as in its template, and none may be put in before it.
MARKS = (
    *"0123456789", "nc", "sa", "nd", "noncommercial", "non", "commercial", "sharealike", "share", "alike", "noderivatives", "noderivs", "no", "derivatives",
    "general", "lesser", "library", "affero",
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def templates(notices: dict[str, list[str]] = NOTICES) -> list[tuple[int, str, bool, int, str]]:
    """(template, label, base, position, k-gram) of every k-gram; their number is that of the words in the tables above."""
    texts = [(phrase, label, True) for phrase, label in BASE.items()] + [(t, label, False) for label, ts in notices.items() for t in ts]
    return [(i, label, base, p, " ".join(w[p : p + K])) for i, (text, label, base) in enumerate(texts) for w in [text.split()] for p in range(len(w) - K + 1)]


def spans(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans: (row, doc_id, n_words, template, label, base, grams, island, start, end, held, found).

    All rolling k-gram hashes of a text are joined with template positions, and equal hashes count only with equal words. A
    hit votes for the diagonal document position minus template position. Diagonals of a notice at most NEIGHBOURS apart
    (words put in or left out) are merged to a span; `held` of its template's `grams` k-grams stand in it, from word `start`
    to word `end`, not included, and `found` has each hit's place in the text and, negative, in the template. A base phrase's diagonals are never merged. Every row of docs also has one row of null
    template, so that rows without a hit stay.

    A null or empty text has no words; a text of one word has no k-grams. Null and repeated ids are separate rows, told apart
    by `row`. Long texts yield one joined row a word, and only hits are shuffled.
    """
    spark = docs.sparkSession
    grams = templates(notices)
    sizes = Counter(t for t, *_ in grams)
    known = spark.createDataFrame([(*g, sizes[g[0]]) for g in grams], "template int, label string, base boolean, position int, gram string, grams int")
    known = known.withColumn("marked", F.substring_index("gram", " ", -1).isin(*MARKS))
    known = F.broadcast(known.withColumn("hash", F.xxhash64("gram")))  # as many rows as the tables above have k-grams

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rolled = F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    rolled = F.when(F.size("words") >= K, rolled).otherwise(F.array().cast("array<string>"))
    plain = F.transform(rolled, lambda g, i: F.struct(i.alias("at"), g.alias("gram"), F.lit(0).alias("skipped")))
    # a mark also counts where 1 to NEIGHBOURS words are put in before it, none of them a mark
    marks = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*MARKS), i)), lambda i: i.isNotNull())
    skips = F.flatten(F.array(*[F.filter(F.transform(marks, lambda i: F.when(i > n, F.struct((i - 1).alias("at"), F.concat_ws(" ", F.get("words", i - n - 1), F.get("words", i)).alias("gram"), F.lit(n).alias("skipped")))), lambda x: x.isNotNull() & ~F.exists(F.slice("words", x["at"] - n + 2, n), lambda w: w.isin(*MARKS))) for n in range(1, NEIGHBOURS + 1)]))
    # the first element is no k-gram: it carries the row itself through the join
    none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("skipped")))
    each = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(none, plain, skips)).alias("g")).select("row", "doc_id", "n_words", "g.*")
    each = each.withColumn("hash", F.xxhash64("gram"))
    hits = each.join(known, ["hash", "gram"], "left").where((F.col("at") == -1) | (F.col("template").isNotNull() & ((F.col("skipped") == 0) | (F.col("marked") & ~F.col("base")))))
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", (F.col("at") - F.col("position")).alias("diagonal")).agg(F.collect_set("position").alias("positions"))

    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_template)) > F.when(F.col("base"), F.lit(0)).otherwise(F.lit(NEIGHBOURS))
    islands = votes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(by_template))
    return islands.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "island").agg(
        F.min(F.col("diagonal") + F.array_min("positions")).cast("long").alias("start"), F.max(F.col("diagonal") + F.array_max("positions") + K).cast("long").alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("held"),
        F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct((F.col("diagonal") + p).alias("at"), (-p).alias("back"))))).alias("found"),
    )


def in_order(found: Column, grams: Column) -> Column:
    """The most hits whose places in the text and in the template both rise. Each step keeps the longest chain up to each place."""
    longest = lambda acc, p: F.coalesce(F.array_max(F.slice(acc, 1, p)), F.lit(0)) + 1
    step = lambda acc, hit: F.transform(acc, lambda x, i: F.when(i == -hit["back"], F.greatest(x, longest(acc, i))).otherwise(x))
    return F.array_max(F.aggregate(F.array_sort(found), F.array_repeat(F.lit(0), grams), step))


def verified(spans: DataFrame, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """spans with `stands`: a base phrase whole, or a notice with LEAST_SHARE of its k-grams in order and all its MARKS."""
    marks = {}
    for template, _, base, position, gram in templates(notices):
        if not base and gram.split()[-1] in MARKS:
            marks.setdefault(template, []).append(position)
    needed = F.create_map(*[x for t, ps in marks.items() for x in (F.lit(t), F.array(*map(F.lit, ps)))]) if marks else F.lit(None).cast("map<int,array<int>>")
    needed = F.coalesce(F.get(F.map_values(F.map_filter(needed, lambda t, _: t == F.col("template"))), F.lit(0)), F.array().cast("array<int>"))
    whole = F.forall(needed, lambda p: F.exists("found", lambda hit: hit["back"] == -p))
    enough = F.col("held") / F.col("grams") >= LEAST_SHARE
    notice = F.when(enough & whole, in_order(F.col("found"), F.col("grams")) / F.col("grams") >= LEAST_SHARE).otherwise(False)
    return spans.withColumn("stands", F.when(F.col("base"), F.col("held") == F.col("grams")).otherwise(F.col("template").isNotNull() & notice))


def best(spans: Column) -> Column:
    """Of spans (share, length, ..., start, end) that overlap only the greatest stays."""
    add = lambda kept, s: F.when(F.exists(kept, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), kept).otherwise(F.concat(kept, F.array(s)))
    ranked = F.reverse(F.array_sort(spans))
    return F.aggregate(ranked, F.slice(ranked, 1, 0), add)


def scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A base phrase stands where a diagonal holds all its k-grams. A notice gives its label where a span holds LEAST_SHARE of
    its distinct k-grams in order and all the words that tell it from others (MARKS); of overlapping spans only the best does. The score is the largest such share of all notices and of base phrases that stand. Rows without
    words have 0 words, no labels ('') and score 0.
    """
    found = verified(spans(docs, notices, id_col, text_col), notices)
    place = F.col("base") & F.col("stands")
    span = F.struct((F.col("held") / F.col("grams")).alias("share"), "held", (-F.col("template")).alias("later"), "label", "start", "end")
    given = F.transform(best(F.collect_list(F.when(~F.col("base") & F.col("stands"), span))), lambda s: s["label"])
    result = found.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(place, 1)), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(place, F.col("start"))).alias("first_word"), F.max(F.when(place, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.collect_set(F.when(place, F.col("label"))), given)), ",").alias("labels"),
        F.coalesce(F.max(F.when(~F.col("base") | place, F.col("held") / F.col("grams"))), F.lit(0.0)).alias("score"),
    )
    return result.drop("row")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
