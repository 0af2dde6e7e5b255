"""Lyric phrases: letters of a line, likeness, windows of phrases in heard characters, order and estimated times.

Phrase windows and line order are folds over one song's lines, so they run per song; what goes before (groups of lines, their
search windows, times between known characters) is declared in SQL.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sqlop import operator
from ..sources import adapters
from .decoders import spread

#: Least likeness of a phrase and a window of heard characters, and least run of equal characters.
LIKE, RUN = 0.55, 2

GROUPS = """
WITH l AS (SELECT song_id, line_id, count(*) AS chars, min(CASE WHEN manual THEN start_s END) AS first_known, max(CASE WHEN manual THEN start_s END) AS last_known, max(end_s) AS line_end FROM {characters} GROUP BY song_id, line_id),
c AS (SELECT *, CASE WHEN first_known IS NULL AND lag(chars) OVER w IS NOT NULL AND lag(first_known) OVER w IS NULL THEN 0 ELSE 1 END AS fresh, max(line_end) OVER (PARTITION BY song_id) AS duration FROM l WINDOW w AS (PARTITION BY song_id ORDER BY line_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY line_id) AS grp FROM c),
a AS (SELECT song_id, grp, min(line_id) AS first_line, max(line_id) AS last_line, sum(chars) AS chars, min(first_known) AS low, max(last_known) AS high, max(duration) AS duration FROM g GROUP BY song_id, grp),
b AS (SELECT *, coalesce(max(high) OVER (PARTITION BY song_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS last_end, min(low) OVER (PARTITION BY song_id ORDER BY grp ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS future FROM a),
s AS (SELECT *, CASE WHEN low IS NULL THEN last_end ELSE greatest(last_end, low - 2e0) END AS search_from, CASE WHEN future > last_end THEN least(duration, future - 5e-2) ELSE duration END AS ceiling FROM b),
e AS (SELECT song_id, first_line, last_line, CAST(chars AS BIGINT) AS chars, search_from, greatest(search_from, CASE WHEN low IS NULL THEN ceiling ELSE least(ceiling, high + greatest(3e0, chars * 6e-1)) END) AS search_to FROM s)
"""
line_groups = operator("line_groups", "characters", f"{GROUPS}SELECT song_id, first_line, last_line, chars, round(search_from, 4) AS search_from, round(search_to, 4) AS search_to FROM e\n",
    "X19: neighbouring lines without a known character are searched together, in the whole gap between what is known before and after; known times are taken to rise")
restored = operator("restored_times", "characters", GROUPS.rstrip() + """,
k AS (SELECT x.song_id, x.char_id, x.line_id, x.start_s, x.end_s, x.manual, e.search_from, e.search_to, row_number() OVER w AS i, count(*) OVER (PARTITION BY x.song_id, x.line_id) AS n, lead(x.start_s) OVER w AS next_s
      FROM {characters} AS x JOIN e ON e.song_id = x.song_id AND x.line_id = e.first_line AND e.first_line = e.last_line WINDOW w AS (PARTITION BY x.song_id, x.line_id ORDER BY x.char_id)),
o AS (SELECT *, min(CASE WHEN search_from <= start_s AND start_s < end_s AND end_s <= search_to + 1e-3 AND coalesce(end_s <= next_s + 1e-3, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY song_id, line_id) AS in_order,
             max(CASE WHEN manual THEN i END) OVER before AS left_i, max(CASE WHEN manual THEN end_s END) OVER before AS left_s, min(CASE WHEN manual THEN i END) OVER after AS right_i, min(CASE WHEN manual THEN start_s END) OVER after AS right_s
      FROM k WINDOW before AS (PARTITION BY song_id, line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY song_id, line_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS (SELECT *, coalesce(left_i, 0) AS li, coalesce(left_s, search_from) AS low, coalesce(right_s, search_to) AS high, (coalesce(right_s, search_to) - coalesce(left_s, search_from)) / (coalesce(right_i, n + 1) - coalesce(left_i, 0) - 1) AS step FROM o WHERE NOT manual AND search_to > search_from)
SELECT song_id, char_id, round(CASE WHEN in_order = 1 THEN start_s ELSE low + (i - li - 1) * step END, 4) AS start_s, round(CASE WHEN in_order = 1 THEN end_s ELSE least(high, low + (i - li - 1) * step + step * 8e-1) END, 4) AS end_s, in_order = 1 AS observed
FROM p WHERE in_order = 1 OR step > 0
""", "X21: characters without a sure time keep their observed one where the whole line lies in order in its window, else they part the gap between sure neighbours; lines that are searched alone")


def letters(text: str | None) -> str:
    """SC12: the letters and digits of a text in compatibility form; none of null."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "") if unicodedata.category(c)[0] in "LN")


def phrase_letters(text: str | None) -> str:
    """X16: the letters of a lyric line, in which one instrument goes by its written name."""
    return letters(re.sub("guitar", "吉他", unicodedata.normalize("NFKC", text or ""), flags=re.I))


def likeness(a: str, b: str) -> float:
    """X16: twice the longest common subsequence over both lengths; 0 without two equal characters in a row."""
    if not {a[i : i + RUN] for i in range(len(a) - RUN + 1)} & {b[i : i + RUN] for i in range(len(b) - RUN + 1)}:
        return 0.0
    y, best = np.array([ord(c) for c in b]), np.zeros(len(b) + 1, dtype=np.int64)
    for c in a:
        # within a row the best so far is carried on by a running maximum
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(y == ord(c), best[:-1] + 1, 0)))
    return float(2 * best[-1] / (len(a) + len(b)))


def compared(pairs: DataFrame) -> DataFrame:
    """SC12, X16 over (pair_id, heard, correct): letters of both texts and their likeness; null texts have no letters."""

    def run(batches):
        for rows in batches:
            a, b = (rows[c].map(lambda t: phrase_letters(t if isinstance(t, str) else None)) for c in ("heard", "correct"))
            yield pd.DataFrame({"pair_id": rows["pair_id"], "heard_letters": a, "correct_letters": b, "likeness": [round(likeness(x, y), 6) for x, y in zip(a, b, strict=True)]})

    return pairs.mapInPandas(run, "pair_id long, heard_letters string, correct_letters string, likeness double")


class Heard:
    """Windows of heard characters that are like a phrase: 0.7 to 1.3 times as long, with a run of equal characters."""

    def __init__(self, text: str):
        self.text, self.known = text, {}
        self.letters = np.array(list(text), dtype=object)

    def like(self, phrase: str, window: str):
        if (phrase, window) not in self.known:
            m = SequenceMatcher(None, phrase, window, autojunk=False)
            ratio = m.ratio() if m.real_quick_ratio() >= LIKE and m.quick_ratio() >= LIKE else 0.0
            blocks = [b for b in m.get_matching_blocks() if b.size >= RUN] if ratio >= LIKE else []
            self.known[phrase, window] = (ratio, blocks)
        return self.known[phrase, window]

    def windows(self, phrase: str) -> list[tuple[int, int, float, list]]:
        size, n = len(phrase), len(self.text)
        pairs = {phrase[i : i + RUN] for i in range(size - RUN + 1)}
        hits = np.concatenate(([0], np.cumsum([self.text[i : i + RUN] in pairs for i in range(n - RUN + 1)]))) if pairs and n >= RUN else None
        found = []
        if hits is None:
            return found
        # of each letter of the phrase how many stand before a place: letters in common bound the likeness of a window
        own = Counter(phrase)
        before = np.array([np.concatenate(([0], np.cumsum(self.letters == c))) for c in own])
        most = np.array(list(own.values()))[:, None]
        for length in range(max(RUN, int(size * 0.7)), min(n, int(size * 1.3) + 2) + 1):
            starts = np.flatnonzero(hits[length - RUN + 1 :] > hits[: n - length + 1])
            common = np.minimum(before[:, starts + length] - before[:, starts], most).sum(0)
            for start in starts[2.0 * common / (size + length) >= LIKE].tolist():
                ratio, blocks = self.like(phrase, self.text[start : start + length])
                if blocks:
                    found.append((start, length, ratio, blocks))
        return sorted(found, key=lambda w: w[:2])


def in_order(heard: Heard, phrases: list[str]) -> list[tuple | None]:
    """The windows, one or none a phrase, that rise with the phrases and have the largest sum of (likeness - 0.5) * size."""
    n = len(heard.text)
    total, history = np.full(n + 1, -np.inf), []
    total[0] = 0.0
    for phrase in phrases:
        reach = np.maximum.accumulate(total)
        came, best = {}, total.copy()
        for w in heard.windows(phrase):
            start, length, ratio, _ = w
            value = reach[start] + (ratio - 0.5) * len(phrase)
            if value > best[start + length]:
                best[start + length], came[start + length] = value, w
        history.append((total, came))
        total = best
    end, chosen = int(total.argmax()), []
    for before, came in reversed(history):
        w = came.get(end)
        chosen.append(w)
        if w:
            end = int(before[: w[0] + 1].argmax())
    return chosen[::-1]


def one_by_one(heard: Heard, phrases: list[str], at: np.ndarray) -> list[tuple | None]:
    """Each phrase in turn takes the likest of the early free windows; those after the last one taken go first."""
    free, chosen, done = np.ones(len(heard.text), dtype=bool), [], 0.0
    for phrase in phrases:
        options = [w for w in heard.windows(phrase) if free[w[0] : w[0] + w[1]].all()]
        if not options:
            chosen.append(None)
            continue
        floor = max(LIKE, max(w[2] for w in options) - 0.2)
        good = [w for w in options if w[2] >= floor]
        good = [w for w in good if at[w[0]] >= done - 0.05] or good
        last = min(w[0] for w in good) + max(2, len(phrase) // 2)
        start, length, *_ = pick = max((w for w in good if w[0] <= last), key=lambda w: (w[2], -w[1], -w[0]))
        free[start : start + length], done = False, at[start + length - 1] + 0.1
        chosen.append(pick)
    return chosen


def phrase_windows(lines: DataFrame, heard: DataFrame, ordered: bool = True) -> DataFrame:
    """DP12 (ordered: all lines together, in order) and DP13 (one by one): for each line (song_id, line_id, phrase) its window of
    the heard characters (song_id, place, text, at), with the times of characters that match; lines without one are left out.
    A song's lines and characters meet in one task; repeated windows are compared once."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("line_id"), right[right["text"].str.len() == 1].sort_values("place")
        at, found = right["at"].to_numpy(float), Heard("".join(right["text"]))
        phrases = [p or "" for p in left["phrase"]]
        out = []
        for line, w in zip(left["line_id"], in_order(found, phrases) if ordered else one_by_one(found, phrases, at), strict=True):
            if w:
                start, length, ratio, blocks = w
                end = start + length
                known = [(b.a + k, at[start + b.b + k]) for b in blocks for k in range(b.size)]
                out.append((key[0], line, at[start], min(at[end - 1] + 0.6, at[end] if end < len(at) else np.inf), round(ratio, 6), [i for i, _ in known], [t for _, t in known]))
        return pd.DataFrame(out, columns=["song_id", "line_id", "start_s", "end_s", "similarity", "places", "times"])

    schema = "song_id long, line_id long, start_s double, end_s double, similarity double, places array<int>, times array<double>"
    return spread(lines, "song_id").groupBy("song_id").cogroup(spread(heard, "song_id").groupBy("song_id")).applyInPandas(run, schema)


def ordered_lines(characters: DataFrame) -> DataFrame:
    """ED8 over (song_id, char_id, line_id, start_s, end_s, acoustic, manual): the text owns the order of lines. A line whose times
    overlap, or lie before a line accepted earlier or after the sure start of a later one, waits: its characters lose their
    times but for those that were placed by hand. Characters without times are unresolved."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["line_id", "char_id"]).reset_index(drop=True)
        start, stop = (rows[c].to_numpy(dtype=float, na_value=np.nan) for c in ("start_s", "end_s"))
        timed = np.isfinite(start) & np.isfinite(stop)
        acoustic, line = timed & rows["acoustic"].astype(bool).to_numpy(), rows["line_id"][rows["line_id"].notna()].to_numpy()
        edges = [0, *(np.flatnonzero(line[1:] != line[:-1]) + 1).tolist(), len(line)] if len(line) else [0]
        parts = [slice(a, z) for a, z in pairwise(edges)]
        sure = [start[p][acoustic[p]] for p in parts]
        first = np.array([s.min() if len(s) >= 2 else np.inf for s in sure])
        end, waits = 0.0, np.zeros(len(rows), dtype=bool)
        for i, p in enumerate(parts):
            s, e = start[p][timed[p]], stop[p][timed[p]]
            if not len(s):
                continue
            later = first[i + 1 :]
            bound = later[later >= end].min(initial=np.inf)
            if (s < end - 1e-3).any() or (e > bound + 1e-3).any() or (e <= s).any() or (s[1:] < e[:-1] - 1e-3).any():
                waits[p] = True
            else:
                end = max(end, e.max())
        lost = waits & ~rows["manual"].astype(bool).to_numpy()
        kept = lambda c, drop: rows[c].astype(float).mask(drop)
        return pd.DataFrame({"song_id": key[0], "char_id": rows["char_id"], "line_id": rows["line_id"], "start_s": kept("start_s", lost), "end_s": kept("end_s", lost), "observed_start": kept("start_s", ~lost), "observed_end": kept("end_s", ~lost), "pending": waits})

    return spread(characters, "song_id").groupBy("song_id").applyInPandas(run, "song_id long, char_id long, line_id long, start_s double, end_s double, observed_start double, observed_end double, pending boolean")


def _sung(spark, sf_dir):
    """Lines of the characters table and what was heard of them: every ninth character is missed."""
    c = adapters.view(spark, sf_dir, "characters")
    lines = c.groupBy("song_id", "line_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY char_id)").alias("phrase"))
    return lines, c.where("char_id % 9 > 0").select("song_id", F.col("char_id").alias("place"), "text", F.col("start_s").alias("at"))


def _paired(spark, sf_dir):
    lines = adapters.view(spark, sf_dir, "lines")
    return lines.selectExpr("conv_id * 1000 + turn AS pair_id", "text AS heard", "lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS correct")


QUERIES = {
    "phrase_likeness": lambda s, d: compared(_paired(s, d)),
    "ordered_phrase_windows": lambda s, d: phrase_windows(*_sung(s, d)),
    "phrase_windows": lambda s, d: phrase_windows(*_sung(s, d), ordered=False),
    # one line in seven is heard eight seconds early
    "ordered_lines": lambda s, d: ordered_lines(adapters.view(s, d, "characters").selectExpr("song_id", "char_id", "line_id", "start_s - CASE WHEN line_id % 7 = 3 THEN 8 ELSE 0 END AS start_s", "end_s - CASE WHEN line_id % 7 = 3 THEN 8 ELSE 0 END AS end_s", "char_id % 4 > 0 AS acoustic", "manual")),
}
