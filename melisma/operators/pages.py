"""A printed page read into notes: rows, bars, notes, then lyrics and chords to notes by their place, with key, meter and title."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import kept
from ..sources import adapters
from .anchored import baseline_rows

#: Fixed values of the reading: glyphs taken for digits, holds, accidentals and dots; the title of a page that has none.
CJK, DIGITS = "[\\u3400-\\u9fff]", "[0-7]"
UNTITLED = "图片导入的简谱"


class Page:
    """notes, chords, heads (one row a page: key, meter, title, rows without bars): all carry page_id. Each is worked out when it is
    asked for, so that heads don't wait for notes; tables that several of them need are written once."""

    def __init__(self, observations: DataFrame, bars: DataFrame, printed: DataFrame):
        self._observations, self._given, self._printed = observations, bars, printed

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self._observations.sparkSession.sql(text, **frames)

    @cached_property
    def _bars(self) -> DataFrame:
        return kept(self._given.select("page_id", "y", "x"), "page-bars")

    @cached_property
    def _glyphs(self) -> DataFrame:
        seen = kept(self._observations.where(F.size("glyphs") > 0).withColumns({"tab": F.coalesce("tab", F.lit(False)), "width": F.col("width").cast("double")}), "page-glyphs")
        music = F.size(F.filter("glyphs", lambda g: g["ch"].rlike("^[0-7iIjJlL•.\\-—|:：]$"))) / F.size("glyphs") > 0.55
        measured = seen.select("page_id", "place", _middle("y").alias("y"), _middle("height").alias("height"), F.exists("glyphs", lambda g: g["ch"].rlike(CJK)).alias("lyric"), music.alias("music"), F.transform("glyphs", lambda g: g["y"]).alias("ys"), F.transform("glyphs", lambda g: g["height"]).alias("heights"))
        fields = ("ch", "x", "y", "height", "octave", "dots", "beams")
        return kept(seen.join(baseline_rows(measured), ["page_id", "place"]).select("page_id", "page_row", "tab", "width", F.explode("glyphs").alias("g")).select("page_id", "page_row", "tab", "width", *[F.col(f"g.{c}").alias(c) for c in fields]), "page-rows-of-glyphs")

    @cached_property
    def _rows(self) -> DataFrame:
        return kept(self._sql(ROWS, glyphs=self._glyphs, bars=self._bars), "page-rows")

    @cached_property
    def _written(self) -> DataFrame:
        return kept(self._sql(NOTES, glyphs=self._glyphs, rows=self._rows, bars=self._bars), "page-notes")

    @property
    def notes(self) -> DataFrame:
        notes = self._written
        sung = notes.join(self._sql(LYRICS, glyphs=self._glyphs, rows=self._rows, notes=notes), ["page_id", "place"], "left").withColumn("lyric", F.coalesce("lyric", F.lit("")))
        return sung.select("page_id", "place", "measure", "degree", "accidental", "octave", "base", "dots", "hold", "lyric")

    @property
    def chords(self) -> DataFrame:
        notes, rows, bars = self._written, self._rows, self._bars
        # a row's first measure, from any of its notes
        first = notes.join(rows.where("melody").select("page_id", "system"), ["page_id", "system"]).groupBy("page_id", "system").agg(F.min("measure").alias("least"), F.min("x").alias("x"))
        begun = first.join(bars.join(rows.where("melody").select("page_id", "system", F.col("y").alias("row_y"), "height"), "page_id").where("abs(y - row_y) <= greatest(18e-3, 75e-2 * height)").select("page_id", "system", F.col("x").alias("bar_x")), ["page_id", "system"], "left").groupBy("page_id", "system").agg((F.min("least") - F.count(F.when(F.col("bar_x") < F.col("x"), 1))).alias("first_measure"))
        return self._sql(CHORDS, glyphs=self._glyphs, rows=rows, bars=bars, printed=self._printed).join(begun, ["page_id", "system"]).select("page_id", (F.col("first_measure") + F.col("bars_before")).alias("measure"), "x", "label")

    @property
    def heads(self) -> DataFrame:
        return self._sql(HEADS, rows=self._rows)


def _middle(column: str):
    return F.element_at(F.array_sort(F.transform("glyphs", lambda g: g[column])), F.floor(F.size("glyphs") / 2).cast("int") + 1)


ROWS = f"""
WITH l AS (SELECT page_id, page_row, array_join(transform(array_sort(collect_list(struct(x, ch))), s -> s.ch), '') AS text, array_sort(collect_list(y)) AS ys, array_sort(collect_list(height)) AS heights, max(tab) AS tab, count_if(ch RLIKE '^{DIGITS}$') AS digits, max(ch RLIKE '{CJK}') AS sung FROM {{glyphs}} GROUP BY page_id, page_row),
m AS (SELECT *, ys[CAST(floor(size(ys) / 2) AS INT)] AS y, heights[CAST(floor(size(heights) / 2) AS INT)] AS height FROM l),
b AS (SELECT m.page_id, m.page_row, count(b.x) AS bars FROM m LEFT JOIN {{bars}} AS b ON b.page_id = m.page_id AND abs(b.y - m.y) <= greatest(18e-3, 75e-2 * m.height) GROUP BY m.page_id, m.page_row),
k AS (SELECT m.page_id, m.page_row, m.text, m.y, m.height, m.sung, b.bars, m.digits >= 2 AND NOT m.text RLIKE '(?i)1\\\\s*[=＝]\\\\s*[A-G]' AND NOT m.tab AND (m.digits >= 3 OR b.bars >= 2) AND (b.bars > 0 OR m.digits <= 8) AS melody FROM m JOIN b ON b.page_id = m.page_id AND b.page_row = m.page_row)
SELECT *, CASE WHEN melody THEN sum(CASE WHEN melody THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY page_row) END AS system, lead(CASE WHEN melody THEN y END) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY page_row) AS next_y, lag(CASE WHEN melody THEN y END) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY page_row) AS prior_y FROM k
"""

NOTES = f"""
WITH g AS (SELECT x.page_id, x.page_row, r.system, x.ch, x.x, x.octave, x.dots, x.beams, x.width, CASE WHEN x.ch RLIKE '^[#♯b♭]$' THEN 'accidental' WHEN x.ch RLIKE '^[-—–]$' THEN 'hold' WHEN x.ch RLIKE '^[0-7%ziIlL]$' THEN 'digit' WHEN x.ch RLIKE '^[.．·•]$' THEN 'dot' END AS kind,
        CASE WHEN x.ch = '%' THEN 6 WHEN x.ch = 'z' THEN 7 WHEN x.ch RLIKE '^[iIlL]$' THEN 1 WHEN x.ch RLIKE '^{DIGITS}$' THEN CAST(x.ch AS INT) END AS degree
      FROM {{glyphs}} AS x JOIN {{rows}} AS r ON r.page_id = x.page_id AND r.page_row = x.page_row WHERE r.melody),
b AS (SELECT r.page_id, r.system, b.x FROM {{bars}} AS b JOIN {{rows}} AS r ON r.page_id = b.page_id AND r.melody AND abs(b.y - r.y) <= greatest(18e-3, 75e-2 * r.height)),
n AS (SELECT g.page_id, g.system, g.x, g.ch, g.kind, g.degree, g.octave, g.dots, g.beams, g.width, count(CASE WHEN b.x < g.x THEN 1 END) AS bars_before, coalesce(max(abs(b.x - g.x) * g.width <= 10), false) AND g.ch RLIKE '^[1iIlL]$' AS is_bar FROM g LEFT JOIN b ON b.page_id = g.page_id AND b.system = g.system WHERE g.kind IS NOT NULL GROUP BY ALL),
d AS (SELECT *, last_value(CASE WHEN kind = 'digit' AND NOT is_bar THEN struct(x, degree, dots) END) IGNORE NULLS OVER (PARTITION BY page_id, system ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS digit FROM n),
h AS (SELECT *, kind = 'hold' AND coalesce(digit.dots > 0 AND (x - digit.x) * width < 35, false) AS is_dot FROM d),
a AS (SELECT *, lag(CASE WHEN kind = 'accidental' THEN ch ELSE '' END) OVER (PARTITION BY page_id, system ORDER BY x) AS sign FROM h WHERE kind <> 'dot' AND NOT is_dot),
k AS (SELECT page_id, system, x, bars_before, kind = 'hold' AND coalesce(digit.degree, 0) > 0 AS hold, CASE WHEN kind = 'hold' THEN coalesce(digit.degree, 0) ELSE degree END AS degree, CASE WHEN kind = 'digit' AND sign RLIKE '^[b♭]$' THEN -1 WHEN kind = 'digit' AND sign RLIKE '^[#♯]$' THEN 1 ELSE 0 END AS accidental,
             CASE WHEN kind = 'digit' THEN coalesce(octave, 0) ELSE 0 END AS octave, CASE WHEN kind = 'digit' THEN 4 * CAST(pow(2, least(2, coalesce(beams, 0))) AS INT) ELSE 4 END AS base, CASE WHEN kind = 'digit' THEN coalesce(dots, 0) ELSE 0 END AS dots FROM a WHERE kind IN ('digit', 'hold') AND NOT is_bar),
e AS (SELECT k.page_id, k.system, k.x FROM (SELECT page_id, system, x, last_value(CASE WHEN mark = 0 THEN x END) IGNORE NULLS OVER (PARTITION BY page_id, system ORDER BY x, mark DESC) AS before, mark FROM (SELECT page_id, system, x, 0 AS mark FROM k UNION ALL SELECT page_id, system, x, 1 FROM n WHERE kind = 'dot') AS u) AS v
        JOIN k ON k.page_id = v.page_id AND k.system = v.system AND k.x = v.before WHERE v.mark = 1 AND v.x - v.before < 32e-3 GROUP BY ALL),
w AS (SELECT page_id, system, greatest(1, max(m)) AS measures FROM (SELECT page_id, system, max(bars_before) + 1 AS m FROM k GROUP BY 1, 2 UNION ALL SELECT page_id, system, bars FROM {{rows}} WHERE melody) AS u GROUP BY page_id, system),
f AS (SELECT page_id, system, sum(measures) OVER (PARTITION BY page_id ORDER BY system) - measures AS earlier FROM w)
SELECT k.page_id, k.system, CAST(row_number() OVER (PARTITION BY k.page_id ORDER BY k.system, k.x) AS BIGINT) AS place, f.earlier + k.bars_before + 1 AS measure, k.x, k.degree, k.accidental, k.octave, k.base, CASE WHEN e.x IS NOT NULL THEN 1 ELSE k.dots END AS dots, k.hold
FROM k JOIN f ON f.page_id = k.page_id AND f.system = k.system LEFT JOIN e ON e.page_id = k.page_id AND e.system = k.system AND e.x = k.x
"""

LYRICS = f"""
WITH s AS (SELECT r.page_id, r.system, min(l.page_row) AS page_row FROM {{rows}} AS r JOIN {{rows}} AS l ON l.page_id = r.page_id AND l.sung AND l.y > r.y + r.height * 65e-2 AND l.y < r.y + greatest(9e-2, 4 * r.height) WHERE r.melody GROUP BY 1, 2),
c AS (SELECT s.page_id, s.system, x.ch, x.x FROM {{glyphs}} AS x JOIN s ON s.page_id = x.page_id AND s.page_row = x.page_row WHERE x.ch RLIKE '{CJK}'),
n AS (SELECT page_id, system, x, place FROM {{notes}} WHERE degree > 0 AND NOT hold),
u AS (SELECT page_id, system, x, NULL AS ch, place FROM n UNION ALL SELECT page_id, system, x, ch, NULL FROM c),
t AS (SELECT *, last_value(CASE WHEN ch IS NULL THEN struct(x, place) END) IGNORE NULLS OVER (PARTITION BY page_id, system ORDER BY x, ch NULLS FIRST) AS before, first_value(CASE WHEN ch IS NULL THEN struct(x, place) END) IGNORE NULLS OVER (PARTITION BY page_id, system ORDER BY x, ch NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM u),
a AS (SELECT page_id, system, x, ch, CASE WHEN after IS NULL OR x - before.x <= after.x - x THEN before.place ELSE after.place END AS place FROM t WHERE ch IS NOT NULL)
SELECT page_id, place, array_join(transform(array_sort(collect_list(struct(x, ch))), s -> s.ch), '') AS lyric FROM a WHERE place IS NOT NULL GROUP BY page_id, place
"""

CHORDS = f"""
WITH b AS (SELECT r.page_id, r.system, b.x FROM {{bars}} AS b JOIN {{rows}} AS r ON r.page_id = b.page_id AND r.melody AND abs(b.y - r.y) <= greatest(18e-3, 75e-2 * r.height)),
p AS (SELECT r.page_id, r.system, c.label, c.x FROM {{rows}} AS r JOIN {{printed}} AS c ON c.page_id = r.page_id AND c.y < r.y AND (r.prior_y IS NULL OR c.y > r.prior_y) WHERE r.melody),
z AS (SELECT r.page_id, r.system, x.ch, x.x, l.page_row FROM {{rows}} AS r JOIN {{rows}} AS l ON l.page_id = r.page_id AND NOT l.sung AND NOT l.melody AND l.y > r.y + r.height AND l.y < r.y + 18e-2 AND (r.next_y IS NULL OR l.y < r.next_y)
       JOIN {{glyphs}} AS x ON x.page_id = l.page_id AND x.page_row = l.page_row LEFT ANTI JOIN p ON p.page_id = r.page_id AND p.system = r.system WHERE r.melody),
t AS (SELECT a.page_id, a.system, a.x, concat(a.ch, coalesce(array_join(transform(array_sort(collect_list(CASE WHEN s.x IS NOT NULL THEN struct(s.x AS x, s.ch AS ch) END)), v -> v.ch), ''), '')) AS text FROM z AS a LEFT JOIN z AS s ON s.page_id = a.page_id AND s.system = a.system AND s.page_row = a.page_row AND s.x > a.x AND s.x < a.x + 35e-3 WHERE a.ch RLIKE '^[A-G]$' GROUP BY a.page_id, a.system, a.x, a.ch),
c AS (SELECT page_id, system, label, x FROM p UNION ALL SELECT page_id, system, regexp_extract(text, '(?i)^[A-G](?:[#b♯♭])?(?:maj|min|m|dim|aug|sus|add)?(?:\\\\d+)?(?:/[A-G][#b♯♭]?)?', 0), x FROM t)
SELECT c.page_id, c.system, c.x, c.label, count(b.x) AS bars_before FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.system = c.system AND b.x < c.x GROUP BY c.page_id, c.system, c.x, c.label
"""

HEADS = f"""
WITH t AS (SELECT page_id, array_join(transform(array_sort(collect_list(struct(page_row, text))), s -> s.text), '\\n') AS text, min(CASE WHEN melody THEN y END) AS first_y, count_if(melody) AS systems, count_if(melody AND bars = 0) AS unbarred FROM {{rows}} GROUP BY page_id),
n AS (SELECT r.page_id, min_by(r.text, r.page_row) AS title FROM {{rows}} AS r JOIN t ON t.page_id = r.page_id WHERE r.sung AND length(regexp_replace(r.text, '\\\\s', '')) >= 3 AND r.y < t.first_y - 5e-2 GROUP BY r.page_id)
SELECT t.page_id, CASE WHEN t.text RLIKE '(?i)1\\\\s*[=＝]\\\\s*[A-G]' THEN concat(regexp_extract(t.text, '(?i)1\\\\s*[=＝]\\\\s*([A-G])(?:\\\\s*([#b♯♭]))?', 1), regexp_extract(t.text, '(?i)1\\\\s*[=＝]\\\\s*([A-G])(?:\\\\s*([#b♯♭]))?', 2)) ELSE 'C' END AS score_key,
       CASE WHEN t.text RLIKE '[2346]\\\\s*[/／]\\\\s*[48]' THEN concat(regexp_extract(t.text, '([2346])\\\\s*[/／]\\\\s*([48])', 1), '/', regexp_extract(t.text, '([2346])\\\\s*[/／]\\\\s*([48])', 2)) ELSE '4/4' END AS meter, coalesce(n.title, '{UNTITLED}') AS title, t.systems, t.unbarred
FROM t LEFT JOIN n ON n.page_id = t.page_id
"""


def parsed_pages(observations: DataFrame, bars: DataFrame, printed: DataFrame) -> Page:
    """X25 over observations (page_id, place, tab, width, glyphs: array of (ch, x, y, height, octave, dots, beams)), bars (page_id, y,
    x) and printed chords (page_id, y, x, label). Places are shares of the page from its top left; octave points, dots and
    beams were counted in the picture, tab marks the rows of a tablature, width is in pixels.

    A melody row has two digits or more and no key sign; with under three it needs two bars, without bars it has eight at most.
    A digit that stands on a bar is none; a dash beside a dotted digit is its dot; a sign belongs to the next note. Measures
    count on over rows. A syllable goes to the nearest sounding note of the row above it, the first of two as near; chords
    above a row to their measure, or, where none are printed there, letters below it. Pages without melody rows have a head
    with 0 systems and no notes. Null glyph lists are empty.
    """
    return Page(observations, bars, printed)


def _pages(spark: SparkSession, sf_dir: str) -> Page:
    """Each score as a page: four measures a row, a row of syllables below, a head with key and meter."""
    n = kept(adapters.view(spark, sf_dir, "notes").select("score_id", "m_idx", "n_idx", "note_id", "degree", "base", "octave", "dots"), "page-written").withColumn("system", F.floor(F.col("m_idx") / 4))
    n = n.withColumns({"x": 0.05 + (F.col("m_idx") % 4) * 0.23 + F.col("n_idx") * 0.028, "y": 0.1 + F.col("system") * 0.1})
    glyph = lambda ch, y: F.struct(ch.alias("ch"), F.col("x").alias("x"), y.alias("y"), F.lit(0.02).alias("height"), F.least(F.col("octave"), F.lit(1)).cast("int").alias("octave"), F.col("dots").cast("int").alias("dots"), (F.col("base") / 8).cast("int").alias("beams"))
    sung = F.when((F.col("degree") > 0) & (F.col("note_id") % 3 > 0), F.substring(F.lit("天地人你我他好春夏秋冬山水火"), (F.col("note_id") % 14 + 1).cast("int"), F.lit(1)))
    music = n.groupBy("score_id", "system").agg(F.collect_list(glyph(F.when(F.col("note_id") % 9 == 0, "-").otherwise(F.col("degree").cast("string")), F.col("y"))).alias("glyphs")).withColumn("place", F.col("system") * 2 + 1)
    words = n.where(sung.isNotNull()).groupBy("score_id", "system").agg(F.collect_list(glyph(sung, F.col("y") + 0.04)).alias("glyphs")).withColumn("place", F.col("system") * 2 + 2)
    head = adapters.view(spark, sf_dir, "scores").select("score_id", F.concat(F.lit("1="), "score_key", F.lit(" "), F.lit("3/4")).alias("text")).select("score_id", F.lit(0).cast("long").alias("place"), F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("ch"), (i * 0.01 + 0.1).alias("x"), F.lit(0.02).cast("double").alias("y"), F.lit(0.01).cast("double").alias("height"), F.lit(0).alias("octave"), F.lit(0).alias("dots"), F.lit(0).alias("beams"))).alias("glyphs"))
    kind = "array<struct<ch:string,x:double,y:double,height:double,octave:int,dots:int,beams:int>>"
    seen = [d.select(F.col("score_id").alias("page_id"), F.col("place").cast("long").alias("place"), F.lit(False).alias("tab"), F.lit(1000.0).alias("width"), F.col("glyphs").cast(kind).alias("glyphs")) for d in (music, words, head)]
    bars = n.select(F.col("score_id").alias("page_id"), "y", (0.05 + (F.col("m_idx") % 4 + 1) * 0.23).alias("x")).distinct()
    printed = adapters.view(spark, sf_dir, "chords").withColumn("m_idx", F.col("measure_id") % 32).select(F.col("score_id").alias("page_id"), (0.08 + F.floor(F.col("m_idx") / 4) * 0.1).alias("y"), (0.06 + (F.col("m_idx") % 4) * 0.23).alias("x"), "label")
    return parsed_pages(seen[0].unionByName(seen[1]).unionByName(seen[2]), bars, printed)


QUERIES = {"page_notes": lambda s, d: _pages(s, d).notes, "page_chords": lambda s, d: _pages(s, d).chords, "page_heads": lambda s, d: _pages(s, d).heads}
