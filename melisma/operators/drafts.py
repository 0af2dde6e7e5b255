"""Drafts of scores as models write them: clear aliases are normalized, what can't be read is set aside with its reason, all else stays."""

from ..plans.sqlop import operator
from ..sources import adapters

_INT = lambda x: f"({x} IS NOT NULL AND {x} = floor({x}))"
_MARKS = lambda cases: "concat(" + ", ".join(f"CASE WHEN {c} THEN '{name} ' ELSE '' END" for c, name in cases) + ")"

#: Fields of a draft are texts; a number in quotes counts as one.
notes = operator("displayable_notes", "draft_notes", f"""
WITH p AS (SELECT score_id, note_id, {", ".join(f"{c} IS NOT NULL AS has_{c}, try_cast({c} AS DOUBLE) AS {c}" for c in ("degree", "base", "octave", "dots", "accidental", "grace_degree", "grace_octave", "grace_base"))} FROM {{draft_notes}}),
a AS (SELECT *, coalesce(degree = 8, false) AS eighth, CASE WHEN {_INT("octave")} THEN octave ELSE 0e0 END AS whole_octave, coalesce(grace_degree = 8, false) AS grace_eighth, CASE WHEN {_INT("grace_octave")} THEN grace_octave ELSE 0e0 END AS grace_whole FROM p),
b AS (SELECT *, CASE WHEN eighth THEN 1e0 WHEN {_INT("degree")} AND degree BETWEEN 0 AND 7 THEN degree END AS d, CASE WHEN NOT has_octave AND NOT eighth THEN 0e0 WHEN eighth THEN least(whole_octave + 1, 2e0) ELSE octave END AS o, CASE WHEN NOT has_base THEN 4e0 WHEN base = 32 THEN 16e0 ELSE base END AS u, CASE WHEN NOT has_dots THEN 0e0 ELSE dots END AS k,
             CASE WHEN grace_eighth THEN 1e0 ELSE grace_degree END AS gd, CASE WHEN grace_eighth THEN least(grace_whole + 1, 2e0) ELSE grace_octave END AS go FROM a),
c AS (SELECT *, d IS NULL AS bad_degree, NOT coalesce(u IN (1, 2, 4, 8, 16), false) AS bad_base, d IS NOT NULL AND NOT coalesce(o IN (-2, -1, 0, 1, 2), false) AS bad_octave, NOT coalesce(k IN (0, 1), false) AS bad_dots, d IS NOT NULL AND has_accidental AND NOT coalesce(accidental IN (-1, 0, 1), false) AS bad_accidental,
             has_grace_degree OR has_grace_octave OR has_grace_base AS graced, coalesce(d BETWEEN 1 AND 7 AND {_INT("gd")} AND gd BETWEEN 1 AND 7 AND go IN (-2, -1, 0, 1, 2) AND grace_base IN (8, 16), false) AS good_grace FROM b)
SELECT score_id, note_id, CAST(coalesce(d, 0) AS BIGINT) AS degree, CAST(CASE WHEN bad_base THEN 4 ELSE u END AS BIGINT) AS base, CAST(CASE WHEN coalesce(d, 0) = 0 OR bad_octave THEN 0 ELSE o END AS BIGINT) AS octave, CAST(CASE WHEN bad_dots THEN 0 ELSE k END AS BIGINT) AS dots,
       CAST(CASE WHEN coalesce(d, 0) = 0 OR bad_accidental THEN NULL ELSE accidental END AS BIGINT) AS accidental, {", ".join(f"CAST(CASE WHEN good_grace THEN {x} END AS BIGINT) AS {n}" for n, x in (("grace_degree", "gd"), ("grace_octave", "go"), ("grace_base", "grace_base")))},
       trim({_MARKS([("eighth AND whole_octave >= 2", "degree"), ("bad_degree", "degree"), ("bad_base", "base"), ("bad_octave", "octave"), ("bad_dots", "dots"), ("bad_accidental", "accidental"), ("d IS NOT NULL AND graced AND (grace_eighth AND grace_whole >= 2 OR NOT good_grace)", "grace")])}) AS unresolved,
       trim({_MARKS([("NOT has_base", "base_default"), ("eighth AND whole_octave < 2", "octave_degree_normalized"), ("coalesce(base = 32, false)", "duration_truncated"), ("grace_eighth AND grace_whole < 2 AND d IS NOT NULL", "grace_octave_normalized")])}) AS warnings FROM c
""", "DQ5: fields of a draft's notes, with defaults for those that are missing, aliases written out, and the fields that only a placeholder stands for")

heads = operator("displayable_heads", "draft_heads", """
WITH m AS (SELECT *, [[strip:title|' ']] AS name, [[matches:score_key|'^[A-G][#b♯♭]?$']] AS keyed, replace(meter, ' ', '') IN ('2/4', '3/4', '4/4', '6/8') AS metered FROM {draft_heads})
SELECT score_id, CASE WHEN coalesce(name, '') = '' THEN '未命名视觉谱' ELSE substr(title, 1, 200) END AS title, CASE WHEN coalesce(keyed, false) THEN replace(replace(score_key, '♯', '#'), '♭', 'b') ELSE 'C' END AS score_key,
       CASE WHEN coalesce(metered, false) THEN replace(meter, ' ', '') ELSE '4/4' END AS meter, CASE WHEN tempo BETWEEN 40 AND 240 THEN tempo END AS tempo,
       CASE WHEN guitar_mode IN ('concert', 'fingering') AND guitar_shape IN ('C', 'G') AND capo BETWEEN -12 AND 12 THEN capo END AS capo, CASE WHEN guitar_mode IN ('concert', 'fingering') AND guitar_shape IN ('C', 'G') AND capo BETWEEN -12 AND 12 THEN guitar_shape END AS guitar_shape,
       trim(concat(CASE WHEN coalesce(name, '') = '' THEN 'missing_title ' ELSE '' END, CASE WHEN length(title) > 200 THEN 'title_truncated ' ELSE '' END, CASE WHEN coalesce(keyed, false) THEN '' ELSE 'invalid_key ' END, CASE WHEN coalesce(metered, false) THEN '' ELSE 'invalid_meter ' END,
            CASE WHEN tempo IS NOT NULL AND NOT tempo BETWEEN 40 AND 240 THEN 'pending_tempo ' ELSE '' END, CASE WHEN guitar_mode IS NOT NULL AND NOT coalesce(guitar_mode IN ('concert', 'fingering') AND guitar_shape IN ('C', 'G') AND capo BETWEEN -12 AND 12, false) THEN 'pending_guitar ' ELSE '' END)) AS warnings FROM m
""", "DQ5: title, key, meter, tempo and guitar of a draft, defaults where they can't be read, and why")

lyrics = operator("pending_lyrics", "draft_lyrics notes", """
WITH o AS (SELECT note_id, score_id, m_idx, degree, row_number() OVER (PARTITION BY score_id ORDER BY m_idx, n_idx) AS place FROM {notes}),
l AS (SELECT l.*, o.m_idx, CASE WHEN o.note_id IS NULL THEN 'no note' WHEN o.degree = 0 THEN 'rest' WHEN l.verse IS NULL OR l.verse NOT BETWEEN 1 AND 4 THEN 'verse' WHEN l.text IS NULL OR [[strip:l.text|' ']] = '' OR length(l.text) > 80 THEN 'text' END AS first_reason,
             CASE WHEN l.offset_x IS NOT NULL AND (isnan(l.offset_x) OR abs(l.offset_x) > 2000) THEN 'offset' WHEN l.end_note_id IS NOT NULL AND (e.note_id IS NULL OR e.score_id <> o.score_id OR e.place < o.place) THEN 'end note' END AS last_reason FROM {draft_lyrics} AS l LEFT JOIN o ON o.note_id = l.note_id LEFT JOIN o AS e ON e.note_id = l.end_note_id),
d AS (SELECT *, row_number() OVER (PARTITION BY note_id, verse, first_reason IS NULL AND last_reason IS NULL ORDER BY seq) AS k, sum(CASE WHEN first_reason IS NULL AND last_reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, verse ORDER BY seq) AS kept FROM l)
SELECT seq, note_id, verse, text, m_idx AS measure, CASE WHEN first_reason IS NOT NULL THEN first_reason WHEN kept > 1 OR kept = 1 AND last_reason IS NOT NULL THEN 'twice' ELSE last_reason END AS reason FROM d
""", "DQ5: lyrics of a draft that have a place, and the first reason why the others wait for one")

_N = adapters.VIEWS["notes"]
_V = "VARCHAR(20)"
adapters.VIEWS |= {
    "draft_notes": f"""SELECT score_id, note_id, CASE note_id % 11 WHEN 3 THEN '8' WHEN 5 THEN 'x' WHEN 7 THEN NULL ELSE CAST(degree AS {_V}) END AS degree, CASE note_id % 13 WHEN 2 THEN '32' WHEN 4 THEN '5' WHEN 6 THEN NULL ELSE CAST(base AS {_V}) END AS base, CASE note_id % 17 WHEN 1 THEN '3' WHEN 2 THEN NULL ELSE CAST(octave AS {_V}) END AS octave,
        CASE note_id % 19 WHEN 1 THEN '2' WHEN 2 THEN NULL ELSE CAST(dots AS {_V}) END AS dots, CASE note_id % 23 WHEN 1 THEN '#' WHEN 2 THEN NULL ELSE CAST(accidental AS {_V}) END AS accidental, CASE WHEN note_id % 7 = 0 THEN CAST(note_id % 10 AS {_V}) END AS grace_degree, CASE WHEN note_id % 7 = 0 THEN CAST(note_id % 4 - 1 AS {_V}) END AS grace_octave,
        CASE WHEN note_id % 7 = 0 THEN CASE WHEN note_id % 5 = 0 THEN '4' ELSE '8' END END AS grace_base FROM ({_N}) AS n""",
    "draft_heads": "SELECT DISTINCT CAST(floor(l_orderkey / 32) AS BIGINT) AS score_id, CASE CAST(floor(l_orderkey / 32) AS BIGINT) % 7 WHEN 0 THEN ' ' WHEN 1 THEN repeat('ab', 120) ELSE 'song' END AS title, CASE CAST(floor(l_orderkey / 32) AS BIGINT) % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'B♭' WHEN 2 THEN 'F#' ELSE 'G' END AS score_key, CASE CAST(floor(l_orderkey / 32) AS BIGINT) % 4 WHEN 0 THEN '6 / 8' WHEN 1 THEN '5/4' ELSE '3/4' END AS meter, 20 + CAST(floor(l_orderkey / 32) AS BIGINT) % 300 AS tempo, CASE WHEN CAST(floor(l_orderkey / 32) AS BIGINT) % 3 = 0 THEN 'fingering' END AS guitar_mode, CASE WHEN CAST(floor(l_orderkey / 32) AS BIGINT) % 6 = 0 THEN 'C' ELSE 'D' END AS guitar_shape, CAST(floor(l_orderkey / 32) AS BIGINT) % 15 AS capo FROM {lineitem}",
    "draft_lyrics": f"SELECT note_id * 10 + k AS seq, note_id + note_id % 3 AS note_id, (note_id + k) % 6 AS verse, CASE WHEN note_id % 29 = 0 THEN ' ' WHEN note_id % 31 = 0 THEN repeat('la', 50) ELSE 'la' END AS text, CASE WHEN note_id % 37 = 0 THEN 25e2 END AS offset_x, CASE WHEN note_id % 5 = 0 THEN note_id + 1 WHEN note_id % 5 = 1 THEN note_id - 100 END AS end_note_id FROM ({_N}) AS s CROSS JOIN (VALUES (0), (1), (6)) AS d(k)",
}
adapters.TABLES |= {name: "lineitem" for name in ("draft_notes", "draft_heads", "draft_lyrics")}
