"""Operators declared as one SQL text over named inputs: Catalyst plans them; the same text, in another dialect, is their oracle."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import adapters
from .shared import kept

#: Behind a table of a text that several later ones read. Spark would plan it anew for each reader, and at worst twice as often with
#: every table between; its columns that are named are written to the shared folder instead, and read from there. Of the tables
#: before it only stored ones can be read behind it.
STORED = re.compile(r"\[\[stored:(\w+)\|([^\]]+)\]\],?")
#: Spellings that differ: [[name]] in a text stands for the first in Spark, the second in DuckDB. [[merged:...]] behind a SELECT
#: names tables that follow from stored ones: a hint that a table has of kept() doesn't reach joins of tables made of it.
DIALECT = {
    "merged": ("/*+ MERGE({x}) */", ""),
    "quartile1": ("percentile({x}, 25e-2)", "quantile_cont({x}, 25e-2)"),
    "quartile3": ("percentile({x}, 75e-2)", "quantile_cont({x}, 75e-2)"),
    "lower_of": ("percentile({x}, 25e-2) OVER {y}", "quantile_cont({x}, 25e-2) OVER {y}"),
    "middle_of": ("percentile({x}, 5e-1) OVER {y}", "quantile_cont({x}, 5e-1) OVER {y}"),
    "upper_of": ("percentile({x}, 75e-2) OVER {y}", "quantile_cont({x}, 75e-2) OVER {y}"),
    "strip": ("trim(BOTH {y} FROM {x})", "trim({x}, {y})"),
    "words": ("split(trim(regexp_replace({x}, '[ \\\\n]+', ' ')), ' ')", "string_split(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')), ' ')"),
    "replace_all": ("regexp_replace({x}, {y}, {z})", "regexp_replace({x}, {y}, {z}, 'g')"),
    "each_below": ("LATERAL VIEW explode(sequence(0, CAST({x} AS INT) - 1)) AS {y}", "CROSS JOIN unnest(range(CAST({x} AS INTEGER))) AS unnested({y})"),
    "find": ("regexp_extract({x}, {y}, {z})", "regexp_extract({x}, {y}, {z})"),
    "matches": ("({x} RLIKE {y})", "regexp_matches({x}, {y})"),
    "json": ("get_json_object({x}, {y})", "json_extract_string({x}, {y})"),
    "count_of": ("regexp_count({x}, {y})", "len(regexp_extract_all({x}, {y}))"),
    "letters_of": (r"regexp_replace({x}, '[^\\pL\\pN_]', '')", r"regexp_replace({x}, '[^\pL\pN_]', '', 'g')"),
    "tokens_of": ("array_join(regexp_extract_all({x}, {y}, 0), '¦')", "array_to_string(regexp_extract_all({x}, {y}), '¦')"),
    "joined_by": ("listagg({x}, '') WITHIN GROUP (ORDER BY {y})", "string_agg({x}, '' ORDER BY {y})"),
    "word_count": ("regexp_count({x}, '[^ \\\\n]+')", "len(regexp_extract_all({x}, '[^ \\n]+'))"),
}


def _dialect(text: str, which: int) -> str:
    def put(m: re.Match) -> str:
        args = [a.strip() for a in m[2].split("|")]
        out = DIALECT[m[1]][which]
        for key, arg in zip("xyz", args, strict=False):
            out = out.replace("{" + key + "}", arg)
        return out

    return re.sub(r"\[\[(\w+):(.*?)\]\]", put, text, flags=re.S)


@dataclass(frozen=True)
class SqlOperator:
    """A function of DataFrames: call it with one for each name in inputs."""

    name: str
    inputs: tuple[str, ...]
    text: str
    doc: str = ""

    def __call__(self, *frames: DataFrame) -> DataFrame:
        spark, known, told = frames[0].sparkSession, dict(zip(self.inputs, frames, strict=True)), ""
        *steps, last = STORED.split(self.text)
        for text, name, columns in zip(steps[::3], steps[1::3], steps[2::3], strict=True):
            known[f"stored_{name}"] = kept(spark.sql(_dialect(f"{told}{text}\nSELECT {columns} FROM {name}", 0), **known), f"{self.name}-{name}")
            told = f"{told or 'WITH '}{name} AS (SELECT * FROM {{stored_{name}}}),"
        return spark.sql(_dialect((told if " AS (" in last.partition("SELECT")[0] else told.rstrip(",")) + last, 0), **known)

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self(*adapters.views(spark, sf_dir, self.inputs))

    def oracle(self) -> str:
        body = _dialect(STORED.sub(lambda m: "," * m[0].endswith(","), self.text), 1).strip()
        for name in self.inputs:
            body = body.replace("{" + name + "}", name)
        views = [f"{name} AS ({adapters.oracle_view(name)})" for name in self.inputs if name in adapters.VIEWS]
        if not views:
            return body
        return f"WITH {', '.join(views)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(views)} {body}"


REGISTRY: dict[str, SqlOperator] = {}


def operator(name: str, inputs: str, text: str, doc: str = "") -> SqlOperator:
    found = REGISTRY[name] = SqlOperator(name, tuple(inputs.split()), text, doc)
    return found
