"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

import re
from pathlib import Path

from melisma import llm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "The cat sat on the mat with the other cat. MIT License", "en", "a", 10),
    (2, "The cat sat on the mat with the other cat. MIT License", "en", "a", 10),
    (3, None, "en", None, None),
    (4, "", "de", "b", 0),
    (5, "  \n\t ", None, "b", 3),
    (6, "12345 67890 !!", "fr", "c", 12),
    (7, "Über größe Straße und ähnliche Wörter", "de", "b", 9),
    (8, "word " * 20_000, "en", "a", 5),
    (9, "une élève très âgée où ça — 日本語 \U0001f600 fin", "fr", None, 8),
    (9, "une élève très âgée où ça — 日本語 \U0001f600 fin", "fr", None, 8),
    (None, "nobody knows this one", "en", "a", 1),
    (10, "licensed under the gnu general public license and the apache license", "en", "a", 1),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, rows=ODD):
    """The same rows with columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    extra = {name: F.lit(name) for name in ("score", "shard", "row", "unit", "block", "node", "words", "size", "row_key", "lang_pred", "label", "letters", "copies")}
    return frame(spark, rows).withColumns(extra)


def own_names():
    """Every column name beginning with an underscore that the subpackage uses."""
    code = "".join(p.read_text() for p in Path(llm.__file__).parent.glob("*.py"))
    return sorted(set(re.findall(r"""["'](_[a-z_0-9]+)["']""", code)) | {"_rest", "_0", "_1"})


def saved(spark, tmp_path, rows=ODD, name="documents"):
    frame(spark, rows).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
