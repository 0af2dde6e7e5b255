"""Steps that several branches of a query read are worked out once."""

from collections import Counter

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry
from melisma.plans import sqlop
from melisma.plans.shared import kept
from melisma.plans.sqlop import REGISTRY, STORED, SqlOperator
from melisma.sources import adapters, score_documents


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bodies_are_read_once(spark, sf_dir):
    shown = plan(entry.queries()["document_violations"](spark, sf_dir))
    assert "from_json" not in shown and "to_json" not in shown and "l_orderkey" not in shown


def test_places_of_notes_run_on_over_measures(spark):
    body = '{"version": 2, "measures": [{"id": "m1", "notes": [{"id": "a"}, {"id": "b"}]}, {"id": "m2"}, {"id": "m3", "notes": [{"id": "c"}]}]}'
    found = score_documents.tables(spark.createDataFrame([(1, body), (2, "no score")], "score_id long, body string"), stored=True).notes
    assert sorted(map(tuple, found.select("note_id", "m_idx", "n_idx", "place").collect())) == [("a", 0, 0, 1), ("b", 0, 1, 2), ("c", 2, 0, 3)]


@pytest.mark.parametrize("name", ["score_timeline", "reconciled_lyrics", "relocated_lyrics"])
def test_stored_steps_give_the_rows_of_the_whole_text(spark, sf_dir, name):
    op = REGISTRY[name]
    whole = SqlOperator(op.name, op.inputs, STORED.sub(lambda m: "," * m[0].endswith(","), op.text))
    assert STORED.search(op.text) and op.oracle() == whole.oracle()
    assert Counter(map(tuple, op.query(spark, sf_dir).collect())) == Counter(map(tuple, whole.query(spark, sf_dir).collect()))


@pytest.mark.parametrize(("name", "most"), [("recording_segments", 4), ("score_timeline", 3)])
def test_steps_with_several_readers_are_planned_once(spark, sf_dir, name, most):
    assert plan(REGISTRY[name].query(spark, sf_dir)).count("Relation [") <= most


@pytest.mark.parametrize("name", ["reconciled_notes", "reconciled_lyrics", "relocated_lyrics"])
def test_notes_that_several_inputs_are_made_of_are_numbered_once(spark, sf_dir, name):
    op = REGISTRY[name]
    shown = [plan(df) for df in adapters.views(spark, sf_dir, op.inputs)]
    assert not any("l_orderkey" in p or "l_linenumber" in p for p in shown)
    for df, of in zip(adapters.views(spark, sf_dir, op.inputs), op.inputs, strict=True):
        own = adapters.view(spark, sf_dir, of)
        assert df.schema.simpleString() == own.schema.simpleString() and Counter(map(tuple, df.collect())) == Counter(map(tuple, own.collect()))


def broadcasts(df: DataFrame) -> list[str]:
    """What a plan broadcasts unaggregated out of stored tables: of each such branch, its lines."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            rest = lines[i + 1 :]
            branch = rest[: next((k for k, x in enumerate(rest) if depth(x) <= depth(line)), len(rest))]
            if any("FileScan" in x and "l_orderkey" not in x for x in branch) and not any("Aggregate" in x for x in branch):
                found.append("\n".join(branch))
    return found


def test_parsed_documents_are_not_broadcast(spark, sf_dir):
    assert broadcasts(entry.queries()["document_violations"](spark, sf_dir)) == []

@pytest.mark.parametrize("name", ["score_timeline", "recording_segments", "midi_files", "reconciled_lyrics", "relocated_lyrics"])
def test_tables_made_of_stored_ones_are_not_broadcast(spark, sf_dir, monkeypatch, name):
    seen = []
    monkeypatch.setattr(sqlop, "kept", lambda df, label: (seen.append(df), kept(df, label))[1])
    seen.append(entry.queries()[name](spark, sf_dir))
    assert [x for df in seen for x in broadcasts(df)] == []
    assert any("SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString() for df in seen)
