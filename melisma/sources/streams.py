"""Recorded answers of services, read as rows: newline-delimited events, and server-sent events of text parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import adapters

#: The largest answer in characters.
MOST_TEXT = 2_000_000


def event_lines(streams: DataFrame) -> DataFrame:
    """IO15 over (stream_id, body): of each stream its joined delta texts, number of progress messages, last result, and the
    first problem: 'event' (a line that is no JSON), the stream's own error, or 'no result' where it broke off. Blank lines don't
    count; a null body is an empty one."""
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    # events as they come, without a shuffle: a stream is one row
    events = F.transform(lines, lambda x: F.struct(x.alias("line"), F.get_json_object(x, "$.type").alias("type")))
    of = lambda kind: F.filter("events", lambda e: e["type"] == kind)
    field = lambda e, name: F.get_json_object(e["line"], f"$.{name}")
    bad = F.element_at(F.filter("events", lambda e: e["type"].isNull() | (e["type"] == "error")), 1)
    problem = F.when(F.size(F.filter("events", lambda e: e["type"].isNull() | (e["type"] == "error"))) > 0, F.when(bad["type"].isNull(), "event").otherwise(F.coalesce(field(bad, "error"), F.lit("error"))))
    results = of("result")
    return streams.select("stream_id", events.alias("events")).select(
        "stream_id",
        F.array_join(F.transform(of("delta"), lambda e: field(e, "text")), "").alias("delta_text"),
        F.size(F.filter("events", lambda e: e["type"].isin("started", "progress"))).cast("long").alias("progress"),
        F.when(F.size(results) > 0, F.element_at(results, -1)["line"]).alias("result"),
        F.coalesce(problem, F.when(F.size(results) == 0, "no result")).alias("problem"),
    )


def sent_events(streams: DataFrame) -> DataFrame:
    """IO16 over (stream_id, body): text of server-sent events whose data hold candidates with text parts. Parts marked as
    thoughts are left out. problem: 'blocked', the error's message, 'finish' (not stopped by itself), 'size' or 'empty'."""
    blocks = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n", "\n"), "\n\n")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, 6, 1 << 30))), "\n"))
    schema = "error struct<message:string>, promptFeedback struct<blockReason:string>, candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>"
    values = F.transform(F.filter(data, lambda x: ~x.isin("", "[DONE]")), lambda x: F.from_json(x, schema))
    head = lambda v: F.get(v["candidates"], 0)
    parts = F.filter(F.flatten(F.filter(F.transform("values", lambda v: head(v)["content"]["parts"]), lambda p: p.isNotNull())), lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False)))
    known = lambda get: F.filter(F.transform("values", get), lambda x: x.isNotNull())
    read = streams.select("stream_id", values.alias("values")).select(
        "stream_id", F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.get(known(lambda v: v["error"]["message"]), 0).alias("error"),
        F.get(known(lambda v: v["promptFeedback"]["blockReason"]), 0).alias("blocked"), F.try_element_at(known(lambda v: head(v)["finishReason"]), F.lit(-1)).alias("finish"),
    )
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("blocked").isNotNull(), "blocked").when(F.length("text") > MOST_TEXT, "size").when(~F.col("finish").eqNullSafe("STOP"), "finish").when(F.col("text") == "", "empty")
    return read.select("stream_id", "text", problem.alias("problem"))


def sent_choices(streams: DataFrame) -> DataFrame:
    """IO16 over (stream_id, body): text of server-sent events whose data hold choices with deltas. Comments and [DONE] don't count.
    problem: the error's message, 'size', 'finish' (not stopped by itself) or 'empty'."""
    blocks = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n", "\n"), "\n\n")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, 6, 1 << 30))), "\n"))
    schema = "error struct<message:string>, choices array<struct<delta:struct<content:string>,finish_reason:string>>, usage struct<total_tokens:bigint>"
    values = F.transform(F.filter(data, lambda x: ~x.isin("", "[DONE]")), lambda x: F.from_json(x, schema))
    first = lambda v: F.get(v["choices"], 0)
    known = lambda get: F.filter(F.transform("values", get), lambda x: x.isNotNull())
    read = streams.select("stream_id", values.alias("values")).select(
        "stream_id", F.array_join(known(lambda v: first(v)["delta"]["content"]), "").alias("text"), F.get(known(lambda v: F.when(v["error"].isNotNull(), F.coalesce(v["error"]["message"], F.lit("error")))), 0).alias("error"),
        F.try_element_at(known(lambda v: first(v)["finish_reason"]), F.lit(-1)).alias("finish"), F.try_element_at(known(lambda v: v["usage"]["total_tokens"]), F.lit(-1)).alias("tokens"),
    )
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.length("text") > MOST_TEXT, "size").when(~F.col("finish").eqNullSafe("stop"), "finish").when(F.col("text") == "", "empty")
    return read.select("stream_id", "text", "tokens", problem.alias("problem"))


def _chosen(spark, sf_dir):
    """Each conversation as a recorded answer of choices."""
    lines = adapters.view(spark, sf_dir, "lines").where("text IS NOT NULL")
    event = F.concat(F.lit(": kept alive\n\ndata: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    whole = lines.withColumn("event", event).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "event"))), lambda x: x["event"]), "\n\n").alias("pieces"))
    end = '\n\ndata: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"total_tokens":7}}\n\ndata: [DONE]\n\n'
    return whole.select(F.col("conv_id").alias("stream_id"), F.when(F.col("conv_id") % 5 == 0, F.col("pieces")).otherwise(F.concat("pieces", F.lit(end))).alias("body"))


def _bodies(spark, sf_dir, sent: bool):
    """Each conversation as a recorded answer: its turns are the pieces, every fifth breaks off."""
    lines = adapters.view(spark, sf_dir, "lines").where("text IS NOT NULL")
    if sent:
        event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content"))).alias("candidates"))))
        end, gap = 'data: {"candidates":[{"finishReason":"STOP"}]}', "\n\n"
    else:
        event, end, gap = F.to_json(F.struct(F.lit("delta").alias("type"), "text")), '{"type":"result","text":"done"}', "\n"
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "event"))), lambda x: x["event"])
    whole = lines.withColumn("event", event).groupBy("conv_id").agg(F.array_join(pieces, gap).alias("pieces"))
    return whole.select(F.col("conv_id").alias("stream_id"), F.when(F.col("conv_id") % 5 == 0, F.col("pieces")).otherwise(F.concat("pieces", F.lit(gap + end))).alias("body"))


_TEXT = "WITH t AS (SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn, role) AS whole FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) "
QUERIES = {"event_lines": lambda s, d: event_lines(_bodies(s, d, sent=False)), "sent_events": lambda s, d: sent_events(_bodies(s, d, sent=True)), "sent_choices": lambda s, d: sent_choices(_chosen(s, d))}
ORACLES = {
    "event_lines": _TEXT + """SELECT stream_id, whole AS delta_text, CAST(0 AS BIGINT) AS progress, CASE WHEN stream_id % 5 > 0 THEN '{"type":"result","text":"done"}' END AS result, CASE WHEN stream_id % 5 = 0 THEN 'no result' END AS problem FROM t""",
    "sent_choices": _TEXT + "SELECT stream_id, whole AS text, CASE WHEN stream_id % 5 > 0 THEN CAST(7 AS BIGINT) END AS tokens, CASE WHEN stream_id % 5 = 0 THEN 'finish' END AS problem FROM t",
    "sent_events": _TEXT + "SELECT stream_id, whole AS text, CASE WHEN stream_id % 5 = 0 THEN 'finish' END AS problem FROM t",
}
