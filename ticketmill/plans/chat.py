"""Chat session summaries from a log of text chunks and tool traces.

Input: ``session_id, seq, kind, payload``; ``kind`` is ``chunk`` (payload is
text) or ``trace`` (payload is a JSON object); ``seq`` is unique in a session.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.text import strip, strip_end, strip_start
from ticketmill.operators.carry import DEFAULT_SPAN, in_blocks, running_total

# Keys under which a trace may hold each field, best first.
GROUP_KEYS = ("actionGroup", "action_group", "toolName", "name")
PATH_KEYS = ("apiPath", "path", "endpoint")
METHOD_KEYS = ("httpMethod", "method")
STATUS_KEYS = ("httpStatusCode", "statusCode", "status")
ROUTING_KEY_PARTS = ("route", "orchestrat")

CHUNKS_PER_PART = 1 << 12

TOOL_FIELDS = {"action_group": GROUP_KEYS, "api_path": PATH_KEYS, "http_method": METHOD_KEYS, "status": STATUS_KEYS}


def session_text(events: DataFrame, chunks_per_part: int = CHUNKS_PER_PART, span: int = DEFAULT_SPAN) -> DataFrame:
    """The answer of each session, rebuilt from its chunks in order and stripped, in parts.

    A part is ``chunks_per_part`` chunks, counted from the first chunk of the
    session, so gaps in ``seq`` do not matter and no task holds an endless
    session. The texts joined by ``part`` are the whole answer; parts before its
    first and after its last character are left out, and an answer without any
    has one empty part.
    """
    chunks = events.where(F.col("kind") == "chunk").select("session_id", "seq", "payload", F.lit(1).alias("one"))
    numbered = running_total(in_blocks(chunks, "seq", span), "session_id", "seq", "one", "number", span)
    part = F.call_function("div", F.col("number"), F.lit(chunks_per_part).cast("bigint"))
    listed = F.coalesce(F.expr("listagg(payload, '') WITHIN GROUP (ORDER BY seq)"), F.lit(""))
    parts = numbered.groupBy("session_id", part.alias("part")).agg(listed.alias("text"))

    text_part = F.when(strip(F.col("text")) != "", F.col("part"))
    ends = parts.groupBy("session_id").agg(F.min(text_part).alias("first"), F.max(text_part).alias("last"))
    text, empty = F.col("text"), F.col("first").isNull()
    trimmed = F.when(empty | (F.col("part") == F.col("first")), strip_start(text)).otherwise(text)
    return (
        parts.join(ends, "session_id")
        .where(F.when(empty, F.col("part") == 0).otherwise(F.col("part").between(F.col("first"), F.col("last"))))
        .withColumn("text", trimmed)
        .withColumn("text", F.when(empty | (F.col("part") == F.col("last")), strip_end(text)).otherwise(text))
        .select("session_id", "part", "text")
    )


def _first_filled(fields: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(fields[key], F.lit("")) for key in keys])


def _trace_fields(events: DataFrame) -> DataFrame:
    """All events with the keys and values of a trace as a map; NULL for chunks."""
    fields = F.when(F.col("kind") == "trace", F.from_json("payload", "map<string,string>"))
    return events.select("session_id", "seq", fields.alias("fields"))


def _with_tool_fields(traces: DataFrame) -> DataFrame:
    return traces.withColumns({name: _first_filled(F.col("fields"), keys) for name, keys in TOOL_FIELDS.items()})


def tool_invocations(events: DataFrame) -> DataFrame:
    """One row per trace that names a tool, a path, a method or a status."""
    fields = list(TOOL_FIELDS)
    traces = _trace_fields(events.where(F.col("kind") == "trace"))
    return _with_tool_fields(traces).select("session_id", "seq", *fields).where(F.coalesce(*fields).isNotNull())


def tool_usage(events: DataFrame) -> DataFrame:
    """Calls and failed calls (status 400 and up) per tool, path and status."""
    failed = F.col("status").try_cast("int") >= 400
    return (
        tool_invocations(events)
        .groupBy("action_group", "api_path", "status")
        .agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"))
    )


def session_summary(events: DataFrame, agents: Sequence[str], group_agents: Mapping[str, str]) -> DataFrame:
    """Routed agent, first tool, last path, and counts of notes and tool calls per session.

    ``agents`` are the agent labels to look for in trace values; the last one
    seen wins. Without any, the first tool in ``group_agents`` names the agent.
    ``notes`` counts traces that have a routing key. Everything is an aggregate
    with a partial step, so a session of any length is reduced before the shuffle.
    """
    traces = _with_tool_fields(_trace_fields(events))
    fields, group = F.col("fields"), F.col("action_group")
    labels = F.filter(F.map_values(fields), lambda v: v.isin(*agents))
    by_group = F.coalesce(F.lit(None).cast("string"), *[F.when(group == g, F.lit(a)) for g, a in group_agents.items()])
    routing = F.exists(
        F.map_keys(fields), lambda k: k.contains(ROUTING_KEY_PARTS[0]) | k.contains(ROUTING_KEY_PARTS[1])
    )
    marked = traces.select(
        "session_id",
        "seq",
        *TOOL_FIELDS,
        F.get(labels, 0).alias("label"),
        by_group.alias("group_label"),
        F.coalesce(routing, F.lit(False)).alias("routing"),
    )

    def seq_where_set(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col("seq"))

    return marked.groupBy("session_id").agg(
        F.coalesce(
            F.max_by("label", seq_where_set("label")), F.min_by("group_label", seq_where_set("group_label"))
        ).alias("routed_agent"),
        F.min_by("action_group", seq_where_set("action_group")).alias("last_action_group"),
        F.max_by("api_path", seq_where_set("api_path")).alias("last_api_path"),
        F.count_if("routing").alias("notes"),
        F.count_if(F.coalesce(*TOOL_FIELDS).isNotNull()).alias("invocations"),
    )
