"""The registered queries: every operator on a fixture over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.checks import fixtures as fx
from ticketmill.functions import access as fa
from ticketmill.functions import text as ft
from ticketmill.operators import expansion, filters, ingest, numbering
from ticketmill.operators import partials as stored_partials
from ticketmill.plans import access, chat, counts, partials, resolution, roster, volume
from ticketmill.session import scratch_path, staged
from ticketmill.sources import batches, documents, sql, tickets
from ticketmill.sources.schemas import TICKETS
from ticketmill.streaming import ingest as stream_ingest
from ticketmill.streaming import volume as stream_volume

Query = Callable[[SparkSession, str], DataFrame]

# Report ranges: the standard one, one that runs past the data by days, one past
# it by months, a single day, all of the narrow tickets, all of the wide ones.
STANDARD = ("2024-01-05", "2024-01-25")
DAYS = ("2024-01-25", "2024-03-04")
MONTHS = ("2023-11-01", "2024-03-31")
ONE_DAY = ("2024-01-10", "2024-01-10")
ALL = ("2023-01-01", "2025-12-31")
WIDE = ("1992-01-01", "1999-12-31")

DOMAIN = "corp.example"
NOW = datetime(2024, 1, 12, 0, 0)
SINCE = "2024-01-20T00:00:00Z"


def _on(fixture: fx.Fixture, report: Callable, *args, **kwargs) -> Query:
    """A query that runs one report on one fixture."""
    return lambda spark, sf_dir: report(fixture.frame(spark, sf_dir), *args, **kwargs)


def _in_order(query: Query, number: Callable[[DataFrame], DataFrame] = numbering.numbered) -> Query:
    """Adds each row's ``position`` in the order in which the query returns its rows."""

    def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return number(query(spark, sf_dir))

    return ranked


def _on_stored(report: Callable, *args, **kwargs) -> Query:
    """A query that stores the tickets, reads the range back and runs a report on it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch_path(spark, "tickets")
        tickets.write_tickets(fx.TICKETS.frame(spark, sf_dir), path)
        return report(tickets.read_tickets(spark, path, d_from=args[0], d_to=args[1]), *args, **kwargs)

    return query


def _stored_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_stored(lambda stored, *_: stored.select(*TICKETS.fieldNames()), *STANDARD)(spark, sf_dir)


def _valid(spark, sf_dir):
    valid, _ = batches.parse_tickets(fx.TICKET_LINES.frame(spark, sf_dir))
    return valid


def _rejected(spark, sf_dir):
    _, rejected = batches.parse_tickets(fx.TICKET_LINES.frame(spark, sf_dir))
    return rejected.select("batch_id", "pos", "error")


def _inserted(spark, sf_dir):
    return ingest.insert_if_absent(_valid(spark, sf_dir), fx.STORED_KEYS.frame(spark, sf_dir))


def _tagged(spark, sf_dir):
    rows = staged(batches.parse_ticket_rows(fx.TICKET_LINES.frame(spark, sf_dir)), scratch_path(spark, "staging"))
    return ingest.tag_rows(rows, fx.STORED_KEYS.frame(spark, sf_dir))


def _documents(limit):
    def query(spark, sf_dir):
        docs = documents.export_documents(fx.TICKETS.frame(spark, sf_dir), SINCE, limit)
        return docs.select("id", "text", ft.json_text(F.col("metadata")).alias("metadata"))

    return query


def _recent_documents(spark, sf_dir):
    docs = documents.export_documents(fx.TICKETS.frame(spark, sf_dir), days=30, now=datetime(2024, 2, 20, 6, 0))
    return docs.select("id", "text", ft.json_text(F.col("metadata")).alias("metadata"))


def _run_sql(spark, sf_dir):
    text = (
        "SELECT category, count(*) AS tickets, max(closed_at) AS last_closed FROM ticketmill_tickets "
        "WHERE closed_at >= CAST(:since AS TIMESTAMP_NTZ) AND source = :source GROUP BY category"
    )
    views = {"ticketmill_tickets": fx.TICKETS.frame(spark, sf_dir)}
    return sql.run_sql(spark, text, {"since": "2024-01-10 00:00:00", "source": "Email"}, views)


def _expanded_days(spark, sf_dir):
    days = expansion.day_expansion(filters.closed_between(fx.TICKETS.frame(spark, sf_dir), *ALL))
    return days.select("hubspot_ticket_id", F.col("open_day").cast("string").alias("open_day"), "dow", "work_seconds")


def _business_seconds(fixture, days):
    def query(spark, sf_dir):
        timed = resolution.business_time(fixture.frame(spark, sf_dir), *days)
        return timed.select("hubspot_ticket_id", "business_seconds")

    return query


def _expanded_seconds(spark, sf_dir):
    """Business seconds the long way, by one row per open day."""
    days = expansion.day_expansion(filters.closed_between(fx.TICKETS.frame(spark, sf_dir), *ALL))
    return days.groupBy("hubspot_ticket_id").agg(F.sum("work_seconds").alias("business_seconds"))


def _closed_monthly(fixture, days):
    def query(spark, sf_dir):
        report = volume.closed_monthly(fixture.frame(spark, sf_dir), *days)
        return report.select(F.col("month").cast("string").alias("month"), "date", "count")

    return query


def _returned_total(spark, sf_dir):
    return counts.returned_total(counts.top_categories(fx.TICKETS.frame(spark, sf_dir), *STANDARD, top=3))


def _normalized_emails(spark, sf_dir):
    email = fa.normalize_email(F.col("email"))
    return fx.REQUESTS.frame(spark, sf_dir).select(
        "request_id",
        email.alias("email"),
        fa.is_email(F.col("email")).alias("is_email"),
        fa.email_in_domain(email, DOMAIN).alias("in_domain"),
    )


def _masked_emails(spark, sf_dir):
    masked = ft.mask_email(fa.normalize_email(F.col("email")))
    return fx.REQUESTS.frame(spark, sf_dir).select("request_id", masked.alias("masked"))


def _groups(spark, sf_dir):
    provider = fx.PROVIDER.frame(spark, sf_dir)
    return provider.select(
        "email", "username", F.coalesce(F.split("grps", ","), F.array().cast("array<string>")).alias("groups")
    )


def _effective_role(spark, sf_dir):
    return _groups(spark, sf_dir).select(
        "username",
        fa.effective_role(F.col("groups")).alias("role"),
        fa.groups_text(F.col("groups")).alias("groups_text"),
    )


def _role_drift(spark, sf_dir):
    drift = access.role_drift(fx.USERS.frame(spark, sf_dir), _groups(spark, sf_dir))
    return drift.withColumn("groups", F.array_join("groups", ","))


def _sync_plan(spark, sf_dir, change: bool):
    requests = fx.ROLE_REQUESTS.frame(spark, sf_dir) if change else None
    return access.plan_role_sync(fx.USERS.frame(spark, sf_dir), _groups(spark, sf_dir), requests)


def _role_sync(change: bool) -> Query:
    def query(spark, sf_dir):
        plan = _sync_plan(spark, sf_dir, change)
        return plan.withColumns({c: F.array_join(c, ",") for c in ("groups_before", "groups_after")})

    return query


def _audit_rows(spark, sf_dir):
    rows = access.audit_rows(_sync_plan(spark, sf_dir, change=True), "root@corp.example")
    return rows.drop("ip").withColumn("groups", F.array_join("groups", ","))


def _with_users(report: Callable, **kwargs) -> Query:
    return lambda spark, sf_dir: report(fx.REQUESTS.frame(spark, sf_dir), fx.USERS.frame(spark, sf_dir), **kwargs)


def _replay(report: Callable, with_start: bool) -> Query:
    def query(spark, sf_dir):
        start = fx.USERS.frame(spark, sf_dir) if with_start else None
        return report(fx.ROSTER_LOG.frame(spark, sf_dir), start, DOMAIN)

    return query


def _streamed_in(spark, sf_dir) -> str:
    """The batches as files, one streaming run per batch, in batch order."""
    base = scratch_path(spark, "stream-ingest")
    lines = fx.TICKET_LINES.frame(spark, sf_dir)
    for batch in range(4):
        lines.where(F.col("batch_id") == batch).select("pos", "line").write.mode("append").json(f"{base}/landing")
        arriving = stream_ingest.read_line_stream(spark, f"{base}/landing")
        stream_ingest.stream_ingest(arriving, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return f"{base}/store"


def _stream_ingest(spark, sf_dir):
    stored = spark.read.schema(ingest.STORED).parquet(f"{_streamed_in(spark, sf_dir)}/tickets")
    return stored.select(*TICKETS.fieldNames(), "pos", F.col("ingest_id").alias("batch_id"))


def _stream_ingest_counts(spark, sf_dir):
    counts = ingest.ingest_counts(spark, _streamed_in(spark, sf_dir))
    return counts.withColumnRenamed("ingest_id", "batch_id")


def _ingested(report: Callable, *args) -> Query:
    """A query that ingests all lines as one batch and runs a report on the table."""

    def query(spark, sf_dir):
        base = scratch_path(spark, "ingest")
        ingest.ingest_lines(fx.TICKET_LINES.frame(spark, sf_dir).select("pos", "line"), base, 0)
        return report(ingest.read_ingested(spark, base, d_from=args[0], d_to=args[1]), *args)

    return query


def _ingested_partials(report: Callable, *args) -> Query:
    """A query that ingests all lines as one batch and runs a report on the partials that it wrote."""

    def query(spark, sf_dir):
        base = scratch_path(spark, "ingest")
        ingest.ingest_lines(fx.TICKET_LINES.frame(spark, sf_dir).select("pos", "line"), base, 0)
        return report(ingest.read_ingested_partials(spark, base), *args)

    return query


def _on_partials(fixture: fx.Fixture, report: Callable, *args, **kwargs) -> Query:
    """A query that stores the partials of the tickets in three parts and runs a report on them."""

    def query(spark, sf_dir):
        path = scratch_path(spark, "partials")
        given = fixture.frame(spark, sf_dir)
        for part in range(3):
            stored_partials.write_partials(given.where(F.pmod(F.xxhash64("hubspot_ticket_id"), F.lit(3)) == part), path, part)
        return report(stored_partials.read_partials(spark, path), *args, **kwargs)

    return query


def _partial_monthly(spark, sf_dir):
    report = _on_partials(fx.TICKETS, partials.closed_monthly, *MONTHS)(spark, sf_dir)
    return report.select(F.col("month").cast("string").alias("month"), "date", "count")


def _ingests_after_merges(spark, sf_dir):
    """Four ingests whose key files are merged two by two in between."""
    base = scratch_path(spark, "ingest")
    lines = fx.TICKET_LINES.frame(spark, sf_dir)
    for batch in range(4):
        ingest.ingest_lines(lines.where(F.col("batch_id") == batch), base, batch, fan=2)
        ingest.merge_keys(spark, base, fan=2)
    return ingest.read_ingested(spark, base).select(*TICKETS.fieldNames(), F.col("ingest_id").alias("batch_id"))


def _finished_ingests(spark, sf_dir):
    """Three batches ingested, and a fourth that stopped after its tickets: the table shows the three."""
    base = scratch_path(spark, "ingest")
    lines = fx.TICKET_LINES.frame(spark, sf_dir)
    for batch in range(3):
        ingest.ingest_lines(lines.where(F.col("batch_id") == batch), base, batch)
    ingest.begin_ingest(spark, base, 3)
    valid, _ = batches.parse_tickets(lines.where("batch_id = 3").select("pos", "line"))
    ingest.store_new_tickets(valid, base, 3)
    return ingest.read_ingested(spark, base).select(*TICKETS.fieldNames(), F.col("ingest_id").alias("batch_id"))


def _stream_ingest_within(spark, sf_dir):
    """The batches as files, one streaming run per batch, with the ids of a day in state."""
    base = scratch_path(spark, "stream-within")
    lines = fx.TICKET_LINES.frame(spark, sf_dir)
    for batch in range(4):
        lines.where(F.col("batch_id") == batch).select("pos", "line").write.mode("append").json(f"{base}/landing")
        arriving = stream_ingest.read_line_stream(spark, f"{base}/landing")
        run = stream_ingest.stream_ingest_within(arriving, f"{base}/store", f"{base}/checkpoint", timedelta(days=1))
        run.awaitTermination()
    stored = spark.read.schema(ingest.STORED).parquet(f"{base}/store/tickets")
    return ingest.finished(stored, f"{base}/store").select(*TICKETS.fieldNames(), "pos")


def _stream_rejects(spark, sf_dir):
    base = scratch_path(spark, "stream-rejects")
    fx.TICKET_LINES.frame(spark, sf_dir).select("pos", "line").write.json(f"{base}/landing")
    arriving = stream_ingest.read_line_stream(spark, f"{base}/landing")
    stream_ingest.stream_rejects(arriving, f"{base}/rejects", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rejects").select("pos", "error")


def _audit_log(spark, sf_dir):
    """Two plans recorded, the first of them twice."""
    path = scratch_path(spark, "audit")
    for plan_id, change in (("plan-1", True), ("plan-2", False), ("plan-1", True)):
        access.write_audit(access.audit_rows(_sync_plan(spark, sf_dir, change), "root@corp.example"), path, plan_id)
    return access.read_audit(spark, path).drop("ip").withColumn("groups", F.array_join("groups", ","))


def _exported_lines(spark, sf_dir):
    """All documents written as NDJSON files, and their lines read back in file order."""
    path = scratch_path(spark, "documents")
    documents.write_documents(documents.export_documents(fx.TICKETS.frame(spark, sf_dir), SINCE), path)
    return documents.read_document_lines(spark, path)


def _stream_closed_windows(spark, sf_dir):
    """The tickets in three runs: closed by mid-January, after, and a part of all that comes too late for most days."""
    base = scratch_path(spark, "stream-windows")
    part = F.when(F.col("hubspot_ticket_id").cast("bigint") % 97 == 0, 2).when(F.col("closed_at") < F.lit("2024-01-15").cast("timestamp_ntz"), 0).otherwise(1)
    closed = fx.TICKETS.frame(spark, sf_dir).select("closed_at", part.alias("part"))
    for run in range(3):
        closed.where(F.col("part") == run).select("closed_at").write.mode("append").parquet(f"{base}/tickets")
        arriving = spark.readStream.schema("closed_at TIMESTAMP_NTZ").parquet(f"{base}/tickets")
        stream_volume.stream_closed_windows(arriving, f"{base}/days", f"{base}/checkpoint", "2 days").awaitTermination()
    days = stream_volume.read_closed_windows(spark, f"{base}/days")
    return days.select(F.col("day").cast("string").alias("day"), "count")


def _status_plan(spark, sf_dir):
    return access.plan_status_change(
        fx.USERS.frame(spark, sf_dir), _groups(spark, sf_dir), fx.STATUS_REQUESTS.frame(spark, sf_dir)
    )


def _access_gate(spark, sf_dir):
    requests = fx.GATE_REQUESTS.frame(spark, sf_dir).withColumn("groups", F.split("grps", ",")).drop("grps")
    return access.access_gate(requests, fx.USERS.frame(spark, sf_dir), DOMAIN)


def _stream_closed_daily(spark, sf_dir):
    """The narrow tickets, written once, read back as a stream of files."""
    base = scratch_path(spark, "stream-volume")
    fx.TICKETS.frame(spark, sf_dir).select("hubspot_ticket_id", "closed_at").write.parquet(f"{base}/tickets")
    arriving = spark.readStream.schema("hubspot_ticket_id STRING, closed_at TIMESTAMP_NTZ").parquet(f"{base}/tickets")
    stream_volume.stream_closed_daily(arriving, f"{base}/daily", f"{base}/checkpoint").awaitTermination()
    days = stream_volume.read_closed_daily(spark, f"{base}/daily")
    return days.select(F.col("day").cast("string").alias("day"), "count")


QUERIES: dict[str, Query] = {
    # Sources, sinks, ingest
    "read_tickets": _stored_tickets,
    "parse_tickets": _valid,
    "parse_tickets_rejected": _rejected,
    "insert_if_absent": _inserted,
    "tag_rows": lambda spark, sf_dir: _tagged(spark, sf_dir).select("batch_id", "pos", "status", "error"),
    "ingest_report": lambda spark, sf_dir: ingest.ingest_report(_tagged(spark, sf_dir)),
    "export_documents": _documents(500),
    "export_all_documents": _documents(None),
    "export_recent_documents": _recent_documents,
    "exported_lines": _exported_lines,
    "run_sql": _run_sql,
    "list_roster": _on(fx.USERS, roster.list_roster),
    # Filters and scalar functions
    "closed_between": lambda spark, sf_dir: filters.closed_between(fx.TICKETS.frame(spark, sf_dir), *STANDARD).select(
        "hubspot_ticket_id", "closed_at"
    ),
    "closed_since": lambda spark, sf_dir: filters.closed_since(
        fx.TICKETS.frame(spark, sf_dir), datetime(2024, 1, 20, 13, 30)
    ).select("hubspot_ticket_id", "closed_at"),
    "normalize_email": _normalized_emails,
    "mask_email": _masked_emails,
    "preview_text": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        ft.preview_text(F.col("text"), 500).alias("answer"),
        ft.preview_text(F.col("text"), 300, "…", mark_at_length=True).alias("question"),
        ft.preview_text(F.col("text"), 100).alias("probe"),
    ),
    "iso_text": lambda spark, sf_dir: fx.TICKETS.frame(spark, sf_dir).select(
        "hubspot_ticket_id", ft.iso_text(F.col("closed_at")).alias("closed_at")
    ),
    "effective_role": _effective_role,
    "day_expansion": _expanded_days,
    "business_seconds": _business_seconds(fx.TICKETS, ALL),
    "business_seconds_by_days": _expanded_seconds,
    # Counts
    "total_tickets": _on(fx.TICKETS, counts.total_tickets),
    "category_counts": _on(fx.TICKETS, counts.category_counts),
    "category_counts_top": _on(fx.TICKETS, counts.category_counts, top=3),
    "top_categories": _on(fx.TICKETS, counts.top_categories, *STANDARD),
    "returned_total": _returned_total,
    "tickets_by_source": _on(fx.TICKETS, counts.tickets_by_source, *STANDARD),
    "top_agents": _on(fx.TICKETS, counts.top_agents, *STANDARD),
    "top_subcategories": _on(fx.TICKETS, counts.top_subcategories, *STANDARD),
    "top_subcategories_top": _on(fx.TICKETS, counts.top_subcategories, *STANDARD, top=7),
    # Volume
    "closed_total": _on(fx.TICKETS, volume.closed_total, *STANDARD),
    "closed_daily": _on(fx.TICKETS, volume.closed_daily, *DAYS),
    "closed_monthly": _closed_monthly(fx.TICKETS, MONTHS),
    "closed_volume_one_day": _on(fx.TICKETS, volume.closed_volume, *ONE_DAY),
    "closed_volume_daily": _on(fx.TICKETS, volume.closed_volume, *DAYS),
    "closed_volume_monthly": _on(fx.TICKETS, volume.closed_volume, *MONTHS),
    "closed_volume_by_day": _on(fx.TICKETS, volume.closed_volume, *MONTHS, grain="daily"),
    # Time to resolve
    "resolution_by_agent": _on(fx.TICKETS, resolution.resolution_by_agent, *STANDARD),
    "resolution_by_agent_top": _on(fx.TICKETS, resolution.resolution_by_agent, *STANDARD, top=5),
    "resolution_overall": _on(fx.TICKETS, resolution.resolution_overall, *STANDARD),
    "resolution_overall_empty": _on(fx.TICKETS, resolution.resolution_overall, "2030-01-01", "2030-01-02"),
    "resolution_by_source": _on(fx.TICKETS, resolution.resolution_by_source, *STANDARD),
    "resolution_by_source_desc": _on(fx.TICKETS, resolution.resolution_by_source, *STANDARD, order="desc"),
    "slow_cases": _on(fx.TICKETS, resolution.slow_cases, *STANDARD),
    # The same reports on the wide tickets
    "wide_business_seconds": _business_seconds(fx.WIDE_TICKETS, WIDE),
    "wide_resolution_by_agent": _on(fx.WIDE_TICKETS, resolution.resolution_by_agent, *WIDE),
    "wide_resolution_by_source": _on(fx.WIDE_TICKETS, resolution.resolution_by_source, *WIDE),
    "wide_resolution_overall": _on(fx.WIDE_TICKETS, resolution.resolution_overall, *WIDE),
    "wide_slow_cases": _on(fx.WIDE_TICKETS, resolution.slow_cases, *WIDE),
    "wide_top_agents": _on(fx.WIDE_TICKETS, counts.top_agents, *WIDE),
    "wide_tickets_by_source": _on(fx.WIDE_TICKETS, counts.tickets_by_source, *WIDE),
    "wide_top_subcategories": _on(fx.WIDE_TICKETS, counts.top_subcategories, *WIDE),
    "wide_closed_daily": _on(fx.WIDE_TICKETS, volume.closed_daily, *WIDE),
    "wide_closed_monthly": _closed_monthly(fx.WIDE_TICKETS, WIDE),
    # Chat
    "session_text": _on(fx.CHAT_CHUNKS, chat.session_text),
    "session_text_parts": _on(fx.CHAT_CHUNKS, chat.session_text, chunks_per_part=2),
    "tool_invocations": _on(fx.CHAT_TRACES, chat.tool_invocations),
    "session_summary": _on(fx.CHAT_TRACES, chat.session_summary, fx.CHAT_AGENTS, fx.CHAT_GROUP_AGENTS),
    "tool_usage": _on(fx.CHAT_TRACES, chat.tool_usage),
    # Roster and access
    "replay_roster": _replay(roster.replay_roster, with_start=False),
    "replay_roster_from_start": _replay(roster.replay_roster, with_start=True),
    "roster_rejects": _replay(roster.roster_rejects, with_start=False),
    "roster_rejects_from_start": _replay(roster.roster_rejects, with_start=True),
    "check_allowlist": _with_users(access.check_allowlist),
    "authorize": _with_users(access.authorize),
    "role_drift": _role_drift,
    "plan_role_sync": _role_sync(change=False),
    "plan_role_change": _role_sync(change=True),
    "audit_rows": _audit_rows,
    "audit_log": _audit_log,
    "plan_status_change": _status_plan,
    "access_gate": _access_gate,
    "invite_status": _on(fx.USERS, roster.invite_status, NOW),
    # Streaming
    "stream_ingest": _stream_ingest,
    "stream_ingest_counts": _stream_ingest_counts,
    "stream_ingest_within": _stream_ingest_within,
    "stream_rejects": _stream_rejects,
    "stream_closed_daily": _stream_closed_daily,
    "stream_closed_windows": _stream_closed_windows,
    # Reports on the table that an ingest has written, and on stored tickets
    "finished_ingests": _finished_ingests,
    "ingested_resolution_by_source": _ingested(resolution.resolution_by_source, *ALL),
    "ingested_closed_daily": _ingested(volume.closed_daily, *STANDARD),
    "ingested_partial_resolution": _ingested_partials(partials.resolution_by_source, *ALL),
    "ingests_after_merges": _ingests_after_merges,
    "stored_resolution_by_agent": _on_stored(resolution.resolution_by_agent, *STANDARD),
    "stored_top_categories": _on_stored(counts.top_categories, *STANDARD),
    # Reports from daily partials
    "partial_top_categories": _on_partials(fx.TICKETS, partials.top_categories, *STANDARD),
    "partial_tickets_by_source": _on_partials(fx.WIDE_TICKETS, partials.tickets_by_source, *WIDE),
    "partial_top_agents": _on_partials(fx.WIDE_TICKETS, partials.top_agents, *WIDE),
    "partial_top_subcategories": _on_partials(fx.TICKETS, partials.top_subcategories, *STANDARD),
    "partial_closed_total": _on_partials(fx.TICKETS, partials.closed_total, *STANDARD),
    "partial_closed_daily": _on_partials(fx.TICKETS, partials.closed_daily, *DAYS),
    "partial_closed_monthly": _partial_monthly,
    "partial_resolution_by_agent": _on_partials(fx.TICKETS, partials.resolution_by_agent, *STANDARD),
    "partial_resolution_by_source": _on_partials(fx.TICKETS, partials.resolution_by_source, *STANDARD, order="desc"),
    "partial_resolution_overall": _on_partials(fx.WIDE_TICKETS, partials.resolution_overall, *WIDE),
}

# Reports whose order is part of the result.
ORDERED = (
    "list_roster",
    "export_documents",
    "export_all_documents",
    "export_recent_documents",
    "exported_lines",
    "category_counts",
    "category_counts_top",
    "top_categories",
    "tickets_by_source",
    "top_agents",
    "top_subcategories",
    "top_subcategories_top",
    "closed_daily",
    "closed_monthly",
    "resolution_by_agent",
    "resolution_by_agent_top",
    "resolution_by_source",
    "resolution_by_source_desc",
    "slow_cases",
    "partial_top_categories",
    "partial_tickets_by_source",
    "partial_top_agents",
    "partial_top_subcategories",
    "partial_closed_daily",
    "partial_closed_monthly",
    "partial_resolution_by_agent",
    "partial_resolution_by_source",
)
# Those of them that end in a limit.
FIRST = ("export_documents", "top_categories", "top_agents", "resolution_by_agent_top", "slow_cases")
QUERIES |= {name: _in_order(QUERIES[name], numbering.numbered_first if name in FIRST else numbering.numbered) for name in ORDERED}
