"""DuckDB SQL for the registered queries, written independently of the library.

Business time is computed here the long way, by one row per open day, and the
roster by a recursive query that applies one command after another.
"""

from __future__ import annotations

from ticketmill.checks import fixtures as fx

STANDARD = ("2024-01-05", "2024-01-25")
DAYS = ("2024-01-25", "2024-03-04")
MONTHS = ("2023-11-01", "2024-03-31")
ONE_DAY = ("2024-01-10", "2024-01-10")
ALL = ("2023-01-01", "2025-12-31")
WIDE = ("1992-01-01", "1999-12-31")

MONTH_LIST = (
    "['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre','Octubre','Noviembre','Diciembre']"
)
SPACE = "(' ' || chr(9) || chr(10) || chr(13))"


def _with(query: str, recursive: bool = False, **ctes: str) -> str:
    parts = ", ".join(f"{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {query}"


def _in_range(days: tuple[str, str]) -> str:
    return f"closed_at >= TIMESTAMP '{days[0]}' AND closed_at < TIMESTAMP '{days[1]}' + INTERVAL 1 DAY"


def _label(fallback: str, *columns: str) -> str:
    tried = ", ".join(f"nullif(trim({c}, ' '), '')" for c in columns)
    return f"coalesce({tried}, '{fallback}')"


CATEGORY = _label("Sin categoría", "category")
SUBCATEGORY = _label("Sin subcategoría", "subcategory")
SOURCE = _label("Desconocido", "source")
AGENT = _label("Sin asignar", "owner_name", "owner_id")
AGENT_NAME = _label("Sin asignar", "owner_name")


def _tickets(query: str, fixture: fx.Fixture = fx.TICKETS, **more: str) -> str:
    return _with(query, t=fixture.sql(), **more)


def _counts(days, fixture=fx.TICKETS, limit="", **labels: str) -> str:
    items = ", ".join(f"{expr} AS {name}" for name, expr in labels.items())
    names = ", ".join(labels)
    numbers = ", ".join(str(i + 1) for i in range(len(labels)))
    body = f"SELECT {items}, count(*) AS count FROM t WHERE {_in_range(days)} GROUP BY {numbers}"
    return _tickets(f"SELECT * FROM c ORDER BY count DESC, {names} {limit}", fixture, c=body)


def _by_source(days, fixture=fx.TICKETS) -> str:
    body = f"SELECT {SOURCE} AS source, count(*) AS count FROM t WHERE {_in_range(days)} GROUP BY 1"
    query = (
        "SELECT source, count, CAST((2000 * count + total) // (2 * total) AS BIGINT) / 10.0 AS pct "
        "FROM (SELECT *, CAST(sum(count) OVER () AS BIGINT) AS total FROM c)"
    )
    return _tickets(query, fixture, c=body)


def _daily(days, fixture=fx.TICKETS) -> str:
    counted = f"SELECT CAST(closed_at AS DATE) AS d, count(*) AS n FROM t WHERE {_in_range(days)} GROUP BY 1"
    spine = f"SELECT CAST(unnest(generate_series(TIMESTAMP '{days[0]}', TIMESTAMP '{days[1]}', INTERVAL 1 DAY)) AS DATE) AS d"
    query = "SELECT CAST(s.d AS VARCHAR) AS date, coalesce(n, 0) AS count FROM s LEFT JOIN c ON s.d = c.d"
    return _tickets(query, fixture, c=counted, s=spine)


def _monthly(days, fixture=fx.TICKETS, month: bool = True) -> str:
    counted = f"SELECT CAST(date_trunc('month', closed_at) AS DATE) AS d, count(*) AS n FROM t WHERE {_in_range(days)} GROUP BY 1"
    spine = (
        f"SELECT CAST(unnest(generate_series(date_trunc('month', TIMESTAMP '{days[0]}'), TIMESTAMP '{days[1]}', "
        "INTERVAL 1 MONTH)) AS DATE) AS d"
    )
    first = "CAST(s.d AS VARCHAR) AS month, " if month else ""
    query = (
        f"SELECT {first}{MONTH_LIST}[month(s.d)] || ' ' || CAST(year(s.d) AS VARCHAR) AS date, "
        "coalesce(n, 0) AS count FROM s LEFT JOIN c ON s.d = c.d"
    )
    return _tickets(query, fixture, c=counted, s=spine)


def _total(days) -> str:
    return _tickets(f"SELECT count(*) AS total_closed FROM t WHERE {_in_range(days)}")


def _timed(query: str, days, fixture=fx.TICKETS) -> str:
    """CTEs ``open_days`` (one row per open day) and ``timed`` (one row per ticket)."""
    expanded = (
        "SELECT *, CAST(unnest(generate_series(date_trunc('day', created_at)::TIMESTAMP, "
        f"date_trunc('day', closed_at)::TIMESTAMP, INTERVAL 1 DAY)) AS TIMESTAMP) AS d FROM t WHERE {_in_range(days)}"
    )
    windows = "SELECT *, greatest(d + INTERVAL 7 HOUR, created_at) AS lo, least(d + INTERVAL 17 HOUR, closed_at) AS hi FROM e"
    open_days = (
        "SELECT *, dayofweek(d) AS dow, CASE WHEN dayofweek(d) NOT IN (0, 6) AND hi > lo "
        "THEN (epoch_us(hi) - epoch_us(lo) + 500000) // 1000000 ELSE 0 END AS work_seconds FROM w"
    )
    timed = "SELECT hubspot_ticket_id, CAST(sum(work_seconds) AS BIGINT) AS seconds FROM open_days GROUP BY 1"
    return _tickets(query, fixture, e=expanded, w=windows, open_days=open_days, timed=timed)


def _mean(seconds: str, n: str) -> str:
    return f"CAST((2 * {seconds} + 36 * {n}) // (72 * {n}) AS BIGINT) / 100.0"


def _seconds(days, fixture=fx.TICKETS) -> str:
    return _timed("SELECT hubspot_ticket_id, seconds AS business_seconds FROM timed", days, fixture)


def _mean_by(label: str, name: str, n: str, days, fixture=fx.TICKETS, limit: str = "") -> str:
    mean = _mean("CAST(sum(seconds) AS BIGINT)", "count(*)")
    query = (
        f"SELECT {label} AS {name}, count(*) AS {n}, {mean} AS avg_hours_business "
        f"FROM timed JOIN t USING (hubspot_ticket_id) GROUP BY 1 {limit}"
    )
    return _timed(query, days, fixture)


def _overall(days, fixture=fx.TICKETS) -> str:
    mean = _mean("CAST(sum(seconds) AS BIGINT)", "nullif(count(*), 0)")
    return _timed(f"SELECT coalesce({mean}, 0.0) AS avg_hours_business, count(*) AS total_closed FROM timed", days, fixture)


def _slow(days, fixture=fx.TICKETS) -> str:
    query = (
        f"SELECT hubspot_ticket_id, subject, {AGENT_NAME} AS owner_name, {SOURCE} AS source, created_at, closed_at, "
        f"{_mean('seconds', '1')} AS hours_business_resolution, hubspot_ticket_id AS label "
        "FROM timed JOIN t USING (hubspot_ticket_id) "
        "ORDER BY hours_business_resolution DESC, closed_at DESC, hubspot_ticket_id LIMIT 10"
    )
    return _timed(query, days, fixture)


def _iso(c: str) -> str:
    return (
        f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({c}, '.%f') END || '+00:00'"
    )


def _document_parts() -> tuple[str, str]:
    """Expressions of a document's text and of its metadata as JSON."""
    text = (
        "'[Asunto]' || chr(10) || coalesce(subject, '') || chr(10) || chr(10) || '[Descripción]' || chr(10) || "
        "coalesce(content, '') || chr(10) || chr(10) || '[Resolución]' || chr(10) || coalesce(resolution, '')"
    )
    metadata = (
        f"CAST(json_object('created_at', {_iso('created_at')}, 'closed_at', {_iso('closed_at')}, 'source', source, "
        "'category', category, 'subcategory', subcategory, 'itinerary_number', itinerary_number, 'case_key', case_key, "
        "'owner_id', owner_id, 'owner_name', owner_name) AS VARCHAR)"
    )
    return text, metadata


def _documents(since: str, limit: str) -> str:
    text, metadata = _document_parts()
    return _tickets(
        f"SELECT hubspot_ticket_id AS id, {text} AS text, {metadata} AS metadata, "
        "row_number() OVER (ORDER BY closed_at DESC, hubspot_ticket_id) AS position FROM t "
        f"WHERE closed_at >= TIMESTAMP '{since}' ORDER BY position {limit}"
    )


def _document_lines(since: str) -> str:
    """The NDJSON lines of all documents, numbered in file order."""
    text, metadata = _document_parts()
    line = f"""'{{"id":' || CAST(to_json(hubspot_ticket_id) AS VARCHAR) || ',"text":' || CAST(to_json({text}) AS VARCHAR) || ',"metadata":' || {metadata} || '}}'"""
    order = "row_number() OVER (ORDER BY closed_at DESC, hubspot_ticket_id) AS position"
    return _tickets(f"SELECT {line} AS line, {order} FROM t WHERE closed_at >= TIMESTAMP '{since}'")


TICKET_COLUMNS = (
    "hubspot_ticket_id, subject, content, created_at, closed_at, itinerary_number, source, category, subcategory, "
    "resolution, owner_id, owner_name, case_key, raw_hubspot"
)


def _parsed(query: str) -> str:
    """CTE ``p``: all batch rows with the ticket columns and ``error``."""

    def time(c: str) -> str:
        return (
            f"CASE WHEN {c} LIKE '%+02:00' THEN TRY_CAST(left({c}, 19) AS TIMESTAMP) - INTERVAL 2 HOUR "
            f"ELSE TRY_CAST(replace({c}, 'Z', '') AS TIMESTAMP) END"
        )

    def text(key: str, default: str | None = None) -> str:
        value = f"doc->>'$.{key}'"
        if default is None:
            return f"{value} AS {key}"
        return f"CASE WHEN json_type(doc, '$.{key}') IS NULL THEN '{default}' ELSE {value} END AS {key}"

    docs = "SELECT batch_id, pos, TRY_CAST(line AS JSON) AS doc FROM lines"
    fields = ", ".join(
        [
            "batch_id, pos, doc",
            "json_type(doc, '$.hubspot_ticket_id') AS id_type",
            *[text(c) for c in ("hubspot_ticket_id", "subject", "content")],
            "doc->>'$.created_at' AS created_text",
            "doc->>'$.closed_at' AS closed_text",
            text("itinerary_number", "N/A"),
            text("source", "Email"),
            text("category", "Consulta General"),
            text("subcategory", "Consulta"),
            *[text(c) for c in ("resolution", "owner_id", "owner_name", "case_key")],
            "coalesce(CAST(doc->'$.raw_hubspot' AS VARCHAR), '{}') AS raw_hubspot",
        ]
    )
    timed = f"SELECT *, {time('created_text')} AS created_at, {time('closed_text')} AS closed_at FROM f"
    bad_time = "hubspot_ticket_id || ': invalid input syntax for type timestamp with time zone: \"' || {0} || '\"'"
    error = (
        "CASE WHEN doc IS NULL THEN 'Ticket ' || pos || ': línea JSON inválida' "
        "WHEN json_type(doc) <> 'OBJECT' THEN 'Ticket ' || pos || ': se esperaba un objeto JSON' "
        "WHEN hubspot_ticket_id IS NULL OR hubspot_ticket_id = '' OR (id_type <> 'VARCHAR' AND hubspot_ticket_id = '0') "
        "THEN 'Ticket ' || pos || ': hubspot_ticket_id es requerido' "
        f"WHEN created_text IS NOT NULL AND created_at IS NULL THEN 'Ticket ' || {bad_time.format('created_text')} "
        f"WHEN closed_text IS NOT NULL AND closed_at IS NULL THEN 'Ticket ' || {bad_time.format('closed_text')} END"
    )
    return _with(
        query,
        lines=fx.TICKET_LINES.sql(),
        j=docs,
        f=f"SELECT {fields} FROM j",
        g=timed,
        p=f"SELECT *, {error} AS error FROM g",
        stored=fx.STORED_KEYS.sql(),
        ranked=(
            "SELECT *, row_number() OVER (PARTITION BY hubspot_ticket_id ORDER BY batch_id, pos) AS r "
            "FROM p WHERE error IS NULL"
        ),
        tagged=(
            "SELECT p.batch_id, p.pos, p.error, CASE WHEN p.error IS NOT NULL THEN 'skipped' WHEN r = 1 AND "
            "p.hubspot_ticket_id NOT IN (SELECT hubspot_ticket_id FROM stored) THEN 'inserted' ELSE 'duplicate' END AS status "
            "FROM p LEFT JOIN ranked ON p.pos = ranked.pos"
        ),
    )


def _ingested(report: str) -> str:
    """A report on the tickets of all lines, ingested as one batch; ``t`` stands for them."""
    head, tickets, tail = report.partition(fx.TICKETS.sql())
    assert head == "WITH t AS (" and tickets
    first = (
        "SELECT * FROM p WHERE error IS NULL "
        "QUALIFY row_number() OVER (PARTITION BY hubspot_ticket_id ORDER BY pos) = 1"
    )
    return _parsed("SELECT * FROM t").removesuffix(" SELECT * FROM t") + f", t AS ({first}" + tail


def _trace_fields(query: str) -> str:
    """CTE ``f``: traces with the four tool fields."""

    def first(name: str, *keys: str) -> str:
        return "coalesce(" + ", ".join(f"nullif(doc->>'$.{k}', '')" for k in keys) + f") AS {name}"

    fields = ", ".join(
        [
            first("action_group", "actionGroup", "action_group", "toolName", "name"),
            first("api_path", "apiPath", "path", "endpoint"),
            first("http_method", "httpMethod", "method"),
            first("status", "httpStatusCode", "statusCode", "status"),
        ]
    )
    return _with(
        query,
        x=fx.CHAT_TRACES.sql(),
        j="SELECT session_id, seq, CAST(payload AS JSON) AS doc FROM x WHERE kind = 'trace'",
        f=f"SELECT session_id, seq, doc, {fields} FROM j",
    )


_USED = "(action_group IS NOT NULL OR api_path IS NOT NULL OR http_method IS NOT NULL OR status IS NOT NULL)"
_SUMMARY = (
    "SELECT session_id, coalesce(l.label, CASE WHEN bool_or(f.action_group = 'Analytics') THEN 'MetricsAgent' END) AS routed_agent, "
    "arg_min(f.action_group, f.seq) FILTER (f.action_group IS NOT NULL) AS last_action_group, "
    "arg_max(f.api_path, f.seq) FILTER (f.api_path IS NOT NULL) AS last_api_path, "
    "count(*) FILTER (f.doc->>'$.routeId' IS NOT NULL OR f.doc->>'$.orchestration' IS NOT NULL) AS notes, "
    f"count(*) FILTER {_USED} AS invocations "
    "FROM (SELECT DISTINCT session_id FROM x) s LEFT JOIN f USING (session_id) LEFT JOIN "
    "(SELECT session_id, arg_max(doc->>'$.agent', seq) AS label FROM f WHERE doc->>'$.agent' IN "
    "('MetricsAgent', 'TransactionAgent', 'KnowledgeAgent') GROUP BY 1) l USING (session_id) GROUP BY session_id, l.label"
)


def _session_parts(size: int) -> str:
    """Parts of ``size`` chunks, counted from the first of a session, without those before and after its text."""
    numbered = f"SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // {size} AS part FROM x WHERE kind = 'chunk'"
    parts = "SELECT session_id, part, string_agg(payload, '' ORDER BY seq) AS piece FROM n GROUP BY 1, 2"
    ends = (
        f"SELECT *, min(part) FILTER (trim(piece, {SPACE}) <> '') OVER s AS a, max(part) FILTER (trim(piece, {SPACE}) <> '') OVER s AS z "
        "FROM k WINDOW s AS (PARTITION BY session_id)"
    )
    query = (
        f"SELECT session_id, part, CASE WHEN a IS NULL OR a = z THEN trim(piece, {SPACE}) WHEN part = a THEN ltrim(piece, {SPACE}) "
        f"WHEN part = z THEN rtrim(piece, {SPACE}) ELSE piece END AS text FROM e "
        "WHERE CASE WHEN a IS NULL THEN part = 0 ELSE part BETWEEN a AND z END"
    )
    return _with(query, x=fx.CHAT_CHUNKS.sql(), n=numbered, k=parts, e=ends)


def _roster(query: str, with_start: bool) -> str:
    """CTE ``st``: the state of every user after each of their commands."""
    log = (
        "SELECT lower(trim(email)) AS email, seq, cmd, role, status, "
        "CASE WHEN cmd = 'accept' THEN trim(token) ELSE token END AS token, cmd_at, actor, "
        "row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY seq) AS rn FROM r WHERE contains(email, '@')"
    )
    everyone = "SELECT DISTINCT email FROM log" + (" UNION SELECT email FROM u" if with_start else "")
    start = "SELECT * FROM u" if with_start else "SELECT * FROM u WHERE FALSE"
    reason = (
        "CASE WHEN l.cmd IN ('invite', 'set_role') AND l.role NOT IN ('Agent', 'Supervisor') THEN 'invalid_role' "
        "WHEN l.cmd = 'invite' AND NOT ends_with(l.email, '@corp.example') THEN 'domain_not_allowed' "
        "WHEN l.cmd = 'set_status' AND l.status NOT IN ('pending', 'active', 'revoked') THEN 'invalid_status' "
        "WHEN l.cmd = 'accept' AND l.token = '' THEN 'empty_token' "
        "WHEN l.cmd NOT IN ('invite', 'accept', 'set_status', 'set_role') THEN 'unknown_command' "
        "WHEN l.cmd IN ('set_status', 'set_role') AND s.status IS NULL THEN 'unknown_user' "
        "WHEN l.cmd = 'accept' AND (s.token IS NULL OR s.token <> l.token) THEN 'invalid_token' "
        "WHEN l.cmd = 'accept' AND s.token_expires_at < l.cmd_at THEN 'token_expired' END"
    )
    step = f"SELECT s.*, l.rn AS n_rn, l.seq AS n_seq, l.cmd AS n_cmd, l.role AS n_role, l.status AS n_status, l.token AS n_token, l.cmd_at AS n_at, l.actor AS n_actor, {reason} AS why FROM st s JOIN log l ON l.email = s.email AND l.rn = s.rn + 1"
    ok = "why IS NULL AND n_cmd"
    clears = f"({ok} = 'accept') OR ({ok} = 'set_status' AND n_status = 'revoked')"
    states = (
        "SELECT e.email, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS cmd, "
        "CAST(NULL AS VARCHAR) AS reason, i.role, i.status, i.invited_by, i.token, i.token_expires_at, i.created_at, "
        "i.updated_at FROM everyone e LEFT JOIN initial i ON e.email = i.email UNION ALL "
        "SELECT email, n_rn, n_seq, n_cmd, why, "
        f"CASE WHEN {ok} IN ('invite', 'set_role') THEN n_role ELSE role END, "
        f"CASE WHEN {ok} = 'accept' THEN 'active' WHEN {ok} = 'set_status' THEN n_status "
        f"WHEN {ok} = 'invite' AND (status IS NULL OR status = 'revoked') THEN 'pending' ELSE status END, "
        f"CASE WHEN {ok} = 'invite' THEN n_actor ELSE invited_by END, "
        f"CASE WHEN {ok} = 'invite' THEN n_token WHEN {clears} THEN NULL ELSE token END, "
        f"CASE WHEN {ok} = 'invite' THEN n_at + INTERVAL 7 DAY WHEN {clears} THEN NULL ELSE token_expires_at END, "
        f"CASE WHEN {ok} = 'invite' AND status IS NULL THEN n_at ELSE created_at END, "
        f"CASE WHEN why IS NOT NULL OR ({ok} = 'set_role' AND role = n_role) THEN updated_at ELSE n_at END "
        f"FROM ({step})"
    )
    return _with(
        query, True, r=fx.ROSTER_LOG.sql(), u=fx.USERS.sql(), log=log, everyone=everyone, initial=start, st=states
    )


_LAST_STATE = (
    "SELECT email, role, status, invited_by, token, token_expires_at, created_at, updated_at FROM st "
    "WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY email ORDER BY rn DESC) = 1"
)
_REJECTS = (
    "SELECT email, seq, cmd, reason FROM st WHERE reason IS NOT NULL UNION ALL "
    "SELECT lower(trim(email)), seq, cmd, 'invalid_email' FROM r WHERE NOT coalesce(contains(email, '@'), FALSE)"
)


def _access(query: str) -> str:
    provider = (
        "SELECT lower(email) AS email, username, coalesce(string_split(grps, ','), CAST([] AS VARCHAR[])) AS groups, "
        "count(*) OVER (PARTITION BY lower(email)) AS accounts FROM raw_provider "
        "QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY username) = 1"
    )
    return _with(
        query,
        u=fx.USERS.sql(),
        raw_provider=fx.PROVIDER.sql(),
        g=provider,
        q="SELECT request_id, email AS raw_email, lower(trim(email)) AS email, required_role FROM (" + fx.REQUESTS.sql() + ")",
    )


_DRIFT = (
    "SELECT coalesce(u.email, g.email) AS email, u.role AS db_role, u.status AS db_status, g.username, "
    "coalesce(array_to_string(g.groups, ','), '') AS groups, coalesce(accounts, 0) AS accounts, "
    "u.email IS NOT NULL AND (coalesce(list_contains(g.groups, u.role), FALSE) OR g.username IS NULL) AS in_sync "
    "FROM u FULL OUTER JOIN g ON u.email = g.email"
)


def _plan(query: str, change: bool) -> str:
    """CTE ``plan``: planned role and group changes, groups as comma-separated text."""
    if change:
        wanted = (
            "SELECT w.email, target, u.role AS db_from, u.email IS NOT NULL AS known FROM "
            "(SELECT lower(email) AS email, target_role AS target FROM w0 QUALIFY "
            "row_number() OVER (PARTITION BY lower(email) ORDER BY seq DESC) = 1) w LEFT JOIN u ON w.email = u.email"
        )
    else:
        wanted = "SELECT email, CAST(NULL AS VARCHAR) AS target, role AS db_from, TRUE AS known FROM u"
    joined = (
        "SELECT *, CASE WHEN db_to = 'Agent' THEN 'Supervisor' ELSE 'Agent' END AS other FROM ("
        "SELECT w.*, coalesce(target NOT IN ('Agent', 'Supervisor'), FALSE) AS refused, "
        "CASE WHEN refused THEN db_from ELSE coalesce(target, db_from) END AS db_to, "
        "CASE WHEN target IS NULL THEN 'repair' ELSE 'change' END AS verb, "
        "known AND g.username IS NOT NULL AS linked, g.username, g.groups FROM wanted w LEFT JOIN g ON w.email = g.email)"
    )
    marked = (
        "SELECT *, NOT refused AND known AND target IS NOT NULL AND target IS DISTINCT FROM db_from AS db_changed, "
        "NOT refused AND linked AND (NOT list_contains(groups, db_to) OR list_contains(groups, other)) AS groups_changed, "
        "CASE WHEN linked AND refused THEN groups WHEN linked THEN list_concat(list_filter(groups, lambda x: x <> other), "
        "CASE WHEN list_contains(groups, db_to) THEN CAST([] AS VARCHAR[]) ELSE [db_to] END) "
        "ELSE CAST([] AS VARCHAR[]) END AS after FROM joined"
    )
    plan = (
        "SELECT email, verb || CASE WHEN NOT known THEN ':db-miss' WHEN NOT linked THEN ':cognito-miss' ELSE '' END AS action, "
        "db_from, db_to, CASE WHEN linked THEN username END AS username, "
        "CASE WHEN linked THEN array_to_string(groups, ',') ELSE '' END AS groups_before, "
        "array_to_string(after, ',') AS groups_after, db_changed, groups_changed, groups_changed AS tokens_revoked, "
        "CASE WHEN refused THEN 'invalid_role' WHEN NOT known THEN 'user_not_in_DB' WHEN NOT linked AND verb = 'repair' THEN 'cognito_user_not_found' "
        "WHEN NOT linked AND db_changed THEN 'cognito_user_not_found; DB updated' "
        "WHEN linked AND (db_changed OR groups_changed) THEN 'ok' ELSE 'noop' END AS status, after FROM marked"
    )
    inner = _access("")
    return f"{inner}, w0 AS ({fx.ROLE_REQUESTS.sql()}), wanted AS ({wanted}), joined AS ({joined}), marked AS ({marked}), plan AS ({plan}) {query}"


_AUDIT = (
    "SELECT email, 'admin:roles' AS provider_sub, groups_after AS groups, 'allowed' AS result, "
    "CAST(json_object('action', action, 'db_from', db_from, 'db_to', db_to, 'cognito_username', username, "
    "'cognito_after', after, 'tokens_revoked', tokens_revoked, 'status', status) AS VARCHAR) AS reason, "
    "'admin:root@corp.example' AS user_agent FROM plan"
)


ORACLES: dict[str, str] = {
    "read_tickets": _tickets(f"SELECT {TICKET_COLUMNS} FROM t WHERE {_in_range(STANDARD)}"),
    "parse_tickets": _parsed(f"SELECT batch_id, pos, {TICKET_COLUMNS} FROM p WHERE error IS NULL"),
    "parse_tickets_rejected": _parsed("SELECT batch_id, pos, error FROM p WHERE error IS NOT NULL"),
    "insert_if_absent": _parsed(
        f"SELECT batch_id, pos, {TICKET_COLUMNS} FROM ranked WHERE r = 1 "
        "AND hubspot_ticket_id NOT IN (SELECT hubspot_ticket_id FROM stored)"
    ),
    "tag_rows": _parsed("SELECT batch_id, pos, status, error FROM tagged"),
    "ingest_report": _parsed(
        "SELECT count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'skipped') AS skipped, "
        "count(*) FILTER (status = 'duplicate') AS duplicate, count(*) AS total_processed FROM tagged"
    ),
    "export_documents": _documents("2024-01-20 00:00:00", "LIMIT 500"),
    "export_all_documents": _documents("2024-01-20 00:00:00", ""),
    "export_recent_documents": _documents("2024-01-21 06:00:00", ""),
    "exported_lines": _document_lines("2024-01-20 00:00:00"),
    "run_sql": _tickets(
        "SELECT category, count(*) AS tickets, max(closed_at) AS last_closed FROM t "
        "WHERE closed_at >= TIMESTAMP '2024-01-10' AND source = 'Email' GROUP BY category"
    ),
    "list_roster": _access("SELECT email, role, status, invited_by, token_expires_at, created_at, updated_at FROM u"),
    "closed_between": _tickets(f"SELECT hubspot_ticket_id, closed_at FROM t WHERE {_in_range(STANDARD)}"),
    "closed_since": _tickets("SELECT hubspot_ticket_id, closed_at FROM t WHERE closed_at >= TIMESTAMP '2024-01-20 13:30:00'"),
    "normalize_email": _access(
        "SELECT request_id, email, coalesce(contains(email, '@'), FALSE) AS is_email, "
        "coalesce(ends_with(email, '@corp.example'), FALSE) AS in_domain FROM q"
    ),
    "mask_email": _access(
        "SELECT request_id, CASE WHEN contains(email, '@') THEN left(split_part(email, '@', 1), 2) || '…@' || "
        "split_part(email, '@', 2) ELSE left(email, 2) || '…' END AS masked FROM q"
    ),
    "preview_text": (
        "SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS answer, "
        "CASE WHEN length(text) < 300 THEN text ELSE substring(text, 1, 300) || '…' END AS question, "
        "CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS probe FROM documents"
    ),
    "iso_text": _tickets(f"SELECT hubspot_ticket_id, {_iso('closed_at')} AS closed_at FROM t"),
    "effective_role": _access(
        "SELECT username, CASE WHEN list_contains(groups, 'Supervisor') THEN 'Supervisor' ELSE 'Agent' END AS role, "
        "array_to_string(list_sort(list_distinct(groups)), ',') AS groups_text FROM "
        "(SELECT username, coalesce(string_split(grps, ','), CAST([] AS VARCHAR[])) AS groups FROM raw_provider)"
    ),
    "day_expansion": _timed(
        "SELECT hubspot_ticket_id, CAST(CAST(d AS DATE) AS VARCHAR) AS open_day, CAST(dow AS INTEGER) AS dow, "
        "CAST(work_seconds AS BIGINT) AS work_seconds FROM open_days",
        ALL,
    ),
    "business_seconds": _seconds(ALL),
    "business_seconds_by_days": _seconds(ALL),
    "total_tickets": _tickets("SELECT count(*) AS total_tickets FROM t"),
    "category_counts": _tickets("SELECT category, count(*) AS count FROM t WHERE category IS NOT NULL GROUP BY 1"),
    "category_counts_top": _tickets(
        "SELECT category, count(*) AS count FROM t WHERE category IS NOT NULL GROUP BY 1 ORDER BY count DESC, category LIMIT 3"
    ),
    "top_categories": _counts(STANDARD, limit="LIMIT 10", category=CATEGORY),
    "returned_total": _tickets(
        "SELECT CAST(sum(count) AS BIGINT) AS total FROM (SELECT count FROM c ORDER BY count DESC, category LIMIT 3)",
        c=f"SELECT {CATEGORY} AS category, count(*) AS count FROM t WHERE {_in_range(STANDARD)} GROUP BY 1",
    ),
    "tickets_by_source": _by_source(STANDARD),
    "top_agents": _counts(STANDARD, limit="LIMIT 10", agent=AGENT),
    "top_subcategories": _tickets(
        "SELECT *, category || ' — ' || subcategory AS label FROM c",
        c=f"SELECT {CATEGORY} AS category, {SUBCATEGORY} AS subcategory, count(*) AS count FROM t "
        f"WHERE {_in_range(STANDARD)} GROUP BY 1, 2",
    ),
    "top_subcategories_top": _tickets(
        "SELECT *, category || ' — ' || subcategory AS label FROM c ORDER BY count DESC, category, subcategory LIMIT 7",
        c=f"SELECT {CATEGORY} AS category, {SUBCATEGORY} AS subcategory, count(*) AS count FROM t "
        f"WHERE {_in_range(STANDARD)} GROUP BY 1, 2",
    ),
    "closed_total": _total(STANDARD),
    "closed_daily": _daily(DAYS),
    "closed_monthly": _monthly(MONTHS),
    "closed_volume_one_day": f"SELECT 'total' AS grain, '{ONE_DAY[0]}' AS period, '{ONE_DAY[0]}' AS date, total_closed AS count FROM ({_total(ONE_DAY)})",
    "closed_volume_daily": f"SELECT 'daily' AS grain, date AS period, date, count FROM ({_daily(DAYS)})",
    "closed_volume_monthly": f"SELECT 'monthly' AS grain, month AS period, date, count FROM ({_monthly(MONTHS)})",
    "closed_volume_by_day": f"SELECT 'daily' AS grain, date AS period, date, count FROM ({_daily(MONTHS)})",
    "resolution_by_agent": _mean_by(AGENT_NAME, "agent", "total_closed", STANDARD),
    "resolution_by_agent_top": _mean_by(
        AGENT_NAME, "agent", "total_closed", STANDARD, limit="ORDER BY avg_hours_business, total_closed DESC, agent LIMIT 5"
    ),
    "resolution_overall": _overall(STANDARD),
    "resolution_overall_empty": _overall(("2030-01-01", "2030-01-02")),
    "resolution_by_source": _mean_by(SOURCE, "source", "tickets", STANDARD),
    "resolution_by_source_desc": _mean_by(SOURCE, "source", "tickets", STANDARD),
    "slow_cases": _slow(STANDARD),
    "wide_business_seconds": _seconds(WIDE, fx.WIDE_TICKETS),
    "wide_resolution_by_agent": _mean_by(AGENT_NAME, "agent", "total_closed", WIDE, fx.WIDE_TICKETS),
    "wide_resolution_by_source": _mean_by(SOURCE, "source", "tickets", WIDE, fx.WIDE_TICKETS),
    "wide_resolution_overall": _overall(WIDE, fx.WIDE_TICKETS),
    "wide_slow_cases": _slow(WIDE, fx.WIDE_TICKETS),
    "wide_top_agents": _counts(WIDE, fx.WIDE_TICKETS, "LIMIT 10", agent=AGENT),
    "wide_tickets_by_source": _by_source(WIDE, fx.WIDE_TICKETS),
    "wide_top_subcategories": _tickets(
        "SELECT *, category || ' — ' || subcategory AS label FROM c",
        fx.WIDE_TICKETS,
        c=f"SELECT {CATEGORY} AS category, {SUBCATEGORY} AS subcategory, count(*) AS count FROM t "
        f"WHERE {_in_range(WIDE)} GROUP BY 1, 2",
    ),
    "wide_closed_daily": _daily(WIDE, fx.WIDE_TICKETS),
    "wide_closed_monthly": _monthly(WIDE, fx.WIDE_TICKETS),
    "session_text": _session_parts(4096),
    "session_text_parts": _session_parts(2),
    "tool_invocations": _trace_fields(
        f"SELECT session_id, seq, action_group, api_path, http_method, status FROM f WHERE {_USED}"
    ),
    "session_summary": _trace_fields(_SUMMARY),
    "tool_usage": _trace_fields(
        "SELECT action_group, api_path, status, count(*) AS calls, "
        f"count(*) FILTER (TRY_CAST(status AS INTEGER) >= 400) AS errors FROM f WHERE {_USED} GROUP BY 1, 2, 3"
    ),
    "replay_roster": _roster(_LAST_STATE, with_start=False),
    "replay_roster_from_start": _roster(_LAST_STATE, with_start=True),
    "roster_rejects": _roster(_REJECTS, with_start=False),
    "roster_rejects_from_start": _roster(_REJECTS, with_start=True),
    "check_allowlist": _access(
        "SELECT e.email, e.checks, CASE WHEN contains(e.email, '@') THEN coalesce(u.status = 'active', FALSE) END AS allowed, "
        "CASE WHEN contains(e.email, '@') THEN u.role END AS role, "
        "CASE WHEN NOT contains(e.email, '@') THEN 'invalid_email' END AS error "
        "FROM (SELECT coalesce(email, '') AS email, count(*) AS checks FROM q GROUP BY 1) e LEFT JOIN u ON e.email = u.email"
    ),
    "authorize": _access(
        "SELECT request_id, q.email, required_role, CASE WHEN u.status = 'active' THEN u.role END AS role, "
        "CASE WHEN u.status IS DISTINCT FROM 'active' THEN 'not_authorized' WHEN required_role IS NULL OR u.role = required_role "
        "OR (required_role = 'Agent' AND u.role = 'Supervisor') THEN 'ok' ELSE 'role_mismatch' END AS outcome "
        "FROM q LEFT JOIN u ON q.email = u.email"
    ),
    "role_drift": _access(_DRIFT),
    "plan_role_sync": _plan("SELECT * EXCLUDE (after) FROM plan", change=False),
    "plan_role_change": _plan("SELECT * EXCLUDE (after) FROM plan", change=True),
    "audit_rows": _plan(_AUDIT, change=True),
    "audit_log": (
        f"SELECT *, 'plan-1' AS plan_id FROM ({_plan(_AUDIT, change=True)}) "
        f"UNION ALL SELECT *, 'plan-2' AS plan_id FROM ({_plan(_AUDIT, change=False)})"
    ),
    "invite_status": _access(
        "SELECT email, role, status, token_expires_at, coalesce(token_expires_at < TIMESTAMP '2024-01-12', FALSE) AS expired "
        "FROM u WHERE token IS NOT NULL"
    ),
    "stream_ingest": _parsed(f"SELECT {TICKET_COLUMNS}, pos, batch_id FROM ranked WHERE r = 1"),
    "stream_ingest_counts": _parsed(
        "SELECT batch_id, count(*) FILTER (p.error IS NULL AND r = 1) AS inserted, count(*) FILTER (p.error IS NOT NULL) AS skipped, "
        "count(*) FILTER (p.error IS NULL AND r > 1) AS duplicate, count(*) AS total_processed "
        "FROM p LEFT JOIN (SELECT pos, r FROM ranked) USING (pos) GROUP BY batch_id"
    ),
    "stream_closed_daily": _tickets(
        "SELECT CAST(CAST(closed_at AS DATE) AS VARCHAR) AS day, count(*) AS count FROM t WHERE closed_at IS NOT NULL GROUP BY 1"
    ),
    "stream_ingest_within": _parsed(f"SELECT {TICKET_COLUMNS}, pos FROM ranked WHERE r = 1"),
    "stream_rejects": _parsed("SELECT pos, error FROM p WHERE error IS NOT NULL"),
    "finished_ingests": _parsed(f"SELECT {TICKET_COLUMNS}, batch_id FROM ranked WHERE r = 1 AND batch_id < 3"),
    "stream_closed_windows": _tickets(
        "SELECT CAST(day AS VARCHAR) AS day, count(*) AS count FROM ("
        "SELECT CAST(closed_at AS DATE) AS day, part, max(closed_at) FILTER (part < 2) OVER () - INTERVAL 2 DAY AS known, "
        "max(closed_at) OVER () - INTERVAL 2 DAY AS until FROM (SELECT closed_at, CASE WHEN CAST(hubspot_ticket_id AS BIGINT) % 97 = 0 THEN 2 "
        "WHEN closed_at < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS part FROM t WHERE closed_at IS NOT NULL)) "
        "WHERE (part < 2 OR day + INTERVAL 1 DAY > known) AND day + INTERVAL 1 DAY <= until GROUP BY day"
    ),
    "plan_status_change": _access(
        "SELECT w.email, u.status AS status_from, w.status_to, CASE WHEN applies AND g.username IS NOT NULL THEN g.username END AS username, "
        "CASE WHEN applies AND g.username IS NOT NULL THEN CASE WHEN status_to = 'revoked' THEN 'disable' ELSE 'enable' END END AS account_action, "
        "applies AND status_to = 'revoked' AS token_cleared, applies AND g.username IS NOT NULL AND status_to = 'revoked' AS tokens_revoked, "
        "CASE WHEN NOT valid THEN 'invalid_status' WHEN NOT applies THEN 'user_not_in_DB' "
        "WHEN g.username IS NULL THEN 'cognito_user_not_found; DB updated' ELSE 'ok' END AS status FROM ("
        "SELECT w.*, status_to IN ('pending', 'active', 'revoked') AS valid, "
        "valid AND w.email IN (SELECT email FROM u) AS applies FROM ("
        "SELECT lower(email) AS email, target_status AS status_to FROM (" + fx.STATUS_REQUESTS.sql() + ") "
        "QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY seq DESC) = 1) w) w "
        "LEFT JOIN u ON w.email = u.email LEFT JOIN g ON w.email = g.email"
    ),
    "access_gate": _access(
        "SELECT request_id, lower(trim(x.email)) AS email, required_role, "
        "CASE WHEN NOT coalesce(ends_with(lower(trim(x.email)), '@corp.example'), FALSE) THEN 'domain_not_allowed' "
        "WHEN NOT (list_contains(grp, 'Agent') OR list_contains(grp, 'Supervisor')) THEN 'group_missing' "
        "WHEN u.status IS DISTINCT FROM 'active' THEN 'not_authorized' "
        "WHEN required_role IS NULL THEN 'ok' "
        "WHEN required_role = 'Agent' THEN 'ok' "
        "WHEN u.role = 'Supervisor' AND list_contains(grp, 'Supervisor') THEN 'ok' ELSE 'role_mismatch' END AS outcome "
        "FROM (SELECT *, coalesce(string_split(grps, ','), CAST([] AS VARCHAR[])) AS grp FROM (" + fx.GATE_REQUESTS.sql() + ")) x "
        "LEFT JOIN u ON lower(trim(x.email)) = u.email"
    ),
    "ingested_resolution_by_source": _ingested(_mean_by(SOURCE, "source", "tickets", ALL)),
    "ingested_closed_daily": _ingested(_daily(STANDARD)),
    "stored_resolution_by_agent": _mean_by(AGENT_NAME, "agent", "total_closed", STANDARD),
    "stored_top_categories": _counts(STANDARD, limit="LIMIT 10", category=CATEGORY),
    "ingested_partial_resolution": _ingested(_mean_by(SOURCE, "source", "tickets", ALL)),
    "ingests_after_merges": _parsed(f"SELECT {TICKET_COLUMNS}, batch_id FROM ranked WHERE r = 1"),
    "partial_top_categories": _counts(STANDARD, limit="LIMIT 10", category=CATEGORY),
    "partial_tickets_by_source": _by_source(WIDE, fx.WIDE_TICKETS),
    "partial_top_agents": _counts(WIDE, fx.WIDE_TICKETS, "LIMIT 10", agent=AGENT),
    "partial_closed_total": _total(STANDARD),
    "partial_closed_daily": _daily(DAYS),
    "partial_closed_monthly": _monthly(MONTHS),
    "partial_resolution_by_agent": _mean_by(AGENT_NAME, "agent", "total_closed", STANDARD),
    "partial_resolution_by_source": _mean_by(SOURCE, "source", "tickets", STANDARD),
    "partial_resolution_overall": _overall(WIDE, fx.WIDE_TICKETS),
}
ORACLES["partial_top_subcategories"] = ORACLES["top_subcategories"]

_BY_COUNT = "count DESC, "
# The order of each report as SQL; a query that returned its rows in another one would not match.
ORDERS = {
    "list_roster": "created_at DESC NULLS FIRST, email",
    "category_counts": _BY_COUNT + "category",
    "category_counts_top": _BY_COUNT + "category",
    "top_categories": _BY_COUNT + "category",
    "tickets_by_source": _BY_COUNT + "source",
    "top_agents": _BY_COUNT + "agent",
    "top_subcategories": _BY_COUNT + "category, subcategory",
    "top_subcategories_top": _BY_COUNT + "category, subcategory",
    "closed_daily": "date",
    "closed_monthly": "month",
    "resolution_by_agent": "avg_hours_business, total_closed DESC, agent",
    "resolution_by_agent_top": "avg_hours_business, total_closed DESC, agent",
    "resolution_by_source": "avg_hours_business, tickets DESC, source",
    "resolution_by_source_desc": "avg_hours_business DESC, tickets DESC, source",
    "slow_cases": "hours_business_resolution DESC, closed_at DESC, hubspot_ticket_id",
    "partial_top_categories": _BY_COUNT + "category",
    "partial_tickets_by_source": _BY_COUNT + "source",
    "partial_top_agents": _BY_COUNT + "agent",
    "partial_top_subcategories": _BY_COUNT + "category, subcategory",
    "partial_closed_daily": "date",
    "partial_closed_monthly": "month",
    "partial_resolution_by_agent": "avg_hours_business, total_closed DESC, agent",
    "partial_resolution_by_source": "avg_hours_business DESC, tickets DESC, source",
}
ORACLES |= {name: f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({ORACLES[name]})" for name, order in ORDERS.items()}
