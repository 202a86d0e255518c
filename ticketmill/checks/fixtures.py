"""Ticket, chat and roster tables derived from the test tables.

Each fixture is a projection of one whole table. Its column expressions are SQL
that both engines understand; the few that differ are given per engine through
the tokens in ``TOKENS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TOKENS = {
    "$TEXT": ("STRING", "VARCHAR"),
    "$NTZ": ("TIMESTAMP_NTZ", "TIMESTAMP"),
    "$PROPS_K": ("get_json_object(props, '$.k')", "(props::JSON->>'$.k')"),
    "$TAB": ("char(9)", "chr(9)"),
    "$NEWLINE": ("char(10)", "chr(10)"),
}


@dataclass(frozen=True)
class Fixture:
    table: str
    columns: dict[str, str]
    where: str = "TRUE"
    values: tuple[tuple[str, str], ...] = ()

    def _render(self, text: str, engine: int) -> str:
        for _ in range(2):
            for token, forms in TOKENS.items():
                text = text.replace(token, forms[engine])
            for token, value in self.values:
                text = text.replace(token, value)
        return text

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The fixture as a DataFrame."""
        table = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        items = [f"{self._render(expr, 0)} AS {name}" for name, expr in self.columns.items()]
        return table.where(self._render(self.where, 0)).selectExpr(*items)

    def sql(self) -> str:
        """The fixture as a DuckDB query."""
        items = ", ".join(f"{self._render(expr, 1)} AS {name}" for name, expr in self.columns.items())
        return f"SELECT {items} FROM {self.table} WHERE {self._render(self.where, 1)}"


# Open time of a ticket in seconds: ``value`` is taken as hours; some close before they open.
_OPEN = "CASE WHEN event_id % 103 = 0 THEN CAST(-172800 AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) * 36 END"

# Tickets with every awkward case: blank, padded and missing labels, missing
# times, reversed times, fractions of a second.
TICKETS = Fixture(
    "events",
    {
        "hubspot_ticket_id": "CAST(event_id AS $TEXT)",
        "subject": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('Case ', CAST(event_id AS $TEXT)) END",
        "content": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('Reservación \"', event_type, '\"') END",
        "created_at": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END",
        "closed_at": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts + ($X) * INTERVAL 1 SECOND END",
        "itinerary_number": "CASE WHEN event_id % 6 = 0 THEN 'N/A' ELSE concat('IT-', CAST(user_id AS $TEXT)) END",
        "source": "CASE WHEN event_id % 4 = 0 THEN 'Email' WHEN event_id % 4 = 1 THEN ' Chat ' "
        "WHEN event_id % 4 = 2 THEN 'Phone' WHEN event_id % 8 = 3 THEN '  ' ELSE NULL END",
        "category": "CASE WHEN event_id % 17 = 0 THEN '   ' WHEN event_id % 19 = 0 THEN NULL ELSE event_type END",
        "subcategory": "CASE WHEN event_id % 13 = 0 THEN '' "
        "ELSE concat('k', CAST(CAST($PROPS_K AS BIGINT) % 5 AS $TEXT)) END",
        "resolution": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('Solución ', event_type) END",
        "owner_id": "CASE WHEN user_id % 22 = 0 THEN '' ELSE CAST(user_id AS $TEXT) END",
        "owner_name": "CASE WHEN user_id % 10 = 0 THEN ' ' WHEN user_id % 11 = 0 THEN NULL "
        "ELSE concat('Agent ', CAST(user_id % 25 AS $TEXT)) END",
        "case_key": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat('CK', CAST(event_id % 1000 AS $TEXT)) END",
        "raw_hubspot": "props",
    },
    values=(("$X", _OPEN),),
)

# One ticket per order line, over several years.
_CLOSES = "(l_partkey * 7919) % 86400"
WIDE_TICKETS = Fixture(
    "lineitem",
    {
        "hubspot_ticket_id": "concat_ws('-', CAST(l_orderkey AS $TEXT), CAST(l_linenumber AS $TEXT), "
        "CAST(l_partkey AS $TEXT), CAST(l_suppkey AS $TEXT), CAST(CAST(l_quantity AS BIGINT) AS $TEXT), "
        "substring(CAST(l_shipdate AS $TEXT), 1, 10))",
        "subject": "CAST(l_orderkey AS $TEXT)",
        "created_at": "l_shipdate + ($X) * INTERVAL 1 SECOND",
        "closed_at": "l_shipdate + ($Y) * INTERVAL 1 SECOND",
        "owner_id": "CAST(l_suppkey AS $TEXT)",
        "owner_name": "concat('Agent ', CAST(l_suppkey AS $TEXT))",
        "source": "l_returnflag",
        "category": "l_linestatus",
        "subcategory": "l_returnflag",
    },
    values=(("$X", f"{_CLOSES} - CAST(l_quantity AS BIGINT) * 25200"), ("$Y", _CLOSES)),
)

# Ticket payloads as JSON lines: repeated, missing, empty, null and numeric ids;
# absent, null and present keys; bad and zoned times; lines that are no object.
TICKET_LINES = Fixture(
    "events",
    {
        "batch_id": "event_id % 4",
        "pos": "event_id",
        "line": "CASE WHEN event_id % 229 = 0 THEN '{\"subject\": ' WHEN event_id % 233 = 0 THEN '[1, 2]' ELSE concat('{',"
        "CASE WHEN event_id % 211 = 0 THEN '' WHEN event_id % 223 = 0 THEN '\"hubspot_ticket_id\": \"\", ' "
        "WHEN event_id % 241 = 0 THEN '\"hubspot_ticket_id\": null, ' WHEN event_id % 251 = 0 THEN '\"hubspot_ticket_id\": 0, ' "
        "WHEN event_id % 10 = 0 THEN concat('\"hubspot_ticket_id\": ', CAST(event_id % 7000 AS $TEXT), ', ') "
        "ELSE concat('\"hubspot_ticket_id\": \"', CAST(event_id % 7000 AS $TEXT), '\", ') END, "
        "'\"subject\": \"Opción ', event_type, '\", ', "
        "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '\"source\": null, ' ELSE '\"source\": \"Phone\", ' END, "
        "CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('\"category\": \"', event_type, '\", ') END, "
        "'\"created_at\": \"', substring(CAST(ts AS $TEXT), 1, 19), CASE WHEN event_id % 5 = 0 THEN 'Z' "
        "WHEN event_id % 5 = 1 THEN '+02:00' ELSE '' END, '\", ', "
        "CASE WHEN event_id % 227 = 0 THEN '\"closed_at\": \"not a date\", ' WHEN event_id % 9 = 0 THEN '' "
        "WHEN event_id % 9 = 1 THEN '\"closed_at\": null, ' "
        "ELSE concat('\"closed_at\": \"', substring(CAST(ts AS $TEXT), 1, 10), '\", ') END, "
        "'\"raw_hubspot\": ', CASE WHEN event_id % 8 = 0 THEN 'null' ELSE props END, '}') END",
    },
)

# Tickets stored before the batches arrive.
STORED_KEYS = Fixture("customer", {"hubspot_ticket_id": "CAST(c_custkey * 7 AS $TEXT)"})

# Turns with gaps between their numbers; those of users are traces.
CHAT_CHUNKS = Fixture(
    "conversations",
    {
        "session_id": "CAST(conv_id AS $TEXT)",
        "seq": "turn * 3",
        "kind": "CASE WHEN role = 'assistant' THEN 'chunk' ELSE 'trace' END",
        "payload": "concat(' ', $TAB, text, $NEWLINE, '  ')",
    },
)

CHAT_TRACES = Fixture(
    "events",
    {
        "session_id": "CAST(user_id AS $TEXT)",
        "seq": "event_id",
        "kind": "CASE WHEN event_id % 50 = 0 THEN 'chunk' ELSE 'trace' END",
        "payload": "CASE WHEN event_id % 50 = 0 THEN 'text' WHEN event_type = 'view' THEN "
        "concat('{\"actionGroup\":\"Analytics\",\"apiPath\":\"/analytics/p', CAST(event_id % 7 AS $TEXT), "
        "'\",\"httpMethod\":\"GET\",\"httpStatusCode\":200}') "
        "WHEN event_type = 'click' THEN concat('{\"toolName\":\"Lookup\",\"path\":\"/lookup/', "
        "CAST(event_id % 3 AS $TEXT), '\",\"method\":\"POST\",\"status\":\"201\"}') "
        "WHEN event_type = 'error' THEN '{\"name\":\"\",\"endpoint\":\"/broken\",\"statusCode\":500}' "
        "WHEN event_type = 'signup' AND user_id % 3 = 0 THEN "
        "concat('{\"agent\":\"', CASE WHEN event_id % 2 = 0 THEN 'KnowledgeAgent' ELSE 'TransactionAgent' END, "
        "'\",\"second\":\"MetricsAgent\",\"routeId\":\"r1\"}') "
        "ELSE '{\"orchestration\":\"step\"}' END",
    },
)
CHAT_AGENTS = ("MetricsAgent", "TransactionAgent", "KnowledgeAgent")
CHAT_GROUP_AGENTS = {"Analytics": "MetricsAgent"}

# Commands on users; tokens repeat, so that some accepts fit the open invitation.
ROSTER_LOG = Fixture(
    "events",
    {
        "email": "CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 67 = 0 THEN '  ' "
        "WHEN event_id % 71 = 0 THEN concat('User', CAST(user_id AS $TEXT)) "
        "ELSE concat(' User', CAST(user_id AS $TEXT), CASE WHEN user_id % 13 = 0 THEN '@Other.example' "
        "ELSE '@Corp.example' END) END",
        "seq": "event_id",
        "cmd": "CASE WHEN event_id % 43 = 0 THEN 'rename' WHEN event_type = 'signup' THEN 'invite' "
        "WHEN event_type = 'click' THEN 'accept' WHEN event_type = 'view' THEN 'set_role' ELSE 'set_status' END",
        "role": "CASE WHEN event_id % 31 = 0 THEN 'Manager' WHEN event_id % 2 = 0 THEN 'Agent' ELSE 'Supervisor' END",
        "status": "CASE WHEN event_id % 37 = 0 THEN 'paused' WHEN event_type = 'error' THEN 'revoked' "
        "WHEN event_id % 3 = 0 THEN 'pending' ELSE 'active' END",
        "token": "CASE WHEN event_id % 47 = 0 THEN '  ' WHEN event_type = 'click' "
        "THEN concat(' tok-', CAST(event_id % 3 AS $TEXT), ' ') ELSE concat('tok-', CAST(event_id % 3 AS $TEXT)) END",
        "cmd_at": "CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 10 DAY ELSE ts END",
        "actor": "concat('admin', CAST(event_id % 5 AS $TEXT), '@corp.example')",
    },
)

USERS = Fixture(
    "customer",
    {
        "email": "concat('user', CAST(c_custkey AS $TEXT), '@corp.example')",
        "role": "CASE WHEN c_custkey % 3 = 0 THEN 'Supervisor' ELSE 'Agent' END",
        "status": "CASE WHEN c_custkey % 4 = 1 THEN 'pending' WHEN c_custkey % 4 = 2 THEN 'revoked' ELSE 'active' END",
        "invited_by": "concat('admin', CAST(c_nationkey AS $TEXT), '@corp.example')",
        "token": "CASE WHEN c_custkey % 4 = 2 THEN NULL WHEN c_custkey % 5 < 3 "
        "THEN concat('tok-', CAST(c_custkey % 3 AS $TEXT)) ELSE NULL END",
        "token_expires_at": "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 4 <> 2 AND c_custkey % 5 < 3 "
        "THEN CAST('2024-01-01 12:00:00' AS $NTZ) + ($X) * INTERVAL 1 SECOND ELSE NULL END",
        "created_at": "CASE WHEN c_custkey % 17 = 0 THEN NULL "
        "ELSE CAST('2023-12-01 08:00:00' AS $NTZ) + ($X) * INTERVAL 1 SECOND END",
        "updated_at": "CAST('2023-12-15 09:30:00' AS $NTZ) + ($X) * INTERVAL 1 SECOND",
    },
    values=(("$X", "(c_custkey * 7919) % 1728000"),),
)

# What the identity provider holds: some users are unknown to it, and some are known to
# it only; every seventh has a second account. ``grps`` is a list as comma-separated text.
PROVIDER = Fixture(
    "customer",
    {
        "email": "concat('USER', CAST(c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 39 ELSE 40 END AS $TEXT), '@corp.example')",
        "username": "concat('u-', CAST(c_custkey AS $TEXT))",
        "grps": "CASE WHEN c_custkey % 5 = 0 THEN 'Agent' WHEN c_custkey % 5 = 1 THEN 'Supervisor' "
        "WHEN c_custkey % 5 = 2 THEN 'Agent,Supervisor' WHEN c_custkey % 5 = 3 THEN 'Beta,Agent' ELSE NULL END",
    },
)

# Requests of users, in mixed case and padded, some with no e-mail in them.
REQUESTS = Fixture(
    "orders",
    {
        "request_id": "o_orderkey",
        "email": "CASE WHEN o_orderkey % 53 = 0 THEN 'nobody' WHEN o_orderkey % 59 = 0 THEN NULL "
        "ELSE concat('  User', CAST(o_custkey + 30 AS $TEXT), '@CORP.example ') END",
        "required_role": "CASE WHEN o_orderstatus = 'F' THEN 'Agent' WHEN o_orderstatus = 'O' THEN 'Supervisor' ELSE NULL END",
    },
)

ROLE_REQUESTS = Fixture(
    "orders",
    {
        "email": "concat('User', CAST(o_custkey + 20 AS $TEXT), '@corp.example')",
        "seq": "o_orderkey",
        "target_role": "CASE WHEN o_orderkey % 11 = 0 THEN 'Manager' WHEN o_orderkey % 3 = 0 THEN 'Supervisor' "
        "WHEN o_orderkey % 3 = 1 THEN 'Agent' ELSE NULL END",
    },
)

STATUS_REQUESTS = Fixture(
    "orders",
    {
        "email": "concat('User', CAST(o_custkey + 20 AS $TEXT), '@corp.example')",
        "seq": "o_orderkey",
        "target_status": "CASE WHEN o_orderkey % 13 = 0 THEN 'paused' WHEN o_orderkey % 3 = 0 THEN 'revoked' "
        "WHEN o_orderkey % 3 = 1 THEN 'active' ELSE 'pending' END",
    },
)

# Requests that pass the whole gate; ``grps`` is a list as comma-separated text.
GATE_REQUESTS = Fixture(
    "orders",
    {
        "request_id": "o_orderkey",
        "email": "CASE WHEN o_orderkey % 53 = 0 THEN 'nobody' WHEN o_orderkey % 59 = 0 THEN NULL WHEN o_orderkey % 47 = 0 "
        "THEN concat('User', CAST(o_custkey AS $TEXT), '@other.example') "
        "ELSE concat('User', CAST(o_custkey + 30 AS $TEXT), '@CORP.example') END",
        "grps": "CASE WHEN o_orderkey % 5 = 0 THEN 'Supervisor' WHEN o_orderkey % 5 = 1 THEN 'Beta' WHEN o_orderkey % 5 = 2 THEN NULL "
        "ELSE 'Beta,Agent' END",
        "required_role": "CASE WHEN o_orderstatus = 'F' THEN 'Agent' WHEN o_orderstatus = 'O' THEN 'Supervisor' ELSE NULL END",
    },
)
