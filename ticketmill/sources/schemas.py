"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Defaults for keys that a ticket payload leaves out.
TEXT_DEFAULTS = {
    "itinerary_number": "N/A",
    "source": "Email",
    "category": "Consulta General",
    "subcategory": "Consulta",
}

TICKET_KEY = "hubspot_ticket_id"


TEXT = T.StringType()
TIME = T.TimestampNTZType()
WHOLE = T.LongType()
LIST = T.ArrayType(TEXT)


def _schema(key: str | None = None, **columns: T.DataType) -> T.StructType:
    """A schema in the order given; all columns but ``key`` may be NULL."""
    return T.StructType([T.StructField(name, kind, name != key) for name, kind in columns.items()])


TICKETS = _schema(
    key=TICKET_KEY,
    hubspot_ticket_id=TEXT,
    subject=TEXT,
    content=TEXT,
    created_at=TIME,
    closed_at=TIME,
    itinerary_number=TEXT,
    source=TEXT,
    category=TEXT,
    subcategory=TEXT,
    resolution=TEXT,
    owner_id=TEXT,
    owner_name=TEXT,
    case_key=TEXT,
    raw_hubspot=TEXT,  # JSON
)

# One ticket of a batch as JSON text; ``pos`` is its place in the batch.
TICKET_LINES = _schema(pos=WHOLE, line=TEXT)

INVITED_USERS = _schema(
    key="email",
    email=TEXT,
    role=TEXT,
    status=TEXT,
    invited_by=TEXT,
    token=TEXT,
    token_expires_at=TIME,
    created_at=TIME,
    updated_at=TIME,
)

ROSTER_COMMANDS = _schema(
    email=TEXT, seq=WHOLE, cmd=TEXT, role=TEXT, status=TEXT, token=TEXT, cmd_at=TIME, actor=TEXT
)

PROVIDER_GROUPS = _schema(email=TEXT, username=TEXT, groups=LIST)

LOGIN_EVENTS = _schema(
    email=TEXT, provider_sub=TEXT, groups=LIST, result=TEXT, reason=TEXT, user_agent=TEXT, ip=TEXT
)

CHAT_EVENTS = _schema(session_id=TEXT, seq=WHOLE, kind=TEXT, payload=TEXT)
