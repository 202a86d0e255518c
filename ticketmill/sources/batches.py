"""Ticket batches: one JSON object per line, parsed, defaulted and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.timecalc import wall_clock
from ticketmill.sources.schemas import TEXT_DEFAULTS, TICKET_KEY, TICKETS

# Texts of the batch errors.
MISSING_ID = "hubspot_ticket_id es requerido"
BAD_TIME = "invalid input syntax for type timestamp with time zone"
BAD_JSON = "línea JSON inválida"
NOT_OBJECT = "se esperaba un objeto JSON"

TIME_COLUMNS = ("created_at", "closed_at")


def _text(key: str) -> Column:
    """Text of the value under a key; NULL where the key is absent or null."""
    return F.col(f"doc.{key}")


def _is_present(key: str) -> Column:
    """True where the key is there, also with a JSON null."""
    return F.array_contains("keys", key)


def _value(key: str) -> Column:
    """The value as a variant, from a second parse of the line; for the few rows that need its type."""
    return F.try_variant_get(F.try_parse_json("line"), f"$.{key}", "variant")


def _json_field(name: str) -> Column:
    """JSON text of a value; only where it seems to be a string does it need its quotes back."""
    seems_string = F.col("line").rlike(rf'"{name}"\s*:\s*"')
    quoted = F.when(seems_string, F.to_json(_value(name)))
    return F.when(_is_present(name), F.coalesce(quoted, _text(name), F.lit("null"))).otherwise(F.lit("{}"))


def _field(name: str) -> Column:
    """A text column; a default fills in for an absent key only, not for null."""
    if name == "raw_hubspot":
        return _json_field(name)
    if name in TEXT_DEFAULTS:
        return F.when(_is_present(name), _text(name)).otherwise(F.lit(TEXT_DEFAULTS[name]))
    return _text(name)


def _time(text: Column, tz: str) -> Column:
    """Wall-clock time in ``tz``; text that names its own zone is converted. NULL unless it has a full date."""
    trimmed = F.trim(text)
    has_date = (F.substring(trimmed, 5, 1) == "-") & (F.substring_index(trimmed, "-", 2) != trimmed)
    zone = F.translate(F.substring(trimmed, 12, 64), "0123456789:. ", "")
    zoned = wall_clock(trimmed.try_cast("timestamp"), tz)
    return F.when(has_date, F.when(zone != "", zoned).otherwise(trimmed.try_cast("timestamp_ntz")))


def _is_empty_value(text: Column) -> Column:
    """Absent, null, empty text, zero, false, or an empty list or object.

    Text that looks like one of the last is looked up in the line again, to
    tell the number 0 from the text "0"; hardly any row needs that.
    """
    looks_empty = text.isin("false", "[]", "{}") | (text.try_cast("double") == 0)
    return (
        F.when(text.isNull() | (text == ""), F.lit(True))
        .when(looks_empty, F.schema_of_variant(_value(TICKET_KEY)) != "STRING")
        .otherwise(F.lit(False))
    )


def _error(row_number: Column) -> Column:
    """The first fault of a row as text, NULL for a good row."""

    def fault(subject: Column, *message: Column) -> Column:
        return F.concat(F.lit("Ticket "), subject, F.lit(": "), *message)

    place = row_number.cast("string")
    unreadable = F.when(F.try_parse_json("line").isNull(), F.lit(BAD_JSON)).otherwise(F.lit(NOT_OBJECT))
    bad_time = [
        F.when(
            _text(key).isNotNull() & F.col(key).isNull(),
            fault(_text(TICKET_KEY), F.lit(f'{BAD_TIME}: "'), _text(key), F.lit('"')),
        )
        for key in TIME_COLUMNS
    ]
    return F.coalesce(
        F.when(F.col("keys").isNull(), fault(place, unreadable)),
        F.when(_is_empty_value(_text(TICKET_KEY)), fault(place, F.lit(MISSING_ID))),
        *bad_time,
    )


def parse_ticket_rows(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """All rows of a batch with the ticket columns and ``error`` (NULL for a good row).

    ``raw`` needs ``pos`` and ``line``; its other columns (such as a batch id)
    are passed through.
    """
    kept = [c for c in raw.columns if c != "line"]
    names = TICKETS.fieldNames()
    text_schema = ", ".join(f"{name} STRING" for name in names)
    # Absent and null keys look the same in a parsed struct, so the key names are read too.
    documents = raw.select(
        *kept, "line", F.from_json("line", text_schema).alias("doc"), F.json_object_keys("line").alias("keys")
    )
    columns = [_time(_text(n), tz).alias(n) if n in TIME_COLUMNS else _field(n).alias(n) for n in names]
    rows = documents.select(*kept, "line", "doc", "keys", *columns)
    # A filter on ``error`` would be pushed below the parse and repeat it for every key
    # it reads. It does not pass a generator, so each line is parsed and judged once.
    checked = F.struct(*kept, "line", *names, _error(F.col("pos")).alias("error"))
    return rows.select(F.explode(F.array(checked)).alias("row")).select("row.*")


def split_ticket_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows as ``(valid, rejected)``."""
    valid = rows.where(F.col("error").isNull()).drop("error", "line")
    others = [c for c in rows.columns if c not in TICKETS.fieldNames() and c not in ("line", "error")]
    rejected = rows.where(F.col("error").isNotNull()).select(*others, "error", "line")
    return valid, rejected


def parse_tickets(raw: DataFrame, tz: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Parse a batch into ``(valid, rejected)``; only bad rows are set aside."""
    return split_ticket_rows(parse_ticket_rows(raw, tz))
