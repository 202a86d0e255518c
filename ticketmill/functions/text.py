"""Text functions: ISO timestamps, JSON, masking, previews, whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def iso_text(ts: Column, offset: str = "+00:00") -> Column:
    """ISO 8601 text of a TIMESTAMP_NTZ; six fraction digits, or none for whole seconds."""
    plain = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    padded = F.when(F.contains(plain, F.lit(".")), F.rpad(plain, 26, "0")).otherwise(plain)
    return F.concat(padded, F.lit(offset))


def json_text(c: Column) -> Column:
    """JSON text of a struct; keys with NULL are kept, non-ASCII text stays as it is."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def mask_email(c: Column) -> Column:
    """First two characters and an ellipsis; an e-mail keeps its domain."""
    name, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    return F.when(
        F.contains(c, F.lit("@")), F.concat(F.substring(name, 1, 2), F.lit("…@"), domain)
    ).otherwise(F.concat(F.substring(c, 1, 2), F.lit("…")))


def preview_text(c: Column, length: int, mark: str = "...", mark_at_length: bool = False) -> Column:
    """The first ``length`` characters and ``mark`` when the text is longer.

    With ``mark_at_length`` a text of exactly ``length`` characters is marked too.
    """
    too_long = F.length(c) >= length if mark_at_length else F.length(c) > length
    return F.when(too_long, F.concat(F.substring(c, 1, length), F.lit(mark))).otherwise(c)
