"""Labels for grouped reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels shown for missing text.
NO_CATEGORY = "Sin categoría"
NO_SUBCATEGORY = "Sin subcategoría"
NO_SOURCE = "Desconocido"
NO_AGENT = "Sin asignar"

# Month names, January first.
MONTH_NAMES = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)


def label_or(*columns: Column, fallback: str) -> Column:
    """The first column that is not blank, spaces trimmed, else ``fallback``."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(fallback))


def category_label() -> Column:
    return label_or(F.col("category"), fallback=NO_CATEGORY)


def subcategory_label() -> Column:
    return label_or(F.col("subcategory"), fallback=NO_SUBCATEGORY)


def source_label() -> Column:
    return label_or(F.col("source"), fallback=NO_SOURCE)


def agent_label() -> Column:
    """Agent name, else agent id, else a fixed label (ranking by count)."""
    return label_or(F.col("owner_name"), F.col("owner_id"), fallback=NO_AGENT)


def agent_name_label() -> Column:
    """Agent name or a fixed label; the id is not used (time-to-resolve reports)."""
    return label_or(F.col("owner_name"), fallback=NO_AGENT)


def pair_label(first: Column, second: Column) -> Column:
    return F.concat_ws(" — ", first, second)


def month_label(day: Column) -> Column:
    """``Enero 2024`` for any day of January 2024."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat_ws(" ", F.element_at(names, F.month(day)), F.year(day).cast("string"))


def whole_div(numerator: Column, denominator: Column) -> Column:
    """Whole division on BIGINT; NULL for a zero denominator."""
    return F.call_function("div", numerator.cast("bigint"), F.nullif(denominator.cast("bigint"), F.lit(0).cast("bigint")))


def percent_share(part: Column, total: Column) -> Column:
    """Share of ``total`` in percent, one decimal, exact ties rounded up."""
    return whole_div(2000 * part + total, 2 * total) / F.lit(10.0)
