"""E-mail and role functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketmill.functions.text import strip

# Roles and statuses of the roster.
AGENT = "Agent"
SUPERVISOR = "Supervisor"
ROLES = (AGENT, SUPERVISOR)
STATUSES = ("pending", "active", "revoked")


def normalize_email(c: Column) -> Column:
    return strip(F.lower(c))


def is_email(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("@")), F.lit(False))


def email_in_domain(c: Column, domain: str) -> Column:
    return F.coalesce(F.endswith(F.lower(c), F.lit("@" + domain.lower())), F.lit(False))


def effective_role(groups: Column) -> Column:
    """Supervisor when the user is in that group, else Agent."""
    return F.when(F.array_contains(groups, SUPERVISOR), F.lit(SUPERVISOR)).otherwise(F.lit(AGENT))


def groups_text(groups: Column) -> Column:
    """Distinct groups, sorted, as comma-separated text."""
    return F.array_join(F.array_sort(F.array_distinct(groups)), ",")


def other_role(role: Column) -> Column:
    return F.when(role == AGENT, F.lit(SUPERVISOR)).otherwise(F.lit(AGENT))
