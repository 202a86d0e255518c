"""Access checks against the roster, and its comparison with provider groups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketmill.functions.access import AGENT, ROLES, STATUSES, SUPERVISOR, email_in_domain, is_email, normalize_email, other_role
from ticketmill.functions.text import json_text

BAD_EMAIL = "invalid_email"

# Wording of the audit rows.
AUDIT_PROVIDER_SUB = "admin:roles"
AUDIT_RESULT = "allowed"
STATUS_OK = "ok"
STATUS_NOOP = "noop"
STATUS_NOT_IN_ROSTER = "user_not_in_DB"
STATUS_NO_PROVIDER_USER = "cognito_user_not_found"
STATUS_ROSTER_ONLY = "cognito_user_not_found; DB updated"
STATUS_INVALID_ROLE = "invalid_role"
STATUS_INVALID_STATUS = "invalid_status"

# Outcomes of a request.
OK = "ok"
DOMAIN_NOT_ALLOWED = "domain_not_allowed"
GROUP_MISSING = "group_missing"
NOT_AUTHORIZED = "not_authorized"
ROLE_MISMATCH = "role_mismatch"


def check_allowlist(emails: DataFrame, users: DataFrame) -> DataFrame:
    """The verdict for every distinct normalised e-mail, with how often it was asked for.

    Requests are counted per e-mail before the join, so a frequent one adds a
    single row to it. A malformed e-mail gets an ``error`` and no verdict.
    """
    asked = emails.select(F.coalesce(normalize_email(F.col("email")), F.lit("")).alias("email"))
    counts = asked.groupBy("email").agg(F.count("*").alias("checks"))
    roster = users.select("email", "role", "status")
    good = is_email(F.col("email"))
    allowed = F.coalesce(F.col("status") == "active", F.lit(False))
    return counts.join(roster, "email", "left").select(
        "email",
        "checks",
        F.when(good, allowed).alias("allowed"),
        F.when(good, F.col("role")).alias("role"),
        F.when(~good, F.lit(BAD_EMAIL)).alias("error"),
    )


def _with_roster(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the role and status of their e-mail.

    A plain left join: Spark broadcasts a roster that it finds small, and else
    may split the requests of a frequent e-mail at run time.
    """
    roster = users.select("email", F.col("role").alias("roster_role"), F.col("status").alias("roster_status"))
    return requests.withColumn("email", normalize_email(F.col("email"))).join(roster, "email", "left")


def _is_active() -> Column:
    return F.coalesce(F.col("roster_status") == "active", F.lit(False))


def _role_passes() -> Column:
    required, role = F.col("required_role"), F.col("roster_role")
    supervised = (required == AGENT) & role.eqNullSafe(F.lit(SUPERVISOR))
    return required.isNull() | (required == "") | role.eqNullSafe(required) | supervised


def authorize(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome of each request (``request_id, email, required_role``) by roster status and role.

    ``required_role`` may be NULL. A supervisor also passes where an agent is
    required. One row per request.
    """
    active = _is_active()
    outcome = F.when(~active, F.lit(NOT_AUTHORIZED)).when(_role_passes(), F.lit(OK)).otherwise(F.lit(ROLE_MISMATCH))
    role = F.when(active, F.col("roster_role"))
    return _with_roster(requests, users).select(*requests.columns, role.alias("role"), outcome.alias("outcome"))


def access_gate(requests: DataFrame, users: DataFrame, domain: str, allowed: Sequence[str] = ROLES) -> DataFrame:
    """The first gate that stops each request: e-mail domain, provider group, roster status, role.

    ``requests``: ``request_id, email, groups`` (of the provider) and
    ``required_role``. Where a supervisor is required, the group must say so too.
    """
    groups = F.coalesce("groups", _no_groups())
    has_group = F.arrays_overlap(groups, F.array(*map(F.lit, allowed)))
    supervisor = (F.col("required_role") != SUPERVISOR) | F.array_contains(groups, SUPERVISOR)
    outcome = (
        F.when(~email_in_domain(F.col("email"), domain), F.lit(DOMAIN_NOT_ALLOWED))
        .when(~F.coalesce(has_group, F.lit(False)), F.lit(GROUP_MISSING))
        .when(~_is_active(), F.lit(NOT_AUTHORIZED))
        .when(~_role_passes() | ~F.coalesce(supervisor, F.lit(True)), F.lit(ROLE_MISMATCH))
        .otherwise(F.lit(OK))
    )
    return _with_roster(requests, users).select("request_id", "email", "required_role", outcome.alias("outcome"))


def _provider(groups: DataFrame) -> DataFrame:
    """One account for each e-mail, that of the least username, and how many there are."""
    account = F.struct("username", "groups")
    one = groups.groupBy(normalize_email(F.col("email")).alias("email")).agg(
        F.min_by(account, "username").alias("account"), F.count("*").alias("accounts")
    )
    return one.select("email", "account.username", "account.groups", "accounts")


def _no_groups() -> Column:
    return F.array().cast("array<string>")


def role_drift(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Roster role next to provider groups for every e-mail known to either side.

    In sync means: on the roster, and the role is among the groups or the
    provider does not know the user yet.
    """
    roster = users.select("email", F.col("role").alias("db_role"), F.col("status").alias("db_status"))
    joined = roster.withColumn("_in_roster", F.lit(True)).join(_provider(groups), "email", "full_outer")
    provider_groups = F.coalesce("groups", _no_groups())
    in_sync = F.col("_in_roster").isNotNull() & (
        F.coalesce(F.array_contains(provider_groups, F.col("db_role")), F.lit(False)) | F.col("username").isNull()
    )
    return joined.select(
        "email",
        "db_role",
        "db_status",
        "username",
        provider_groups.alias("groups"),
        F.coalesce("accounts", F.lit(0)).alias("accounts"),
        in_sync.alias("in_sync"),
    )


def plan_role_sync(
    users: DataFrame, groups: DataFrame, requests: DataFrame | None = None, force_logout: bool = True
) -> DataFrame:
    """The role and group changes that bring provider groups in line.

    Without ``requests`` every roster user is repaired to the roster role. With
    ``requests`` (``email, seq, target_role``) only those e-mails are planned; a
    NULL target repairs, any other sets that role in both places. The last
    request of an e-mail decides; it is found by aggregation, so an e-mail with
    very many requests does not gather in one task. A target that is no role is
    refused: nothing changes.
    """
    roster = users.select("email", F.col("role").alias("db_from"), F.lit(True).alias("_in_roster"))
    if requests is None:
        wanted = roster.withColumn("target", F.lit(None).cast("string"))
    else:
        last = F.max_by(F.struct("target_role"), "seq")["target_role"].alias("target")
        asked = requests.groupBy(normalize_email(F.col("email")).alias("email")).agg(last)
        wanted = asked.join(roster, "email", "left")
    joined = wanted.join(_provider(groups), "email", "left")

    verb = F.when(F.col("target").isNull(), F.lit("repair")).otherwise(F.lit("change"))
    refused = F.col("target").isNotNull() & ~F.col("target").isin(*ROLES)
    in_roster = F.col("_in_roster").isNotNull()
    has_provider = in_roster & F.col("username").isNotNull()
    # A requested role is on record even when the user is not on the roster.
    db_to = F.when(refused, F.col("db_from")).otherwise(F.coalesce("target", "db_from"))
    before = F.when(has_provider, F.coalesce("groups", _no_groups())).otherwise(_no_groups())
    other = other_role(db_to)
    synced = F.array_union(F.array_remove(before, other), F.array(db_to))
    after = F.when(has_provider & ~refused, synced).otherwise(before)
    db_changed = ~refused & in_roster & F.coalesce(F.col("target") != F.col("db_from"), F.col("target").isNotNull())
    groups_changed = ~refused & has_provider & (~F.array_contains(before, db_to) | F.array_contains(before, other))
    status = (
        F.when(refused, F.lit(STATUS_INVALID_ROLE))
        .when(~in_roster, F.lit(STATUS_NOT_IN_ROSTER))
        .when(~has_provider & (verb == "repair"), F.lit(STATUS_NO_PROVIDER_USER))
        .when(~has_provider & db_changed, F.lit(STATUS_ROSTER_ONLY))
        .when(has_provider & (db_changed | groups_changed), F.lit(STATUS_OK))
        .otherwise(F.lit(STATUS_NOOP))
    )
    suffix = F.when(~in_roster, F.lit(":db-miss")).when(~has_provider, F.lit(":cognito-miss")).otherwise(F.lit(""))
    return joined.select(
        "email",
        F.concat(verb, suffix).alias("action"),
        "db_from",
        db_to.alias("db_to"),
        F.when(has_provider, F.col("username")).alias("username"),
        before.alias("groups_before"),
        after.alias("groups_after"),
        db_changed.alias("db_changed"),
        groups_changed.alias("groups_changed"),
        (groups_changed & F.lit(force_logout)).alias("tokens_revoked"),
        status.alias("status"),
    )


def plan_status_change(users: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """What a change of roster status (``email, seq, target_status``) does on both sides; the last request decides.

    ``revoked`` clears the invitation token, disables the provider account and
    revokes its tokens; the other statuses enable it. Nothing is called here.
    """
    last = F.max_by(F.struct("target_status"), "seq")["target_status"].alias("status_to")
    asked = requests.groupBy(normalize_email(F.col("email")).alias("email")).agg(last)
    roster = users.select("email", F.col("status").alias("status_from"), F.lit(True).alias("_in_roster"))
    joined = asked.join(roster, "email", "left").join(_provider(groups), "email", "left")
    valid = F.coalesce(F.col("status_to").isin(*STATUSES), F.lit(False))
    applies = valid & F.col("_in_roster").isNotNull()
    revoked, has_account = F.col("status_to") == "revoked", F.col("username").isNotNull()
    status = (
        F.when(~valid, F.lit(STATUS_INVALID_STATUS))
        .when(~applies, F.lit(STATUS_NOT_IN_ROSTER))
        .when(~has_account, F.lit(STATUS_ROSTER_ONLY))
        .otherwise(F.lit(STATUS_OK))
    )
    on_account = applies & has_account
    return joined.select(
        "email",
        "status_from",
        "status_to",
        F.when(on_account, F.col("username")).alias("username"),
        F.when(on_account, F.when(revoked, F.lit("disable")).otherwise(F.lit("enable"))).alias("account_action"),
        F.coalesce(applies & revoked, F.lit(False)).alias("token_cleared"),
        F.coalesce(on_account & revoked, F.lit(False)).alias("tokens_revoked"),
        status.alias("status"),
    )


def audit_rows(plan: DataFrame, admin: str) -> DataFrame:
    """Login-event rows that record a sync plan; the reason is JSON text with explicit nulls."""
    reason = F.struct(
        "action",
        "db_from",
        "db_to",
        F.col("username").alias("cognito_username"),
        F.col("groups_after").alias("cognito_after"),
        "tokens_revoked",
        "status",
    )
    return plan.select(
        F.lower("email").alias("email"),
        F.lit(AUDIT_PROVIDER_SUB).alias("provider_sub"),
        F.col("groups_after").alias("groups"),
        F.lit(AUDIT_RESULT).alias("result"),
        json_text(reason).alias("reason"),
        F.lit(f"admin:{admin}").alias("user_agent"),
        F.lit(None).cast("string").alias("ip"),
    )


AUDIT_LOG = "email STRING, provider_sub STRING, groups ARRAY<STRING>, result STRING, reason STRING, user_agent STRING, ip STRING, plan_id STRING"


def write_audit(rows: DataFrame, path: str, plan_id: str) -> None:
    """Store the audit rows of one plan; storing them again replaces that plan's rows, and those of no other.

    A plan owns the folder ``plan_id=…``, so a retry after a lost driver leaves one copy.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", plan_id) or set(plan_id) == {"."}:
        raise ValueError(f"a plan id is letters, digits, '_', '-' and '.': {plan_id!r}")
    rows.write.mode("overwrite").parquet(f"{path}/plan_id={plan_id}")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All stored audit rows with their ``plan_id``."""
    return spark.read.schema(AUDIT_LOG).parquet(path)
