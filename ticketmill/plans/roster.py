"""Roster of invited users, replayed from a log of commands.

A command log has ``email, seq, cmd, role, status, token, cmd_at, actor`` with
``seq`` unique per e-mail. The rules of each command need only three facts from
earlier commands: the last event that set or cleared the token, the last role,
and whether the token was used since. Those are carried forward block by block
(``carry_forward``), so a single e-mail may hold most of the log; the roster is
then a plain aggregate over judged commands.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.access import ROLES, STATUSES, email_in_domain, is_email, normalize_email
from ticketmill.functions.text import strip
from ticketmill.functions.timecalc import ntz_literal
from ticketmill.operators.carry import DEFAULT_SPAN, carry_forward, in_blocks
from ticketmill.session import scratch_path, staged

INVITATION_LIFE = timedelta(days=7)  # fixed value

SEED_SEQ = -(2**63)  # before every command

# Reasons a command is rejected.
INVALID_EMAIL = "invalid_email"
UNKNOWN_COMMAND = "unknown_command"
INVALID_ROLE = "invalid_role"
INVALID_STATUS = "invalid_status"
DOMAIN_NOT_ALLOWED = "domain_not_allowed"
EMPTY_TOKEN = "empty_token"
INVALID_TOKEN = "invalid_token"
TOKEN_EXPIRED = "token_expired"
UNKNOWN_USER = "unknown_user"


def _names_a_user() -> Column:
    """Commands without an e-mail belong to nobody's history and must not gather under one empty key."""
    return is_email(F.col("email")) | (F.col("cmd") == "seed")


def _with_start(commands: DataFrame, start: DataFrame | None) -> DataFrame:
    """The log with normalised text and a starting roster as ``seed`` rows before it."""
    log = commands.select(
        normalize_email(F.col("email")).alias("email"),
        "seq",
        "cmd",
        "role",
        "status",
        F.when(F.col("cmd") == "accept", strip(F.col("token"))).otherwise(F.col("token")).alias("token"),
        "cmd_at",
        "actor",
        F.when(F.col("cmd") == "invite", F.col("cmd_at") + F.lit(INVITATION_LIFE)).alias("expires_at"),
        F.col("cmd_at").alias("created_at"),
    )
    if start is None:
        return log
    seeds = start.select(
        normalize_email(F.col("email")).alias("email"),
        F.lit(SEED_SEQ).cast("bigint").alias("seq"),
        F.lit("seed").alias("cmd"),
        "role",
        "status",
        "token",
        F.col("updated_at").alias("cmd_at"),
        F.col("invited_by").alias("actor"),
        F.col("token_expires_at").alias("expires_at"),
        "created_at",
    )
    return log.unionByName(seeds)


def _fault_of_command(domain: str | None) -> Column:
    """What is wrong with a command on its own, without looking at earlier ones."""
    cmd = F.col("cmd")
    bad_role = ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    bad_status = ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    other_domain = F.lit(False) if domain is None else ~email_in_domain(F.col("email"), domain)
    return (
        F.when(cmd == "seed", None)
        .when(cmd.isin("invite", "set_role") & bad_role, F.lit(INVALID_ROLE))
        .when((cmd == "invite") & other_domain, F.lit(DOMAIN_NOT_ALLOWED))
        .when((cmd == "set_status") & bad_status, F.lit(INVALID_STATUS))
        .when((cmd == "accept") & (F.coalesce(F.col("token"), F.lit("")) == ""), F.lit(EMPTY_TOKEN))
        .when(~F.coalesce(cmd.isin("invite", "accept", "set_status", "set_role"), F.lit(False)), F.lit(UNKNOWN_COMMAND))
    )


def _staged_log(commands: DataFrame, start: DataFrame | None) -> DataFrame:
    """The log as later passes read it, more than once; so the commands themselves are read once."""
    return staged(_with_start(commands, start), scratch_path(commands.sparkSession, "roster-log"))


def _with_state(log: DataFrame, domain: str | None, span: int) -> DataFrame:
    """Every command that names a user, with what earlier ones left behind.

    Adds ``known`` (the user exists), ``issued`` (the last event that set or
    cleared the token), ``matches`` and ``expired`` (an accept fits that token,
    or comes too late), ``same_role``, and ``refused``: why the command is
    rejected, apart from an accept's token.
    """
    cmd, seq = F.col("cmd"), F.col("seq")
    rows = in_blocks(log.where(_names_a_user()), "seq", span).withColumn("fault", _fault_of_command(domain))
    sound = F.col("fault").isNull()
    makes_user = sound & cmd.isin("invite", "seed")
    sets_token = makes_user | (sound & (cmd == "set_status") & (F.col("status") == "revoked"))
    token_state = F.struct(
        seq.alias("seq"),
        F.when(makes_user, F.col("token")).alias("token"),
        F.when(makes_user, F.col("expires_at")).alias("expires_at"),
    )
    rows = rows.withColumns(
        {
            "token_state": F.when(sets_token, token_state),
            "role_state": F.when(makes_user | (sound & (cmd == "set_role")), F.col("role")),
            "user_state": F.when(makes_user, F.lit(True)),
        }
    )
    rows = carry_forward(rows, "email", "seq", ["token_state", "role_state", "user_state"], span)

    known = F.coalesce("prior_user_state", F.lit(False))
    issued = F.col("prior_token_state")
    needs_user = cmd.isin("set_status", "set_role")
    return rows.withColumns(
        {
            "known": known,
            "issued": issued,
            "matches": sound & known & (cmd == "accept") & F.coalesce(F.col("token") == issued["token"], F.lit(False)),
            "expired": F.coalesce(issued["expires_at"] < F.col("cmd_at"), F.lit(False)),
            "same_role": (cmd == "set_role") & F.coalesce(F.col("role") == F.col("prior_role_state"), F.lit(False)),
            "refused": F.coalesce(F.col("fault"), F.when(needs_user & ~known, F.lit(UNKNOWN_USER))),
        }
    )


def judge_commands(
    commands: DataFrame, start: DataFrame | None = None, domain: str | None = None, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Every command (and seed row) with ``reason``, NULL when it is accepted."""
    log = _staged_log(commands, start)
    rows = _with_state(log, domain, span)
    accept = F.col("cmd") == "accept"
    rows = rows.withColumn("used_state", F.when(F.col("matches") & ~F.col("expired"), F.col("issued.seq")))
    rows = staged(rows.drop("token_state", "role_state", "user_state"), scratch_path(rows.sparkSession, "roster-judged"))
    # The token is gone when an earlier accept succeeded against the same invitation.
    rows = carry_forward(rows, "email", "seq", ["used_state"], span)
    used = F.coalesce(F.col("prior_used_state") == F.col("issued.seq"), F.lit(False))
    reason = F.coalesce(
        F.col("refused"),
        F.when(accept & (~F.col("matches") | used), F.lit(INVALID_TOKEN)),
        F.when(accept & F.col("expired"), F.lit(TOKEN_EXPIRED)),
    )
    columns = ["email", "seq", "cmd", "role", "status", "token", "cmd_at", "actor"]
    nobody = log.where(~_names_a_user()).select(*columns, F.lit(INVALID_EMAIL).alias("reason"))
    return rows.select(*columns, reason.alias("reason")).unionByName(nobody)


def replay_roster(
    commands: DataFrame, start: DataFrame | None = None, domain: str | None = None, span: int = DEFAULT_SPAN
) -> DataFrame:
    """The roster after all commands, one row per user.

    Commands are first aggregated per user and issued token: of the accepts that
    fit a token, the first one in time succeeds. Then the tokens of a user are
    merged. The latest of several events is the largest struct that starts with
    its ``seq``, so both steps are plain maxima with a partial step.
    """
    cmd, seq = F.col("cmd"), F.col("seq")
    rows = _with_state(_staged_log(commands, start), domain, span)
    done = F.col("refused").isNull() & (cmd != "accept")
    makes_user = done & cmd.isin("invite", "seed")
    sets_status = done & cmd.isin("seed", "set_status")
    sets_token = makes_user | (done & (cmd == "set_status") & (F.col("status") == "revoked"))
    succeeds = F.col("matches") & ~F.col("expired")

    def event(at: Column, **values: Column) -> Column:
        return F.struct(at.alias("seq"), *[value.alias(name) for name, value in values.items()])

    def latest(where: Column, **values: Column) -> Column:
        return F.max(F.when(where, event(seq, **values)))

    per_token = rows.groupBy("email", F.col("issued.seq").alias("issued_seq")).agg(
        latest(makes_user | (done & (cmd == "set_role")), role=F.col("role")).alias("role_set"),
        latest(sets_status, status=F.col("status")).alias("status_set"),
        latest(
            sets_token,
            token=F.when(makes_user, F.col("token")),
            expires_at=F.when(makes_user, F.col("expires_at")),
        ).alias("token_set"),
        latest(makes_user, actor=F.col("actor")).alias("invited"),
        F.max(F.when(done & (cmd == "invite"), seq)).alias("invited_seq"),
        F.min(F.when(makes_user, event(seq, created_at=F.col("created_at")))).alias("created"),
        latest(done & ~F.col("same_role"), cmd_at=F.col("cmd_at")).alias("updated"),
        F.min(F.when(succeeds, event(seq, cmd_at=F.col("cmd_at")))).alias("accepted"),
    )
    accepted = F.col("accepted")

    def or_accepted(name: str, **values: Column) -> Column:
        return F.greatest(F.col(name), F.when(accepted.isNotNull(), event(accepted["seq"], **values)))

    per_user = per_token.groupBy("email").agg(
        F.max("role_set").alias("role_set"),
        F.max(or_accepted("status_set", status=F.lit("active"))).alias("status_set"),
        F.max(
            or_accepted(
                "token_set", token=F.lit(None).cast("string"), expires_at=F.lit(None).cast("timestamp_ntz")
            )
        ).alias("token_set"),
        F.max("invited").alias("invited"),
        F.max("invited_seq").alias("invited_seq"),
        F.min("created").alias("created"),
        F.max(or_accepted("updated", cmd_at=accepted["cmd_at"])).alias("updated"),
    )
    set_to = F.col("status_set.status")
    invited_since = F.coalesce(F.col("invited_seq") > F.col("status_set.seq"), F.col("invited_seq").isNotNull())
    renewed = invited_since & F.coalesce(set_to == "revoked", F.lit(True))
    return per_user.where(F.col("created").isNotNull()).select(
        "email",
        F.col("role_set.role").alias("role"),
        F.when(renewed, F.lit("pending")).otherwise(set_to).alias("status"),
        F.col("invited.actor").alias("invited_by"),
        F.col("token_set.token").alias("token"),
        F.col("token_set.expires_at").alias("token_expires_at"),
        F.col("created.created_at").alias("created_at"),
        F.col("updated.cmd_at").alias("updated_at"),
    )


def roster_rejects(
    commands: DataFrame, start: DataFrame | None = None, domain: str | None = None, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Rejected commands with their reason. Every command is either here or applied to the roster."""
    judged = judge_commands(commands, start, domain, span)
    return judged.where(F.col("reason").isNotNull()).select("email", "seq", "cmd", "reason")


def list_roster(users: DataFrame) -> DataFrame:
    """All users without their token, newest first; users with no creation time come first."""
    shown = ["email", "role", "status", "invited_by", "token_expires_at", "created_at", "updated_at"]
    return users.select(*shown).orderBy(F.col("created_at").desc_nulls_first(), F.col("email").asc())


def invite_status(users: DataFrame, now) -> DataFrame:
    """Users with an open invitation and whether it has expired at ``now`` (wall-clock)."""
    expired = F.coalesce(F.col("token_expires_at") < ntz_literal(now), F.lit(False))
    return users.where(F.col("token").isNotNull()).select(
        "email", "role", "status", "token_expires_at", expired.alias("expired")
    )
