import random
from datetime import datetime, timedelta

import pytest

from ticketmill.operators.carry import carry_forward, in_blocks
from ticketmill.plans import roster
from ticketmill.sources.schemas import INVITED_USERS, ROSTER_COMMANDS

DAY0 = datetime(2024, 1, 1)
DOMAIN = "corp.example"


def replay(commands, start):
    """The state machine as a plain loop over one user's commands."""
    users, rejects = {u["email"]: dict(u) for u in start}, []
    for c in sorted(commands, key=lambda c: (c["email"].lower().strip(), c["seq"])):
        email = c["email"].lower().strip()
        user, cmd, reason = users.get(email), c["cmd"], None
        if cmd in ("invite", "set_role") and c["role"] not in ("Agent", "Supervisor"):
            reason = "invalid_role"
        elif cmd == "invite" and not email.endswith("@" + DOMAIN):
            reason = "domain_not_allowed"
        elif cmd == "set_status" and c["status"] not in ("pending", "active", "revoked"):
            reason = "invalid_status"
        elif cmd == "accept" and not (c["token"] or "").strip():
            reason = "empty_token"
        elif cmd not in ("invite", "set_role", "set_status", "accept"):
            reason = "unknown_command"
        elif cmd in ("set_status", "set_role") and user is None:
            reason = "unknown_user"
        elif cmd == "accept" and (user is None or user["token"] is None or user["token"] != c["token"].strip()):
            reason = "invalid_token"
        elif cmd == "accept" and user["token_expires_at"] and user["token_expires_at"] < c["cmd_at"]:
            reason = "token_expired"
        if reason:
            rejects.append((email, c["seq"], cmd, reason))
            continue
        if cmd == "invite":
            if user is None:
                user = users[email] = {"email": email, "status": "pending", "created_at": c["cmd_at"]}
            if user["status"] == "revoked":
                user["status"] = "pending"
            user |= {
                "role": c["role"],
                "token": c["token"],
                "invited_by": c["actor"],
                "token_expires_at": c["cmd_at"] + timedelta(days=7),
            }
        elif cmd == "accept":
            user |= {"status": "active", "token": None, "token_expires_at": None}
        elif cmd == "set_status":
            user["status"] = c["status"]
            if c["status"] == "revoked":
                user |= {"token": None, "token_expires_at": None}
        elif user["role"] == c["role"]:
            continue
        else:
            user["role"] = c["role"]
        user["updated_at"] = c["cmd_at"]
    names = INVITED_USERS.fieldNames()
    return {tuple(u[n] for n in names) for u in users.values()}, set(rejects)


def random_log(rng, n, emails, order):
    for seq in rng.sample(range(order), n):
        yield {
            "email": rng.choice(emails),
            "seq": seq,
            "cmd": rng.choice(["invite", "invite", "accept", "accept", "accept", "set_role", "set_status", "drop"]),
            "role": rng.choice(["Agent", "Supervisor", "Supervisor", "Boss", None]),
            "status": rng.choice(["pending", "active", "revoked", "gone", None]),
            "token": rng.choice(["t1", "t1 ", "t2", " ", None]),
            "cmd_at": DAY0 + timedelta(hours=rng.randrange(24 * 20)),
            "actor": rng.choice(["x@corp.example", None]),
        }


EMAILS = ["Hot@Corp.example", "hot@corp.example ", "b@corp.example", "c@corp.example", "d@other.example"]


@pytest.mark.parametrize("span,order", [(1, 400), (3, 400), (50, 400), (1 << 16, 10**9)])
def test_replay_equals_the_state_machine(spark, span, order):
    rng = random.Random(span)
    log = list(random_log(rng, 300, EMAILS, order))
    start = [
        {
            "email": email,
            "role": "Agent",
            "status": status,
            "invited_by": "y@corp.example",
            "token": token,
            "token_expires_at": expires,
            "created_at": DAY0 - timedelta(days=9),
            "updated_at": DAY0 - timedelta(days=3),
        }
        for email, status, token, expires in [
            ("b@corp.example", "revoked", None, None),
            ("d@other.example", "active", "t1", None),
            ("quiet@corp.example", "pending", "t2", DAY0),
        ]
    ]
    commands = spark.createDataFrame([tuple(c[n] for n in ROSTER_COMMANDS.fieldNames()) for c in log], ROSTER_COMMANDS)
    seeds = spark.createDataFrame([tuple(u.values()) for u in start], INVITED_USERS)
    for with_start in (False, True):
        users, rejects = replay(log, start if with_start else [])
        before = seeds if with_start else None
        got = roster.replay_roster(commands, before, DOMAIN, span)
        assert {tuple(r) for r in got.select(*INVITED_USERS.fieldNames()).collect()} == users
        assert {tuple(r) for r in roster.roster_rejects(commands, before, DOMAIN, span).collect()} == rejects


@pytest.mark.parametrize("domain", [None, DOMAIN])
def test_commands_without_an_email_are_rejected(spark, domain):
    """Accepted and rejected commands are all commands; nobody without an e-mail is on the roster."""
    rng = random.Random(4)
    log = list(random_log(rng, 200, [*EMAILS, None, "", "  ", "noat"], 400))
    commands = spark.createDataFrame([tuple(c[n] for n in ROSTER_COMMANDS.fieldNames()) for c in log], ROSTER_COMMANDS)
    rejects = roster.roster_rejects(commands, None, domain).collect()
    assert len({r.seq for r in rejects}) == len(rejects)
    nameless = {c["seq"] for c in log if "@" not in (c["email"] or "")}
    assert {r.seq for r in rejects if r.reason == "invalid_email"} == nameless and len(nameless) > 20
    accepted = roster.judge_commands(commands, None, domain).where("reason IS NULL").count()
    assert accepted + len(rejects) == len(log)
    assert all("@" in r.email for r in roster.replay_roster(commands, None, domain).collect())


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_carry_forward_finds_the_last_value(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice("ab"), seq, rng.choice([None, None, seq])) for seq in rng.sample(range(-60, 60), 80)]
    frame = spark.createDataFrame(rows, "k STRING, seq BIGINT, v BIGINT")
    got = {(r.k, r.seq): r.prior_v for r in carry_forward(in_blocks(frame, "seq", span), "k", "seq", ["v"], span).collect()}
    for k, seq, _ in rows:
        earlier = [v for key, s, v in rows if key == k and s < seq and v is not None]
        assert got[(k, seq)] == (max(earlier) if earlier else None)


def test_listing_and_invitations(spark):
    users = spark.createDataFrame(
        [
            ("a@x", "Agent", "pending", None, "t", DAY0, DAY0, DAY0),
            ("b@x", "Agent", "pending", None, "t", None, None, DAY0),
            ("c@x", "Agent", "active", None, None, None, DAY0 + timedelta(days=1), DAY0),
            ("d@x", "Agent", "active", None, "t", DAY0 + timedelta(days=1), DAY0, DAY0),
        ],
        INVITED_USERS,
    )
    listed = roster.list_roster(users)
    assert [r.email for r in listed.collect()] == ["b@x", "c@x", "a@x", "d@x"]
    assert "token" not in listed.columns
    got = {r.email: r.expired for r in roster.invite_status(users, DAY0 + timedelta(seconds=1)).collect()}
    assert got == {"a@x": True, "b@x": False, "d@x": False}
    assert not any(r.expired for r in roster.invite_status(users, DAY0).collect())
