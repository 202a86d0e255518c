import json

import pytest
from pyspark.sql import functions as F

from ticketmill.functions import access as fa
from ticketmill.plans import access
from ticketmill.sources.schemas import LOGIN_EVENTS, PROVIDER_GROUPS


@pytest.fixture(scope="module")
def users(spark):
    rows = [
        ("ann@x.example", "Supervisor", "active"),
        ("bob@x.example", "Agent", "active"),
        ("cid@x.example", "Agent", "pending"),
        ("eve@x.example", "Supervisor", "active"),
    ]
    return spark.createDataFrame(rows, "email STRING, role STRING, status STRING")


@pytest.fixture(scope="module")
def groups(spark):
    rows = [
        ("ANN@x.example", "u1", ["Agent", "Beta"]),
        ("bob@x.example", "u2", ["Agent"]),
        ("cid@x.example", "u3", ["Supervisor", "Agent"]),
        ("zoe@x.example", "u4", ["Agent"]),
    ]
    return spark.createDataFrame(rows, PROVIDER_GROUPS)


def test_email_functions(spark):
    frame = spark.createDataFrame([("  Ann@X.Example\t",), ("nobody",), (None,)], "email STRING")
    got = frame.select(
        fa.normalize_email(F.col("email")), fa.is_email(F.col("email")), fa.email_in_domain(fa.normalize_email(F.col("email")), "X.example")
    )
    assert [tuple(r) for r in got.collect()] == [("ann@x.example", True, True), ("nobody", False, False), (None, False, False)]


def test_effective_role_and_groups(spark):
    frame = spark.createDataFrame([(["b", "Supervisor", "a", "b"],), ([],), (None,)], "g ARRAY<STRING>")
    got = [tuple(r) for r in frame.select(fa.effective_role(F.col("g")), fa.groups_text(F.col("g"))).collect()]
    assert got == [("Supervisor", "Supervisor,a,b"), ("Agent", ""), ("Agent", None)]


def test_allowlist(spark, users):
    asked = spark.createDataFrame([(e,) for e in ["ANN@x.example ", "ann@x.example", "cid@x.example", "new@x.example", "junk", None, ""]], "email STRING")
    got = {tuple(r) for r in access.check_allowlist(asked, users).collect()}
    assert got == {
        ("ann@x.example", 2, True, "Supervisor", None),
        ("cid@x.example", 1, False, "Agent", None),
        ("new@x.example", 1, False, None, None),
        ("junk", 1, None, None, "invalid_email"),
        ("", 2, None, None, "invalid_email"),
    }


def test_authorize_keeps_every_request(spark, users):
    cases = [
        ("ann@x.example", "Agent", "ok"),
        ("ann@x.example", "Supervisor", "ok"),
        ("bob@x.example", "Agent", "ok"),
        ("bob@x.example", "Supervisor", "role_mismatch"),
        ("Bob@x.example", None, "ok"),
        ("cid@x.example", "Agent", "not_authorized"),
        ("new@x.example", None, "not_authorized"),
        (None, "Agent", "not_authorized"),
    ] * 7
    asked = spark.createDataFrame([(i, e, r) for i, (e, r, _) in enumerate(cases)], "request_id BIGINT, email STRING, required_role STRING")
    got = {r.request_id: r.outcome for r in access.authorize(asked, users).collect()}
    assert got == {i: outcome for i, (_, _, outcome) in enumerate(cases)}


def test_a_frequent_email_is_looked_up_by_a_plain_join(spark, users):
    """Half of all requests on one e-mail: no copies of the roster, and Spark may split the partition."""
    asked = spark.range(20000).selectExpr(
        "id AS request_id", "IF(id % 2 = 0, 'ann@x.example', concat('u', id, '@x.example')) AS email", "'Agent' AS required_role"
    )
    got = access.authorize(asked, users)
    assert got.where("outcome = 'ok'").count() == 10000 and got.count() == 20000
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_gates_are_passed_in_order(spark, users):
    cases = [
        ("ann@other.example", ["Supervisor"], "Agent", "domain_not_allowed"),
        (None, ["Agent"], None, "domain_not_allowed"),
        ("ann@x.example", ["Beta"], None, "group_missing"),
        ("ann@x.example", None, None, "group_missing"),
        ("cid@x.example", ["Agent"], None, "not_authorized"),
        ("new@x.example", ["Agent"], None, "not_authorized"),
        ("bob@x.example", ["Supervisor"], "Supervisor", "role_mismatch"),
        ("ann@x.example", ["Agent"], "Supervisor", "role_mismatch"),
        ("Ann@X.example", ["Beta", "Supervisor"], "Supervisor", "ok"),
        ("ann@x.example", ["Supervisor"], "Agent", "ok"),
        ("bob@x.example", ["Agent"], None, "ok"),
    ]
    rows = [(i, e, g, r) for i, (e, g, r, _) in enumerate(cases)]
    asked = spark.createDataFrame(rows, "request_id BIGINT, email STRING, groups ARRAY<STRING>, required_role STRING")
    got = {r.request_id: r.outcome for r in access.access_gate(asked, users, "x.example").collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_status_changes(spark, users, groups):
    rows = [
        ("ANN@x.example", 1, "active"),
        ("ann@x.example", 2, "revoked"),
        ("bob@x.example", 1, "pending"),
        ("cid@x.example", 1, "gone"),
        ("eve@x.example", 1, "revoked"),
        ("zoe@x.example", 1, "active"),
    ]
    asked = spark.createDataFrame(rows, "email STRING, seq BIGINT, target_status STRING")
    names = ("status_from", "status_to", "username", "account_action", "token_cleared", "tokens_revoked", "status")
    got = {r.email: tuple(r[n] for n in names) for r in access.plan_status_change(users, groups, asked).collect()}
    assert got == {
        "ann@x.example": ("active", "revoked", "u1", "disable", True, True, "ok"),
        "bob@x.example": ("active", "pending", "u2", "enable", False, False, "ok"),
        "cid@x.example": ("pending", "gone", None, None, False, False, "invalid_status"),
        "eve@x.example": ("active", "revoked", None, None, True, False, "cognito_user_not_found; DB updated"),
        "zoe@x.example": (None, "active", None, None, False, False, "user_not_in_DB"),
    }


def test_one_account_for_each_email(spark, users):
    rows = [("bob@x.example", "u9", ["Supervisor"]), ("BOB@x.example ", "u2", ["Agent"])]
    groups = spark.createDataFrame(rows, PROVIDER_GROUPS)
    drift = access.role_drift(users, groups).where("email = 'bob@x.example'").collect()
    assert [(r.username, r.accounts, r.in_sync) for r in drift] == [("u2", 2, True)]
    assert access.plan_role_sync(users, groups).count() == 4


def test_unknown_roles_are_refused(spark, users, groups):
    asked = spark.createDataFrame([("bob@x.example", 1, "Manager"), ("zoe@x.example", 1, "")], "email STRING, seq BIGINT, target_role STRING")
    assert plan_rows(access.plan_role_sync(users, groups, asked)) == {
        "bob@x.example": ("change", "Agent", "Agent", "u2", ["Agent"], False, False, False, "invalid_role"),
        "zoe@x.example": ("change:db-miss", None, None, None, [], False, False, False, "invalid_role"),
    }


def test_drift(users, groups):
    got = {r.email: (r.db_role, r.username, r.in_sync) for r in access.role_drift(users, groups).collect()}
    assert got == {
        "ann@x.example": ("Supervisor", "u1", False),
        "bob@x.example": ("Agent", "u2", True),
        "cid@x.example": ("Agent", "u3", True),
        "eve@x.example": ("Supervisor", None, True),
        "zoe@x.example": (None, "u4", False),
    }


def plan_rows(plan):
    names = ("action", "db_from", "db_to", "username", "groups_after", "db_changed", "groups_changed", "tokens_revoked", "status")
    return {r.email: tuple(r[n] for n in names) for r in plan.collect()}


def test_repair_plan(users, groups):
    assert plan_rows(access.plan_role_sync(users, groups)) == {
        "ann@x.example": ("repair", "Supervisor", "Supervisor", "u1", ["Beta", "Supervisor"], False, True, True, "ok"),
        "bob@x.example": ("repair", "Agent", "Agent", "u2", ["Agent"], False, False, False, "noop"),
        "cid@x.example": ("repair", "Agent", "Agent", "u3", ["Agent"], False, True, True, "ok"),
        "eve@x.example": ("repair:cognito-miss", "Supervisor", "Supervisor", None, [], False, False, False, "cognito_user_not_found"),
    }


def test_change_plan_and_audit(spark, users, groups):
    rows = [
        ("ann@x.example", 1, "Supervisor"),
        ("ANN@x.example", 2, "Agent"),
        ("bob@x.example", 1, "Agent"),
        ("eve@x.example", 1, "Agent"),
        ("zoe@x.example", 1, "Agent"),
        ("cid@x.example", 1, "Agent"),
        ("cid@x.example", 2, None),
        ("out@x.example", 1, None),
    ]
    asked = spark.createDataFrame(rows, "email STRING, seq BIGINT, target_role STRING")
    plan = access.plan_role_sync(users, groups, asked, force_logout=False)
    assert plan_rows(plan) == {
        "ann@x.example": ("change", "Supervisor", "Agent", "u1", ["Agent", "Beta"], True, False, False, "ok"),
        "bob@x.example": ("change", "Agent", "Agent", "u2", ["Agent"], False, False, False, "noop"),
        "cid@x.example": ("repair", "Agent", "Agent", "u3", ["Agent"], False, True, False, "ok"),
        "eve@x.example": ("change:cognito-miss", "Supervisor", "Agent", None, [], True, False, False, "cognito_user_not_found; DB updated"),
        "zoe@x.example": ("change:db-miss", None, "Agent", None, [], False, False, False, "user_not_in_DB"),
        "out@x.example": ("repair:db-miss", None, None, None, [], False, False, False, "user_not_in_DB"),
    }
    audit = access.audit_rows(plan, "root@x.example")
    assert audit.columns == LOGIN_EVENTS.fieldNames()
    eve = audit.where("email = 'eve@x.example'").first()
    assert (eve.provider_sub, eve.result, eve.user_agent, eve.ip, eve.groups) == ("admin:roles", "allowed", "admin:root@x.example", None, [])
    assert json.loads(eve.reason) == {
        "action": "change:cognito-miss",
        "db_from": "Supervisor",
        "db_to": "Agent",
        "cognito_username": None,
        "cognito_after": [],
        "tokens_revoked": False,
        "status": "cognito_user_not_found; DB updated",
    }


def test_a_plan_is_recorded_once(spark, users, groups, tmp_path):
    path = str(tmp_path / "audit")
    rows = access.audit_rows(access.plan_role_sync(users, groups), "root@x.example")
    for plan_id in ("p1", "p2", "p1"):
        access.write_audit(rows, path, plan_id)
    assert {r.plan_id: r["count"] for r in access.read_audit(spark, path).groupBy("plan_id").count().collect()} == {"p1": 4, "p2": 4}
    access.write_audit(rows.where("email IS NULL"), path, "p1")
    assert access.read_audit(spark, path).where("plan_id = 'p1'").count() == 0
    assert access.read_audit(spark, path).columns == [*LOGIN_EVENTS.fieldNames(), "plan_id"]
    for bad in ("", "a/b", "..", "a=b c"):
        with pytest.raises(ValueError, match="plan id"):
            access.write_audit(rows, path, bad)
