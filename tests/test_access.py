"""Access batches against handling the rows one by one."""

import datetime as dt
import random

import pyarrow as pa
import pytest

from trialloom import constants as C
from trialloom import schemas as S
from trialloom.operators import access
from trialloom.sources.registry import roles, small_table

NOW = dt.datetime(2026, 1, 1)


def people(spark, rows):
    full = [(i, name, name, f"{name}@x", role, status, None, None, None, None, None, None, None) for i, name, role, status in rows]
    return small_table(spark, S.TABLES["app_user"], full)


def stored(spark, rows):
    full = [(i, "N", mail, name, role, "", status, None, None, None, None) for i, name, mail, role, status in rows]
    return small_table(spark, S.TABLES["app_user_request"], full)


USERS = [(1, "root", 4, "active"), (2, "Rev", 3, "active"), (3, "old", 4, "inactive")]


@pytest.mark.parametrize("seed", range(3))
def test_first_claims_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(p, f"u{rng.randrange(8)}", f"m{rng.randrange(8)}") for p in range(1, 25)]
    df = spark.createDataFrame(pa.table({"position": [r[0] for r in rows], "u": [r[1] for r in rows], "m": [r[2] for r in rows]}))
    held, expected = set(), []
    for position, u, m in rows:
        if ("u", u) not in held and ("m", m) not in held:
            held |= {("u", u), ("m", m)}
            expected.append(position)
    assert sorted(r.position for r in access.first_claims(df, ["u", "m"]).collect()) == expected


def one_by_one(rows):
    held, winners = set(), []
    for position, *values in sorted(rows):
        claims = {(i, v) for i, v in enumerate(values) if v is not None}
        if claims and not claims & held:
            held |= claims
            winners.append(position)
    return winners


def claimed(spark, rows):
    names = ["u", "m", "r"][: len(rows[0]) - 1]
    table = {"position": pa.array([r[0] for r in rows], pa.int64())}
    table |= {n: pa.array([r[i + 1] for r in rows], pa.string()) for i, n in enumerate(names)}
    return sorted(r.position for r in access.first_claims(spark.createDataFrame(pa.table(table)), names).collect())


def chain(first, length, turn=False):
    """Requests of which each shares one key with the next; ``turn`` starts with the other kind of key."""
    rows = []
    for i in range(length):
        left, right = f"{first}-{(i + 1) // 2}", f"{first}-{i // 2}"
        rows.append((first + i, right, left) if turn else (first + i, left, right))
    return rows


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    steps = []
    plain = access.stage
    monkeypatch.setattr(access, "stage", lambda df, name: steps.append(name) or plain(df, name))
    rows = chain(1, 10_000)
    assert claimed(spark, rows) == one_by_one(rows) == list(range(1, 10_001, 2))
    assert len(steps) <= 20


def test_chains_that_meet_and_part(spark):
    """Two chains end in one row, which starts a third; a hot key crosses them; some keys are missing."""
    one, other = chain(1, 41), chain(1001, 30, turn=True)
    joint = [(2000, one[-1][1], other[-1][2])]
    rest = [(2001 + i, joint[0][1] if i == 0 else f"z{i}", f"z{i + 1}") for i in range(20)]
    links = [(2100 + i, f"z{i + 1}", f"z{i + 1}") for i in range(20)]
    hot = [(3000 + i, "hot", one[i][2] if i % 3 else None) for i in range(40)] + [(3100, None, None)]
    rows = one + other + joint + rest + links + hot
    assert claimed(spark, rows) == one_by_one(rows)


@pytest.mark.parametrize("seed", range(2))
def test_sparse_and_sorted_keys_against_one_by_one(spark, seed):
    """Key numbers that follow the position make long chains of every shape; three kinds of key."""
    rng = random.Random(100 + seed)
    near = lambda p, spread: f"k{p // 2 + rng.randrange(spread)}" if rng.random() < 0.9 else None
    rows = [(p, near(p, 1 + seed), near(p + 1, 2), near(p, 40) if seed % 2 else f"r{p}") for p in range(1, 120)]
    assert claimed(spark, rows) == one_by_one(rows)


def test_a_loser_claims_nothing(spark):
    df = spark.createDataFrame(pa.table({"position": [1, 2, 3], "u": ["a", "a", "b"], "m": ["x", "y", "y"]}))
    assert sorted(r.position for r in access.first_claims(df, ["u", "m"]).collect()) == [1, 3]


def test_triage(spark):
    new = [
        (1, " ", "a@x", "a", "reviewer"), (2, "A", None, "a", "reviewer"), (3, "A", "a@x", " ", "reviewer"),
        (4, "A", "a@x", "a", "admin"), (5, "A", "z@x", "ROOT ", "reviewer"), (6, "A", "REV@X", "z", "reviewer"),
        (7, "A", "Wait@x", "z", "reviewer"), (8, " A ", " a@x ", " Al ", " Registrant "), (9, "B", "b@x", "al", "reviewer"),
        (10, "C", "b@x", "c", "reviewer"),
    ]
    frame = spark.createDataFrame(pa.table({
        "position": [r[0] for r in new], "full_name": [r[1] for r in new], "email": [r[2] for r in new],
        "requested_username": [r[3] for r in new], "requested_role": [r[4] for r in new], "request_reason": [None] * 9 + ["why"],
    }).cast(pa.schema([("position", pa.int64())] + [(n, pa.string()) for n in ("full_name", "email", "requested_username", "requested_role", "request_reason")])))
    requests = stored(spark, [(7, "w", "wait@x", "reviewer", "pending"), (8, "al", "q@x", "reviewer", "rejected")])
    outcomes, after = access.triage_requests(frame, people(spark, USERS), requests, NOW)
    got = {r.position: (r.success, r.request_id, r.message) for r in outcomes.collect()}
    refused = lambda m: (False, None, m)
    assert got == {
        1: refused(C.MSG_NAME_REQUIRED), 2: refused(C.MSG_EMAIL_REQUIRED), 3: refused(C.MSG_USERNAME_REQUIRED),
        4: refused(C.MSG_ROLE_INVALID), 5: refused(C.MSG_USER_EXISTS), 6: refused(C.MSG_USER_EXISTS),
        7: refused(C.MSG_REQUEST_EXISTS), 8: (True, 16, C.MSG_REQUEST_CREATED), 9: refused(C.MSG_REQUEST_EXISTS),
        10: (True, 18, C.MSG_REQUEST_CREATED),
    }
    created = {r.id: r for r in after.collect()}
    assert len(created) == 4
    assert (created[16].full_name, created[16].email, created[16].requested_username, created[16].requested_role, created[16].request_reason) == (
        "A", "a@x", "Al", "registrant", "")
    assert created[18].request_reason == "why" and created[18].request_status == "pending" and created[18].created_at == NOW


REQUESTS = [
    (1, "ann", "ann@x", "reviewer", "pending"), (2, "bob", "bob@x", "registrant", "pending"),
    (3, "REV", "n@x", "reviewer", "pending"), (4, "cid", "cid@x", "auditor", "pending"),
    (5, "dan", "dan@x", "reviewer", "approved"), (6, "eve", "BOB@x", "reviewer", "pending"),
]


def decisions(spark, rows):
    schema = pa.schema([("position", pa.int64()), ("request_id", pa.int64()), ("admin_user_id", pa.int64()), ("review_comment", pa.string())])
    return spark.createDataFrame(pa.table({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema))


DECISIONS = [
    (1, None, 1, None), (2, 1, None, None), (3, 1, 2, None), (4, 1, 3, None), (5, 9, 1, None), (6, 5, 1, None), (7, 4, 1, None),
    (8, 3, 1, None), (9, 1, 1, "ok"), (10, 1, 1, None), (11, 2, 1, None), (12, 6, 1, None),
]


def test_approvals(spark):
    outcomes, users, requests = access.apply_approvals(
        decisions(spark, DECISIONS), stored(spark, REQUESTS), people(spark, USERS), roles(spark), NOW
    )
    got = {r.position: (r.new_user_id, r.message) for r in outcomes.collect()}
    assert got == {
        1: (None, C.MSG_REQUEST_ID_REQUIRED), 2: (None, C.MSG_ADMIN_ID_REQUIRED), 3: (None, C.MSG_ONLY_ADMIN_APPROVES),
        4: (None, C.MSG_ONLY_ADMIN_APPROVES), 5: (None, C.MSG_NOT_PENDING), 6: (None, C.MSG_NOT_PENDING),
        7: (None, C.MSG_ROLE_INACTIVE), 8: (None, C.MSG_SAME_USER), 9: (12, C.MSG_APPROVED), 10: (None, C.MSG_NOT_PENDING),
        11: (14, C.MSG_APPROVED), 12: (None, C.MSG_SAME_USER),
    }
    new = {r.id: r for r in users.filter("id > 3").collect()}
    assert {i: (u.username, u.role_id, u.user_status, u.approved_by) for i, u in new.items()} == {
        12: ("ann", 3, "active", 1), 14: ("bob", 2, "active", 1)
    }
    status = {r.id: (r.request_status, r.reviewed_by, r.review_comment) for r in requests.collect()}
    assert status[1] == ("approved", 1, "Approved") and status[2][0] == "approved" and status[6] == ("pending", None, None)
    assert status[5] == ("approved", None, None)


def test_rejections(spark):
    outcomes, requests = access.apply_rejections(
        decisions(spark, DECISIONS), stored(spark, REQUESTS), people(spark, USERS), roles(spark), NOW
    )
    got = {r.position: r.message for r in outcomes.collect()}
    assert got[3] == C.MSG_ONLY_ADMIN_REJECTS and got[6] == C.MSG_NOT_PENDING
    assert [p for p, m in sorted(got.items()) if m == C.MSG_REJECTED] == [7, 8, 9, 11, 12]
    assert got[10] == C.MSG_NOT_PENDING
    status = {r.id: (r.request_status, r.review_comment) for r in requests.collect()}
    assert status[1] == ("rejected", "ok") and status[4] == ("rejected", "") and status[5] == ("approved", None)
