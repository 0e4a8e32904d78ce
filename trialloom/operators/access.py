"""Access requests, decided in batches.

The registry handles one request at a time; a batch here gives exactly what
handling its rows one after the other (by ``position``) would give.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..staging import stage


def role_allows(role: Column, required: Column) -> Column:
    """May ``role`` do what ``required`` asks for? Nothing required: yes; an admin may do all."""
    role, required = F.trim(role), F.coalesce(F.trim(required), F.lit(""))
    return F.coalesce((required == "") | (role == required) | (role == C.ADMIN_ROLE), F.lit(False))


def _chained(judged: DataFrame) -> DataFrame:
    """Winners among rows that wait for one other row only, however long the chain of such rows.

    ``judged`` has one row per claim: position, key, the key's earliest claim.
    A row that is second on some keys, first on all others and always behind the
    same row wins exactly if that row loses. Pointer jumping follows these links
    to the row where the chain starts, twice as far in each step, and keeps
    whether the number of links is odd. A chain that starts at a row which leads
    all its keys is settled by that; one that starts at a row with several rows
    before it waits. A row is the only predecessor of at most one row per key.
    """
    behind = judged.filter(F.col("position") > F.col("earliest"))
    second = behind.groupBy("key").agg(F.min("position").alias("second"))
    waits = F.col("position") > F.col("earliest")
    placed = judged.join(second, "key", "left").groupBy("position").agg(
        F.min(F.when(waits, F.col("earliest"))).alias("low"),
        F.max(F.when(waits, F.col("earliest"))).alias("high"),
        F.max(F.coalesce(F.col("position") > F.col("second"), F.lit(False))).alias("is_later"),
    )
    placed = stage(placed, "placed")
    single = placed.filter(~F.col("is_later") & (F.col("low") == F.col("high")))
    links = single.select("position", F.col("low").alias("start"), F.lit(True).alias("odd"), F.lit(True).alias("moved"))
    while not links.filter("moved").isEmpty():
        for _ in range(2):
            further = links.select(
                F.col("position").alias("start"), F.col("start").alias("far"), F.col("odd").alias("far_odd")
            )
            links = links.join(further, "start", "left").select(
                "position",
                F.coalesce("far", "start").alias("start"),
                (F.col("odd") != F.coalesce("far_odd", F.lit(False))).alias("odd"),
                F.col("far").isNotNull().alias("moved"),
            )
        links = stage(links, "links")
    leads = placed.filter(F.col("low").isNull()).select(F.col("position").alias("start"))
    return links.filter(~F.col("odd")).join(leads, "start", "left_semi").select("position")


def first_claims(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positions that win when rows claim all their keys one after the other.

    A row wins if no earlier winner holds one of its keys. A loser claims
    nothing, so "the earliest row per key" would be wrong: with (a, x), (a, y),
    (b, y) the third wins because the second lost. Per round, rows that are the
    earliest open ones for all their keys win and rows that share a key with them
    lose; rounds repeat on the undecided rest (one round if no keys collide).
    From the second round on, chains of rows that each wait for one other row are
    settled whole (``_chained``), so the number of rounds follows how often chains
    meet, not how long they are. A row without any key claims nothing and is left out.
    """
    claims = rows.select(
        "position",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("key"),
    ).filter(F.col("key.value").isNotNull())
    open_claims = stage(claims, "claims")
    winners: list[DataFrame] = []
    while not open_claims.isEmpty():
        earliest = open_claims.groupBy("key").agg(F.min("position").alias("earliest"))
        judged = open_claims.join(earliest, "key").withColumn("leads", F.col("position") == F.col("earliest"))
        won = judged.groupBy("position").agg(F.min("leads").alias("wins")).filter("wins").select("position")
        won = stage(won.unionByName(_chained(judged)) if winners else won, "won")
        winners.append(won)
        taken = open_claims.join(won, "position", "left_semi").select("key").distinct()
        lost = open_claims.join(taken, "key", "left_semi").select("position").distinct()
        open_claims = stage(open_claims.join(lost, "position", "left_anti"), "claims")
    if not winners:
        return rows.select("position").limit(0)
    return reduce(DataFrame.unionByName, winners)


def _flag(df: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """Add boolean ``name``: the row's ``key`` occurs in ``found`` (one column, distinct)."""
    marked = found.distinct().withColumn(f"_{name}", F.lit(True))
    return df.join(marked, key, "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")


def _with_taken(df: DataFrame, people: DataFrame, username: str, name: str) -> DataFrame:
    """Add ``name``: someone in ``people`` has the row's username or e-mail, letter case aside.

    Two equi joins; one join on an OR of both would compare all with all.
    """
    users = people.select(F.lower(username).alias("username_key")).filter(F.col("username_key").isNotNull())
    emails = people.select(F.lower("email").alias("email_key")).filter(F.col("email_key").isNotNull())
    df = _flag(_flag(df, users, "username_key", f"{name}_name"), emails, "email_key", f"{name}_email")
    return df.withColumn(name, F.col(f"{name}_name") | F.col(f"{name}_email")).drop(f"{name}_name", f"{name}_email")


def _won(df: DataFrame, open_rows: Column, keys: list[str]) -> DataFrame:
    candidates = stage(df.filter(open_rows).select("position", *keys), "candidates")
    return _flag(df, first_claims(candidates, keys), "position", "won")


def _highest(table: DataFrame) -> Column:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("highest")).scalar()


def triage_requests(
    new: DataFrame, users: DataFrame, requests: DataFrame, batch_time: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, all requests): each new request accepted as pending or refused.

    ``new``: position, full_name, email, requested_username, requested_role,
    request_reason. The first rule that fails gives the message.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    role = F.lower(F.trim(F.coalesce("requested_role", F.lit(""))))
    keyed = new.withColumn("username_key", F.lower(F.trim("requested_username"))).withColumn(
        "email_key", F.lower(F.trim("email"))
    )
    pending = requests.filter(F.col("request_status") == "pending")
    keyed = _with_taken(keyed, users, "username", "is_user")
    keyed = _with_taken(keyed, pending, "requested_username", "is_pending")
    checked = stage(
        keyed.withColumn(
            "refusal",
            F.when(blank(F.col("full_name")), C.MSG_NAME_REQUIRED)
            .when(blank(F.col("email")), C.MSG_EMAIL_REQUIRED)
            .when(blank(F.col("requested_username")), C.MSG_USERNAME_REQUIRED)
            .when(~role.isin(*C.REQUESTABLE_ROLES), C.MSG_ROLE_INVALID)
            .when(F.col("is_user"), C.MSG_USER_EXISTS)
            .when(F.col("is_pending"), C.MSG_REQUEST_EXISTS),
        ),
        "triage",
    )
    judged = _won(checked, F.col("refusal").isNull(), ["username_key", "email_key"])
    request_id = F.when(F.col("won"), _highest(requests) + F.col("position"))
    judged = judged.withColumn("request_id", request_id)
    outcomes = judged.select(
        "position", F.col("won").alias("success"), "request_id",
        F.when(F.col("won"), C.MSG_REQUEST_CREATED).otherwise(F.coalesce("refusal", F.lit(C.MSG_REQUEST_EXISTS))).alias("message"),
    )
    created = judged.filter("won").select(
        F.col("request_id").alias("id"),
        F.trim("full_name").alias("full_name"), F.trim("email").alias("email"),
        F.trim("requested_username").alias("requested_username"), role.alias("requested_role"),
        F.coalesce("request_reason", F.lit("")).alias("request_reason"),
        F.lit("pending").alias("request_status"),
        F.lit(batch_time).cast("timestamp_ntz").alias("created_at"),
    )
    return outcomes, requests.unionByName(created, allowMissingColumns=True)


def _decided(
    decisions: DataFrame, users: DataFrame, roles: DataFrame, requests: DataFrame, not_admin: str
) -> tuple[DataFrame, Column]:
    """Decisions with the pending request they mean, and the rules both kinds share."""
    role_ids = roles.filter(F.col("role_code") == C.ADMIN_ROLE).select(F.col("id").alias("role_id"))
    admins = users.filter(F.col("user_status") == "active").join(role_ids, "role_id", "left_semi")
    df = _flag(decisions, admins.select(F.col("id").alias("admin_user_id")), "admin_user_id", "by_admin")
    pending = requests.filter(F.col("request_status") == "pending").select(
        F.col("id").alias("request_id"), F.lit(True).alias("is_pending"),
        "full_name", "email", "requested_username", "requested_role", "request_reason",
    )
    refusal = (
        F.when(F.col("request_id").isNull(), C.MSG_REQUEST_ID_REQUIRED)
        .when(F.col("admin_user_id").isNull(), C.MSG_ADMIN_ID_REQUIRED)
        .when(~F.col("by_admin"), not_admin)
        .when(F.col("is_pending").isNull(), C.MSG_NOT_PENDING)
    )
    return df.join(pending, "request_id", "left"), refusal


def _mark_reviewed(requests: DataFrame, done: DataFrame, status: str, batch_time: dt.datetime) -> DataFrame:
    """Requests with those in ``done`` (id, _admin, _comment) set to their new status."""
    marked = requests.join(done, "id", "left")
    is_done = F.col("_admin").isNotNull()
    changes = {
        "request_status": F.lit(status),
        "reviewed_by": F.col("_admin"),
        "reviewed_at": F.lit(batch_time).cast("timestamp_ntz"),
        "review_comment": F.col("_comment"),
    }
    return marked.select(
        *[F.when(is_done, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in requests.columns]
    )


def apply_approvals(
    decisions: DataFrame, requests: DataFrame, users: DataFrame, roles: DataFrame, batch_time: dt.datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, users, requests) after approving. ``decisions``: position, request_id, admin_user_id."""
    df, refusal = _decided(decisions, users, roles, requests, C.MSG_ONLY_ADMIN_APPROVES)
    active_roles = roles.filter("is_active").select(F.col("role_code").alias("requested_role"), F.col("id").alias("role_id"))
    df = df.join(active_roles, "requested_role", "left")
    df = df.withColumn("username_key", F.lower("requested_username")).withColumn("email_key", F.lower("email"))
    df = _with_taken(df, users, "username", "is_user")
    refusal = refusal.when(F.col("role_id").isNull(), C.MSG_ROLE_INACTIVE).when(F.col("is_user"), C.MSG_SAME_USER)
    checked = stage(df.withColumn("refusal", refusal), "approvals")
    judged = _won(checked, F.col("refusal").isNull(), ["request_id", "username_key", "email_key"])
    approved = judged.filter("won").select("request_id")
    judged = _flag(judged, approved, "request_id", "was_approved")
    lost = F.when(F.col("was_approved"), C.MSG_NOT_PENDING).otherwise(F.lit(C.MSG_SAME_USER))
    judged = judged.withColumn("new_user_id", F.when(F.col("won"), _highest(users) + F.col("position")))
    now = F.lit(batch_time).cast("timestamp_ntz")
    outcomes = judged.select(
        "position", F.col("won").alias("success"), "new_user_id",
        F.when(F.col("won"), C.MSG_APPROVED).otherwise(F.coalesce("refusal", lost)).alias("message"),
    )
    created = judged.filter("won").select(
        F.col("new_user_id").alias("id"), F.col("requested_username").alias("username"), "full_name", "email", "role_id",
        F.lit("active").alias("user_status"), "requested_role", "request_reason",
        F.col("admin_user_id").alias("approved_by"), now.alias("approved_at"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    done = judged.filter("won").select(
        F.col("request_id").alias("id"), F.col("admin_user_id").alias("_admin"), F.lit("Approved").alias("_comment")
    )
    return (
        outcomes,
        users.unionByName(created, allowMissingColumns=True),
        _mark_reviewed(requests, done, "approved", batch_time),
    )


def apply_rejections(
    decisions: DataFrame, requests: DataFrame, users: DataFrame, roles: DataFrame, batch_time: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, requests) after rejecting. ``decisions``: position, request_id, admin_user_id, review_comment."""
    df, refusal = _decided(decisions, users, roles, requests, C.MSG_ONLY_ADMIN_REJECTS)
    checked = stage(df.withColumn("refusal", refusal), "rejections")
    # One key per decision: the earliest open decision on a request is the one that counts.
    first = checked.filter(F.col("refusal").isNull()).groupBy("request_id").agg(F.min("position").alias("position"))
    judged = _flag(checked, first.select("position"), "position", "won")
    outcomes = judged.select(
        "position", F.col("won").alias("success"),
        F.when(F.col("won"), C.MSG_REJECTED).otherwise(F.coalesce("refusal", F.lit(C.MSG_NOT_PENDING))).alias("message"),
    )
    done = judged.filter("won").select(
        F.col("request_id").alias("id"), F.col("admin_user_id").alias("_admin"),
        F.coalesce("review_comment", F.lit("")).alias("_comment"),
    )
    return outcomes, _mark_reviewed(requests, done, "rejected", batch_time)
