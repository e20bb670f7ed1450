"""Accounts: who may create whom, changes as new snapshots, and imports from lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.access import ADMIN, STATION, asked_role, descendants, set_inheritance

#: Roles under which a role may stand (fixed values). Administrators and the roles named in ``TOP_ROLES`` stand under none of them.
PARENT_ROLES = {
    "hospital": ("health_department",),
    "health_station": ("health_department",),
    "doctor": ("central_hospital", "hospital", "health_station"),
}
TOP_ROLES = ("health_department", "central_hospital")


def may_create(creator_role: Column, role: Column) -> Column:
    """Whether an account of one role may create, or give, another role: administrators any, others those that stand under theirs."""
    allowed = F.lit(False)
    for child, parents in PARENT_ROLES.items():
        allowed = allowed | ((role == child) & creator_role.isin(*parents))
    return (creator_role == ADMIN) | allowed


def placed(users: DataFrame, requests: DataFrame, creator_id: int) -> DataFrame:
    """Requests (email, role, parent_id, inherits, any others) by one creator with the ``parent_id`` and ``inherits`` they get, and ``problem``.

    Problems, the first that holds: an unknown creator, an unknown role, a role the creator may not give, a top-level unit not made by an
    administrator, a parent other than the creator, no parent where one is needed, one that is missing or inactive, or one of a wrong role.
    Administrators have no parent and inherit; top-level units stand under the administrator if they inherit; others inherit what their parent does.
    """
    creator = users.where(F.col("user_id") == creator_id).select(F.col("role").alias("c_role"), F.col("inherits").alias("c_inherits"))
    parents = users.select(F.col("user_id").alias("parent_id"), F.col("role").alias("p_role"), F.col("inherits").alias("p_inherits"), F.col("is_active").alias("p_active"))
    others = [c for c in requests.columns if c not in ("email", "role", "parent_id", "inherits")]
    r = requests.withColumns({"email": F.lower(F.trim("email")), "role": asked_role(F.col("role")), "inherits": F.coalesce("inherits", F.lit(True))})
    # one row beside all requests, or none if there is no such creator
    r = r.withColumn("creator", F.lit(creator_id)).join(F.broadcast(creator.withColumn("creator", F.lit(creator_id))), "creator", "left").join(parents, "parent_id", "left")
    by_admin, top = F.col("c_role") == ADMIN, F.col("role").isin(*TOP_ROLES)
    fits = F.lit(False)
    for child, allowed in PARENT_ROLES.items():
        fits = fits | ((F.col("role") == child) & F.col("p_role").isin(*allowed))
    below = (F.col("role") != ADMIN) & ~top
    problem = (
        F.when(F.col("c_role").isNull(), "no creator")
        .when(F.col("role").isNull(), "no such role")
        .when(~may_create(F.col("c_role"), F.col("role")), "role not allowed")
        .when(top & ~by_admin, "made by administrators only")
        .when(below & ~by_admin & F.col("parent_id").isNotNull() & (F.col("parent_id") != creator_id), "parent is not the creator")
        .when(below & by_admin & F.col("parent_id").isNull(), "parent needed")
        .when(below & by_admin & ~F.coalesce("p_active", F.lit(False)), "no such parent")
        .when(below & by_admin & ~fits, "parent of a wrong role")
    )
    parent = F.when(F.col("role") == ADMIN, F.lit(None).cast("long")).when(top, F.when(F.col("inherits"), F.lit(creator_id).cast("long"))).when(by_admin, F.col("parent_id")).otherwise(F.lit(creator_id).cast("long"))
    inherits = F.when(F.col("role") == ADMIN, True).when(top, F.col("inherits")).when(by_admin, F.col("p_inherits")).otherwise(F.col("c_inherits"))
    return r.select("email", "role", parent.alias("parent_id"), inherits.alias("inherits"), *others, problem.alias("problem"))


def create_users(users: DataFrame, requests: DataFrame, creator_id: int) -> tuple[DataFrame, DataFrame]:
    """All users with those newly made, and the requests with a problem. E-mails that are taken, or asked for before by ``row``, are one.

    New ids follow the largest; they are given in one task, as a sequence is, to the accepted requests alone. requests: also row, is_active.
    """
    r = placed(users, requests, creator_id)
    taken = users.select("email", F.lit(True).alias("taken")).distinct()
    r = r.join(taken, "email", "left").withColumn("n", F.row_number().over(Window.partitionBy("email").orderBy("row")))
    r = r.withColumn("problem", F.coalesce("problem", F.when(F.col("taken") | (F.col("n") > 1), "e-mail taken"))).drop("taken", "n")
    top = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.orderBy("row"))
    new = r.where("problem is null").withColumn("user_id", top.scalar() + number)
    new = new.withColumn("created_by", F.lit(creator_id).cast("long"))
    return users.unionByName(new.select(*[c for c in users.columns if c in new.columns]), allowMissingColumns=True), r.where("problem is not null")


def change_role(users: DataFrame, user_id: int, role: str, creator_id: int, parent_id: int | None = None, inherits: bool | None = None) -> DataFrame:
    """All users; one has another role, with the parent and inheritance that a new account would get, and all below it inherit as it does."""
    spark = users.sparkSession
    row = users.where(F.col("user_id") == user_id).first()
    me = users.where(F.col("user_id") == creator_id).first()
    if row is None or user_id == creator_id:
        raise ValueError("no such user, or the user itself")
    if me is None or (me["role"] != ADMIN and row["parent_id"] != creator_id):
        raise ValueError("the user is not below the creator")
    wish = spark.createDataFrame([(row["email"], role, parent_id, row["inherits"] if inherits is None else inherits)], "email string, role string, parent_id long, inherits boolean")
    got = placed(users, wish, creator_id).first()
    if got["problem"]:
        raise ValueError(got["problem"])
    this = F.col("user_id") == user_id
    changed = users.withColumns({"role": F.when(this, F.lit(got["role"])).otherwise(F.col("role")), "parent_id": F.when(this, F.lit(got["parent_id"])).otherwise(F.col("parent_id")), "inherits": F.when(this, F.lit(got["inherits"])).otherwise(F.col("inherits"))})
    return set_inheritance(changed, user_id, got["inherits"])


def delete_users(users: DataFrame, guidelines: DataFrame, user_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users and guidelines that stay when a user goes with all below it and what they own, and the guidelines that go. Administrators are not deleted."""
    row = users.where(F.col("user_id") == user_id).first()
    if row is None or row["role"] == ADMIN:
        raise ValueError("no such user, or an administrator")
    doomed = descendants(users, user_id).select("user_id")
    owned = doomed.withColumnRenamed("user_id", "owner_id")
    return users.join(doomed, "user_id", "left_anti"), guidelines.join(owned, "owner_id", "left_anti"), guidelines.join(owned, "owner_id", "left_semi")


def adopt_orphans(users: DataFrame, admin_id: int) -> DataFrame:
    """All users; health departments without a parent that inherit come under an administrator."""
    orphan = (F.col("role") == "health_department") & F.col("parent_id").isNull() & F.col("inherits") & (F.col("user_id") != admin_id)
    return users.withColumn("parent_id", F.when(orphan, F.lit(admin_id).cast("long")).otherwise(F.col("parent_id")))


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it lacks, one of each key."""
    fresh = rows.join(table.select(key), key, "left_anti").dropDuplicates([key])
    return table.unionByName(fresh, allowMissingColumns=True)


def import_actions(accounts: DataFrame, users: DataFrame, name: str = "name") -> DataFrame:
    """Accounts (email, name) of a list with ``action``: create, skip if the user is there, conflict if there under another name."""
    there = users.select("email", F.col(name).alias("has_name"), F.lit(True).alias("found"))
    action = F.when(F.col("found").isNull(), "create").when(F.col(name).eqNullSafe(F.col("has_name")), "skip").otherwise("conflict")
    return accounts.join(there, "email", "left").withColumn("action", action).drop("has_name", "found")


def correction_actions(corrections: DataFrame, users: DataFrame, parent_id: int) -> DataFrame:
    """Corrections (row, old_email, new_email) of the e-mails of stations under one parent, with ``action``: update, fixed, or conflict and ``reason``.

    A conflict is: both addresses are taken, the new one by another kind of account, the old one by none or by another kind.
    """
    station = (F.col("role") == STATION) & (F.coalesce("parent_id", F.lit(0)) == parent_id)
    old = users.select(F.col("email").alias("old_email"), F.lit(True).alias("has_old"), station.alias("old_fits"))
    new = users.select(F.col("email").alias("new_email"), F.lit(True).alias("has_new"), (station & F.col("is_active")).alias("new_fits"))
    j = corrections.join(old, "old_email", "left").join(new, "new_email", "left")
    has_old, has_new = F.col("has_old").isNotNull(), F.col("has_new").isNotNull()
    reason = (
        F.when(has_old & has_new, "both exist")
        .when(has_new & ~F.coalesce("new_fits", F.lit(False)), "target is another account")
        .when(~has_new & ~has_old, "source not found")
        .when(~has_new & ~F.coalesce("old_fits", F.lit(False)), "source is another account")
    )
    action = F.when(reason.isNotNull(), "conflict").when(has_new, "fixed").otherwise("update")
    return j.select(*corrections.columns, action.alias("action"), reason.alias("reason"))


def apply_corrections(users: DataFrame, actions: DataFrame) -> DataFrame:
    """All users with the new e-mails; any conflict stops the whole batch."""
    if not actions.where("action = 'conflict'").isEmpty():
        raise ValueError("there are conflicts; nothing is changed")
    moves = actions.where("action = 'update'").select(F.col("old_email").alias("email"), "new_email")
    return users.join(moves, "email", "left").withColumn("email", F.coalesce("new_email", "email")).drop("new_email").select(*users.columns)
