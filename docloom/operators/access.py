"""Who sees what: trees of users and rules of tenancy."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

ADMIN, STATION = "admin", "health_station"


def ancestors(users: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(user_id, ancestor_id, distance) with each user itself at 0; up to the root, never around a cycle.

    Every step joins the frontier to the parents by key and cuts the lineage; the tree's depth, not its size, is the number
    of steps. ``of`` (user_id) names the users to begin with, else all begin.
    """
    there = users.select(F.col("user_id").alias("up"))
    parents = users.select(F.col("user_id").alias("at"), F.col("parent_id").alias("up")).join(there, "up", "left_semi")
    begin = users.select("user_id") if of is None else users.select("user_id").join(of.select("user_id"), "user_id", "left_semi")
    level = begin.select("user_id", F.col("user_id").alias("ancestor_id"), F.lit(0).alias("distance"), F.array("user_id").alias("seen"))
    found = level
    for k in count(1):
        level = level.join(parents, F.col("ancestor_id") == F.col("at")).where(~F.array_contains("seen", F.col("up")))
        level = cut(level.select("user_id", F.col("up").alias("ancestor_id"), F.lit(k).alias("distance"), F.concat("seen", F.array("up")).alias("seen")))
        if level.isEmpty():
            break
        found = found.union(level)
    return found.drop("seen")


def descendants(users: DataFrame, root: int) -> DataFrame:
    """(user_id, distance) of all users below one, the user itself at 0; a cycle ends where it meets itself."""
    children = users.select("user_id", F.col("parent_id").alias("up")).where("up is not null")
    level = users.where(F.col("user_id") == root).select("user_id", F.lit(0).alias("distance"))
    found = level
    for k in count(1):
        below = level.select(F.col("user_id").alias("up")).join(children, "up").select("user_id", F.lit(k).alias("distance"))
        level = cut(below.join(found.select("user_id"), "user_id", "left_anti").distinct())
        if level.isEmpty():
            break
        found = found.union(level)
    return found


def chains(users: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``ancestors`` with roles, up to and with the first administrator above the user (at ``stop``, null without one)."""
    about = users.select(F.col("user_id").alias("ancestor_id"), F.col("role").alias("a_role"), F.col("inherits").alias("a_inherits"))
    chain = ancestors(users, of).join(about, "ancestor_id")
    first = chain.where((F.col("a_role") == ADMIN) & (F.col("distance") > 0)).groupBy("user_id").agg(F.min("distance").alias("stop"))
    return chain.join(first, "user_id", "left").where("stop is null or distance <= stop")


def visible_chain(users: DataFrame, of: DataFrame | None = None, chain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(user_id, owner_id) of the user and those above it, and (user_id) of the users that see what all administrators own.

    ``chain``, if it is there already, is what ``chains`` gives.

    A chain ends at the first administrator above. That one is on it unless the user, or one between, does not inherit;
    a user who is no administrator then sees all administrators.
    """
    chain = chains(users, of) if chain is None else chain
    between = (F.col("distance") == 0) | (F.col("a_role") != ADMIN)
    shut = F.bool_or(between & ~F.coalesce("a_inherits", F.lit(False)))
    state = chain.groupBy("user_id").agg(shut.alias("shut"), F.max("stop").alias("at"), F.max(F.when(F.col("distance") == 0, F.col("a_role"))).alias("role"))
    own = chain.join(state.select("user_id", "shut"), "user_id").where(between | ~F.col("shut")).select("user_id", F.col("ancestor_id").alias("owner_id"))
    return own, state.where((F.col("role") != ADMIN) & F.col("at").isNotNull() & ~F.col("shut")).select("user_id")


def visible_owners(users: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(user_id, owner_id) of all owners that users see, ``visible_chain`` with the administrators written out.

    The administrators are one array, a subquery's, beside each user that sees them. A query about guidelines should test
    the owner's role instead, as the listing does.
    """
    own, sharing = visible_chain(users, of)
    admins = users.where(F.col("role") == ADMIN).agg(F.collect_set("user_id").alias("admins"))
    return own.union(sharing.select("user_id", F.explode(admins.scalar()))).distinct()


def station_scope(users: DataFrame, of: DataFrame | None = None, chain: DataFrame | None = None) -> DataFrame:
    """(user_id, in_scope): whether the user, or one above it before the first administrator, is a health station."""
    hit = (chains(users, of) if chain is None else chain).groupBy("user_id").agg(F.bool_or((F.col("a_role") == STATION)).alias("in_scope"))
    return hit.select("user_id", F.coalesce("in_scope", F.lit(False)).alias("in_scope"))


def subtree_height(users: DataFrame) -> DataFrame:
    """(user_id, height): steps to the deepest descendant."""
    return ancestors(users).groupBy(F.col("ancestor_id").alias("user_id")).agg(F.max("distance").alias("height"))


def access_scope(owner: Column, owner_role: Column, user_id: int, user_role: str) -> Column:
    """admin, global, owned or inherited, the first that applies."""
    return F.when(F.lit(user_role == ADMIN), ADMIN).when(owner_role == ADMIN, "global").when(owner == user_id, "owned").otherwise("inherited")


def can_manage(owner: Column, user_id: int, user_role: str) -> Column:
    """Whether the user may change what the owner has: administrators all, doctors nothing, others their own."""
    return F.lit(user_role == ADMIN) | (F.lit(user_role != "doctor") & F.coalesce(owner == user_id, F.lit(False)))


#: Roles, and older names of roles that now mean a health department (fixed values).
ROLES = ("admin", "health_department", "central_hospital", "hospital", "health_station", "doctor")
OLD_ROLES = ("user", "editor", "viewer")


def stored_role(role: Column) -> Column:
    """A stored role in lower case; what is no role is a health department."""
    name = F.lower(F.coalesce(role, F.lit("")))
    return F.when(name.isin(*ROLES), name).otherwise("health_department")


def asked_role(role: Column) -> Column:
    """A role from outside: older names are health departments, unknown ones null."""
    name = F.lower(F.trim(role))
    return F.when(name.isin(*OLD_ROLES), "health_department").when(name.isin(*ROLES), name)


def owner_choices(users: DataFrame) -> DataFrame:
    """Users who can own guidelines: active, neither administrators nor doctors."""
    return users.where(F.col("is_active") & ~F.col("role").isin(ADMIN, "doctor"))


def listed_users(users: DataFrame, user_id: int, user_role: str) -> DataFrame:
    """Users that a user sees, by role, those without parent first, and id: administrators all, others themselves and all below them."""
    seen = users if user_role == ADMIN else users.join(descendants(users, user_id).select("user_id"), "user_id", "left_semi")
    return seen.orderBy("role", F.col("parent_id").asc_nulls_first(), "user_id")


def delete_order(users: DataFrame, root: int) -> DataFrame:
    """(user_id, height) of a user and all below it, children before parents: by height, then id."""
    below = users.join(descendants(users, root).select("user_id"), "user_id", "left_semi")
    return subtree_height(below).orderBy("height", "user_id")


def set_inheritance(users: DataFrame, root: int, inherits: bool) -> DataFrame:
    """All users; those below ``root`` (not itself) get ``inherits``."""
    below = descendants(users, root).where("distance > 0").select("user_id", F.lit(inherits).alias("now"))
    return users.join(below, "user_id", "left").withColumn("inherits", F.coalesce("now", "inherits")).drop("now").select(*users.columns)
