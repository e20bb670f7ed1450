"""The listing of guidelines that a user may see, a page at a time."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import STATION_KEY, literal_search_key, search_key
from docloom.operators.access import ADMIN, access_scope, can_manage, chains, station_scope, visible_chain
from docloom.operators.versions import active_versions
from docloom.session import cut

SEARCHED = ("title", "disease", "publisher", "specialty")


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page from 1, page_size from 1 to 100")


def page_of(rows: DataFrame, order: list, page: int, page_size: int) -> DataFrame:
    check_page(page, page_size)
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def tenant_guidelines(guidelines: DataFrame, users: DataFrame, user_id: int, user_role: str, owner_id: int | None = None) -> DataFrame:
    """Guidelines that the user may see: administrators all, or those of ``owner_id``; others those of the owners they see.

    An owner that the user does not see has no guidelines. In the scope of a health station only its specialty is seen.
    The walk begins at the one user, and what administrators share is tested by their role.
    """
    wanted = guidelines if owner_id is None else guidelines.where(F.col("owner_id") == owner_id)
    if user_role == ADMIN:
        return wanted
    me = users.where(F.col("user_id") == user_id).select("user_id")
    # one walk for both rules; a row for each user above this one
    chain = cut(chains(users, me))
    own, sharing = visible_chain(users, chain=chain)
    admins = users.where(F.col("role") == ADMIN).select(F.col("user_id").alias("owner_id"))
    seen = own.select("owner_id") if sharing.isEmpty() else own.select("owner_id").union(admins).distinct()
    out = wanted.join(seen, "owner_id", "left_semi")
    if not station_scope(users, chain=chain).where("in_scope").isEmpty():
        out = out.where(search_key(F.col("specialty")) == STATION_KEY)
    return out.select(*guidelines.columns)


def matching(guidelines: DataFrame, search: str | None = None, **columns: str | None) -> DataFrame:
    """Guidelines of which one of the columns of ``SEARCHED`` holds the search words, and each named column its own; blank words ask for nothing."""
    key = literal_search_key(search)
    if key:
        guidelines = guidelines.where(reduce(or_, [search_key(F.col(c)).contains(key) for c in SEARCHED]))
    for column, words in columns.items():
        if column not in SEARCHED:
            raise ValueError(f"no search in {column}")
        key = literal_search_key(words)
        if key:
            guidelines = guidelines.where(search_key(F.col(column)).contains(key))
    return guidelines


def visible_guidelines(guidelines: DataFrame, users: DataFrame, user_id: int, user_role: str, search: str | None = None, owner_id: int | None = None, **columns: str | None) -> DataFrame:
    return matching(tenant_guidelines(guidelines, users, user_id, user_role, owner_id), search, **columns)


def list_guidelines(guidelines: DataFrame, versions: DataFrame, users: DataFrame, user_id: int, user_role: str, active: tuple[str, ...], search: str | None = None, page: int = 1, page_size: int = 20, owner_id: int | None = None, **columns: str | None) -> DataFrame:
    """One page, newest first, with the active version, the scope of access, whether the user may manage it, and the ``total`` of all pages.

    The page is cut before anything is joined to it. Beyond the last page there is no row to carry the total; see ``total``.
    """
    check_page(page, page_size)
    all_rows = visible_guidelines(guidelines, users, user_id, user_role, search, owner_id, **columns)
    rows = page_of(all_rows, [F.col("guideline_id").desc()], page, page_size).withColumn("total", total(all_rows).scalar())
    roles = users.select(F.col("user_id").alias("owner_id"), F.col("role").alias("owner_role"))
    rows = rows.join(roles, "owner_id", "left").withColumn("scope", access_scope(F.col("owner_id"), F.col("owner_role"), user_id, user_role))
    latest = active_versions(versions.join(rows.select("guideline_id"), "guideline_id", "left_semi"), active)
    rows = rows.withColumn("can_manage", can_manage(F.col("owner_id"), user_id, user_role))
    return rows.join(latest.select("guideline_id", "version_id", "release_date"), "guideline_id", "left").select("guideline_id", "title", "publisher", "owner_id", "scope", "can_manage", "version_id", "release_date", "total")


def total(rows: DataFrame) -> DataFrame:
    """One row: how many rows all pages have."""
    return rows.agg(F.count("*").alias("total"))


def list_versions(guidelines: DataFrame, versions: DataFrame, users: DataFrame, user_id: int, user_role: str, guideline_id: int, status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of a guideline's versions, newest release first, unknown dates last; of one status, whatever its case, if that is not blank.

    A guideline that the user does not see has no versions here.
    """
    seen = tenant_guidelines(guidelines.where(F.col("guideline_id") == guideline_id), users, user_id, user_role)
    rows = versions.join(seen.select("guideline_id"), "guideline_id", "left_semi")
    if status and status.strip():
        rows = rows.where(F.lower(F.coalesce("status", F.lit(""))) == status.strip().lower())
    return page_of(rows, [F.col("release_date").desc_nulls_last(), F.col("version_id").desc()], page, page_size)


def filter_options(guidelines: DataFrame, column: str) -> DataFrame:
    """The non-empty values of a column, in order."""
    return guidelines.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(column)


class NotFound(LookupError):
    """No row has the key."""


def point_lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; none is an error, and so are two."""
    rows = table.where(F.col(key) == value)
    n = len(rows.select(F.lit(1)).limit(2).collect())
    if n == 0:
        raise NotFound(f"no {key} {value}")
    if n > 1:
        raise ValueError(f"more than one {key} {value}")
    return rows
