"""Versions of guidelines, and changes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def is_active(status: Column, active: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*active)


def active_versions(versions: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """The latest active version of each guideline: newest release first, unknown dates last, then the larger id."""
    return first_by(versions.where(is_active(F.col("status"), active)), ["guideline_id"], newest_first())


def deactivate_others(versions: DataFrame, keep: DataFrame, active: tuple[str, ...], value: str = "inactive") -> DataFrame:
    """All versions; active ones of the guidelines of ``keep`` (guideline_id, keep_id) other than the kept one become ``value``."""
    change = is_active(F.col("status"), active) & F.col("keep_id").isNotNull() & (F.col("version_id") != F.col("keep_id"))
    return versions.join(keep, "guideline_id", "left").withColumn("status", F.when(change, value).otherwise(F.col("status"))).drop("keep_id")


def count_deactivated(versions: DataFrame, keep: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """(guideline_id, n) of the versions that ``deactivate_others`` changes."""
    changed = versions.join(keep, "guideline_id").where(is_active(F.col("status"), active) & (F.col("version_id") != F.col("keep_id")))
    return count_by(changed, "guideline_id", "n")


def count_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of each key."""
    return rows.groupBy(key).agg(F.count("*").alias(name))


def next_label(n: Column) -> Column:
    """The label of a guideline's next version, which has ``n`` so far."""
    return (n + 1).cast("string")


def without(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Rows of ``parents`` whose key no row of ``children`` has."""
    return parents.join(children.select(key), key, "left_anti")


def backfill_owner(documents: DataFrame, versions: DataFrame, guidelines: DataFrame, default: int | None = None) -> DataFrame:
    """Documents (version_id, owner_id) whose missing owner becomes that of their guideline, or else ``default``."""
    owners = versions.select("version_id", "guideline_id").join(guidelines.select("guideline_id", F.col("owner_id").alias("of_guideline")), "guideline_id", "left").drop("guideline_id")
    found = documents.join(owners, "version_id", "left")
    return found.withColumn("owner_id", F.coalesce("owner_id", "of_guideline", F.lit(default))).select(*documents.columns)


def outcomes(jobs: DataFrame) -> DataFrame:
    """Jobs of each status, and when the first was asked for."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"), F.min("requested_at").alias("earliest"))


def survivors(children: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows that stay when the rows of ``doomed`` go with all that hangs on them."""
    return children.join(doomed.select(key), key, "left_anti")


def patch(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Applies ``changes`` (key, patch: map of column to text); a column that the map lacks stays, one mapped to null becomes null."""
    joined = table.join(changes, key, "left")
    new = {c: F.when(F.map_contains_key("patch", F.lit(c)), F.col("patch")[c].cast(t)).otherwise(F.col(c)) for c, t in table.dtypes if c != key}
    return joined.withColumns({c: F.when(F.col("patch").isNull(), F.col(c)).otherwise(v) for c, v in new.items()}).drop("patch")


def first_by(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order given."""
    return table.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def enqueue(requests: DataFrame, jobs: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """Requests that become jobs: the earliest of each version that has no active job."""
    busy = jobs.where(F.col("status").isin(*active)).select("version_id").distinct()
    return first_by(requests.join(busy, "version_id", "left_anti"), ["version_id"], [F.col("requested_at"), F.col("job_id")])


def job_status(versions: DataFrame, jobs: DataFrame, success: str) -> DataFrame:
    """For each version its latest job's status (idle without one) and the time of its last success."""
    latest = jobs.groupBy("version_id").agg(F.max_by("status", F.struct("requested_at", "job_id")).alias("status"), F.max(F.when(F.col("status") == success, F.col("requested_at"))).alias("succeeded_at"))
    return versions.join(latest, "version_id", "left").withColumn("status", F.coalesce("status", F.lit("idle")))


def newest_first() -> list[Column]:
    """Newest release first, unknown dates last, then the larger id."""
    return [F.col("release_date").desc_nulls_last(), F.col("version_id").desc()]


def promote_latest(versions: DataFrame, guidelines: DataFrame, active: tuple[str, ...], value: str, inactive: str = "inactive") -> DataFrame:
    """All versions; of each guideline named in ``guidelines`` the newest one, whatever its status, becomes ``value`` and its other active ones ``inactive``."""
    newest = first_by(versions.join(guidelines.select("guideline_id"), "guideline_id", "left_semi"), ["guideline_id"], newest_first())
    keep = newest.select("guideline_id", F.col("version_id").alias("promoted"))
    others = is_active(F.col("status"), active) & F.col("promoted").isNotNull()
    status = F.when(F.col("version_id") == F.col("promoted"), value).when(others, inactive).otherwise(F.col("status"))
    return versions.join(keep, "guideline_id", "left").withColumn("status", status).drop("promoted")


def valid_interval(start: Column, end: Column) -> Column:
    """Whether an interval does not end before it starts; an open end is valid."""
    return F.coalesce(end >= start, F.lit(True))


def create_guideline(guidelines: DataFrame, versions: DataFrame, documents: DataFrame, values: dict, version: dict, document: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with a new guideline, its first version, being processed, and its document. Ids follow the largest ones.

    ``values``, ``version`` and ``document`` give the other columns; a missing label is that of a first version.
    """
    if not str(values.get("title") or "").strip():
        raise ValueError("a guideline has a title")
    if version.get("effective_from") and version.get("effective_to") and version["effective_to"] < version["effective_from"]:
        raise ValueError("the version ends before it starts")

    def next_id(table: DataFrame, key: str) -> int:
        return (table.agg(F.max(key)).first()[0] or 0) + 1

    def added(table: DataFrame, row: dict) -> DataFrame:
        one = table.sparkSession.createDataFrame([tuple(row.get(c) for c in table.columns)], table.schema)
        return table.union(one)

    g, v, d = next_id(guidelines, "guideline_id"), next_id(versions, "version_id"), next_id(documents, "document_id")
    return (
        added(guidelines, {**values, "guideline_id": g, "title": values["title"].strip()}),
        added(versions, {"label": "1", **version, "guideline_id": g, "version_id": v, "status": "processing"}),
        added(documents, {**document, "document_id": d, "version_id": v}),
    )


def edit_sections(sections: DataFrame, updates: DataFrame) -> DataFrame:
    """Sections with new headings and contents. updates: section_id, heading, content; null leaves a value, a blank heading becomes null.

    A section twice, an update of nothing and an unknown or null section are errors of the job that reads the result, so that what writes it writes
    nothing; no action comes before.
    """
    new = updates.groupBy(F.col("section_id").alias("new_id")).agg(F.count("*").alias("n"), F.first("heading").alias("new_heading"), F.first("content").alias("new_content"))
    both = sections.join(new.withColumn("update", F.lit(True)), F.col("section_id") == F.col("new_id"), "full")
    fault = (
        F.when(F.col("n") > 1, "a section is updated twice")
        .when(F.col("update") & F.col("new_heading").isNull() & F.col("new_content").isNull(), "an update changes nothing")
        .when(F.col("update") & (F.col("section_id").isNull() | F.col("new_id").isNull()), "no such section")
    )
    heading = F.when(F.col("new_heading").isNotNull(), F.nullif(F.trim("new_heading"), F.lit(""))).otherwise(F.col("heading"))
    out = both.withColumns({"heading": heading, "content": F.coalesce("new_content", "content"), "fault": fault})
    # a condition on the rows, so that no choice of columns skips it
    return out.where(F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("boolean")).otherwise(True)).select(*sections.columns)


def counted(rows: DataFrame, name: str, **tests: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation with the number of rows (``rows``) and of those that meet each test, counted in the job that writes them.

    ``observation.get`` waits for that job. A test that is null counts as not met; of an empty table all counts are 0.
    """
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows"), *(F.count_if(F.coalesce(test, F.lit(False))).alias(key) for key, test in tests.items())), seen


def changed_sections(stored: DataFrame, edited: DataFrame) -> DataFrame:
    """Edited sections (section_id, heading, content) that differ from the stored ones; null is as good as empty."""
    was = stored.select("section_id", F.col("heading").alias("old_heading"), F.col("content").alias("old_content"))
    same = [F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit("")) for a, b in (("heading", "old_heading"), ("content", "old_content"))]
    return edited.join(was, "section_id").where(~(same[0] & same[1])).select(*edited.columns)


def next_states(events: DataFrame) -> DataFrame:
    """The state of each job after its events (job_id, at, event, message): queued, running, succeeded or failed; with times and an error of 4000 characters at most.

    A job runs from queued only and ends from running only; the first ending counts, other events change nothing.
    """
    first = lambda e: F.min(F.when(F.col("event") == e, F.struct("at", "message")))
    s = events.groupBy("job_id").agg(first("queued").alias("q"), first("running").alias("r"), first("succeeded").alias("s"), first("failed").alias("f"))
    began = F.when(F.col("r.at") >= F.col("q.at"), F.col("r.at"))
    s = s.withColumn("started_at", began)
    ends = F.array_min(F.filter(F.array(F.struct(F.col("s.at").alias("at"), F.lit("succeeded").alias("state")), F.struct(F.col("f.at").alias("at"), F.lit("failed").alias("state"))), lambda x: x["at"] >= F.col("started_at")))
    state = F.when(F.col("started_at").isNull(), "queued").otherwise(F.coalesce(ends["state"], F.lit("running")))
    return s.where("q is not null").select("job_id", state.alias("state"), "started_at", ends["at"].alias("finished_at"), F.when(ends["state"] == "failed", F.substring("f.message", 1, 4000)).alias("error"))


def top_one(rows: DataFrame, keys: list[str], order: list[Column], condition: Column | None = None) -> DataFrame:
    """Of each key the first row that meets the condition: the active job, the primary document, the fallback owner."""
    return first_by(rows if condition is None else rows.where(condition), keys, order)
