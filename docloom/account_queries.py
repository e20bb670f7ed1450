"""Registered queries of accounts and of changes to guidelines, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import outline
from docloom.functions import text as T
from docloom.operators import access, users, versions
from docloom.session import new_folder, read_table
from docloom.sources import roles
from docloom.sources.roles import ACTIVE
from docloom.streaming import job_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Accounts made of customers: a health department for each region, hospitals, stations and doctors below.
_ACCOUNTS = """acc AS (SELECT c_custkey + 10 AS user_id, 'u' || c_custkey || '@x.vn' AS email, CASE WHEN c_custkey < 5 THEN 'health_department' WHEN c_custkey < 30 THEN CASE WHEN c_custkey % 3 = 0 THEN 'health_station' ELSE 'hospital' END ELSE 'doctor' END AS role,
  CASE WHEN c_custkey < 5 THEN CASE WHEN c_custkey % 2 = 0 THEN 1 END WHEN c_custkey < 30 THEN c_custkey % 5 + 10 ELSE c_custkey % 25 + 15 END AS parent_id, c_custkey % 4 <> 3 AS inherits, c_custkey % 7 <> 0 AS is_active FROM customer
  UNION ALL SELECT 1, 'root@x.vn', 'admin', NULL, true, true)"""


def accounts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k < 5, "health_department").when(k < 30, F.when(k % 3 == 0, "health_station").otherwise("hospital")).otherwise("doctor")
    parent = F.when(k < 5, F.when(k % 2 == 0, 1)).when(k < 30, k % 5 + 10).otherwise(k % 25 + 15)
    c = read_table(spark, d, "customer").select((k + 10).cast("long").alias("user_id"), F.concat(F.lit("u"), k.cast("string"), F.lit("@x.vn")).alias("email"), role.alias("role"), parent.cast("long").alias("parent_id"), (k % 4 != 3).alias("inherits"), (k % 7 != 0).alias("is_active"))
    return c.union(spark.createDataFrame([(1, "root@x.vn", "admin", None, True, True)], c.schema))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_BELOW = f"""{_ACCOUNTS}, below AS (SELECT user_id, 0 AS distance FROM acc WHERE user_id = 12 UNION ALL SELECT a.user_id, b.distance + 1 FROM below b JOIN acc a ON a.parent_id = b.user_id)"""


@query(f"WITH RECURSIVE {_BELOW} SELECT user_id, distance FROM below")
def user_descendants(spark, d):
    return access.descendants(accounts(spark, d), 12)


@query(f"WITH RECURSIVE {_BELOW} SELECT user_id, role, parent_id FROM acc WHERE user_id IN (SELECT user_id FROM below)")
def users_below(spark, d):
    return access.listed_users(accounts(spark, d), 12, "health_department").select("user_id", "role", "parent_id")


@query(f"WITH RECURSIVE {_BELOW} SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM below WHERE distance > 0) THEN false ELSE inherits END AS inherits FROM acc")
def set_inheritance(spark, d):
    return access.set_inheritance(accounts(spark, d), 12, False).select("user_id", "inherits")


@query(f"WITH {_ACCOUNTS} SELECT user_id, role FROM acc WHERE is_active AND role NOT IN ('admin', 'doctor')")
def owner_choices(spark, d):
    return access.owner_choices(accounts(spark, d)).select("user_id", "role")


@query(r"""WITH n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN length(text) % 2 = 0 THEN upper(role) ELSE ' ' || role || ' ' END AS name FROM conversations UNION ALL SELECT -1 - n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Health_Station' ELSE 'DOCTOR ' END FROM nation UNION ALL SELECT -100 - c_custkey, c_mktsegment FROM customer)
SELECT id, CASE WHEN lower(name) IN ('admin', 'health_department', 'central_hospital', 'hospital', 'health_station', 'doctor') THEN lower(name) ELSE 'health_department' END AS stored, CASE WHEN lower(trim(name)) IN ('user', 'editor', 'viewer') THEN 'health_department' WHEN lower(trim(name)) IN ('admin', 'health_department', 'central_hospital', 'hospital', 'health_station', 'doctor') THEN lower(trim(name)) END AS asked FROM n""")
def role_names(spark, d):
    """Roles of turns of conversations, of nations as accounts, and names that are no role."""
    role = F.col("role")
    turns = read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.length("text") % 2 == 0, F.upper(role)).otherwise(F.concat(F.lit(" "), role, F.lit(" "))).alias("name"))
    nations = read_table(spark, d, "nation").select((-1 - F.col("n_nationkey")).alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "Health_Station").otherwise("DOCTOR ").alias("name"))
    rest = read_table(spark, d, "customer").select((-100 - F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("name"))
    n = turns.union(nations).union(rest)
    return n.select("id", access.stored_role(F.col("name")).alias("stored"), access.asked_role(F.col("name")).alias("asked"))


@query(f"""WITH {_ACCOUNTS}, r AS (SELECT s_suppkey AS row, 'u' || (s_suppkey * 31) || '@x.vn' AS email, CASE s_suppkey % 4 WHEN 0 THEN 'doctor' WHEN 1 THEN 'hospital' WHEN 2 THEN 'central_hospital' ELSE 'nurse' END AS role,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 40 + 10 END AS parent_id FROM supplier)
SELECT row, r.role, CASE WHEN r.role = 'nurse' THEN 'no such role' WHEN r.role <> 'central_hospital' AND r.parent_id IS NULL THEN 'parent needed' WHEN r.role <> 'central_hospital' AND NOT coalesce(p.is_active, false) THEN 'no such parent'
  WHEN r.role = 'doctor' AND p.role NOT IN ('central_hospital', 'hospital', 'health_station') OR r.role = 'hospital' AND p.role <> 'health_department' THEN 'parent of a wrong role' END AS problem,
  CASE WHEN r.role = 'central_hospital' THEN 1 WHEN r.role <> 'nurse' THEN r.parent_id END AS parent_id FROM r LEFT JOIN acc p ON p.user_id = r.parent_id""")
def place_accounts(spark, d):
    k = F.col("s_suppkey")
    role = F.when(k % 4 == 0, "Doctor ").when(k % 4 == 1, "hospital").when(k % 4 == 2, "central_hospital").otherwise("nurse")
    r = read_table(spark, d, "supplier").select(k.alias("row"), F.concat(F.lit("u"), (k * 31).cast("string"), F.lit("@x.vn")).alias("email"), role.alias("role"), F.when(k % 3 != 0, k % 40 + 10).cast("long").alias("parent_id"), F.lit(True).alias("inherits"))
    out = users.placed(accounts(spark, d), r, 1)
    known = F.col("role").isNotNull()
    return out.select("row", F.coalesce("role", F.lit("nurse")).alias("role"), "problem", F.when(known, F.col("parent_id")).cast("int").alias("parent_id"))


@query(f"""WITH {_ACCOUNTS}, r AS (SELECT s_suppkey AS row, 'U' || (s_suppkey % 60 * 5 + (SELECT count(*) FROM customer) - 20) || '@x.vn' AS email FROM supplier), f AS (SELECT *, row_number() OVER (PARTITION BY lower(email) ORDER BY row) AS n FROM r)
SELECT lower(email) AS email, (SELECT max(user_id) FROM acc) + row_number() OVER (ORDER BY row) AS user_id, 1::BIGINT AS created_by FROM f WHERE n = 1 AND lower(email) NOT IN (SELECT email FROM acc)""")
def create_accounts(spark, d):
    k, n = F.col("s_suppkey"), read_table(spark, d, "customer").count()
    r = read_table(spark, d, "supplier").select(k.alias("row"), F.concat(F.lit("U"), (k % 60 * 5 + n - 20).cast("string"), F.lit("@x.vn")).alias("email"), F.lit("health_department").alias("role"), F.lit(None).cast("long").alias("parent_id"), F.lit(True).alias("inherits"), F.lit(True).alias("is_active"))
    before = accounts(spark, d).withColumn("created_by", F.lit(None).cast("long"))
    after, _ = users.create_users(before, r, 1)
    return after.where("created_by is not null").select("email", "user_id", "created_by")


@query(f"WITH {_ACCOUNTS} SELECT user_id, CASE WHEN role = 'health_department' AND parent_id IS NULL AND inherits THEN 1 ELSE parent_id END AS parent_id FROM acc")
def adopt_orphans(spark, d):
    return users.adopt_orphans(accounts(spark, d), 1).select("user_id", F.col("parent_id").cast("int").alias("parent_id"))


@query(f"""WITH {_ACCOUNTS}, c AS (SELECT s_suppkey AS row, 'u' || (s_suppkey * 3) || '@x.vn' AS old_email, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_suppkey || '@x.vn' ELSE 'u' || s_suppkey || '@x.vn' END AS new_email FROM supplier)
SELECT row, CASE WHEN o.email IS NOT NULL AND n.email IS NOT NULL OR n.email IS NULL AND (o.email IS NULL OR o.role <> 'health_station' OR o.parent_id <> 11) OR o.email IS NULL AND n.email IS NOT NULL AND NOT (n.role = 'health_station' AND n.parent_id = 11 AND n.is_active) THEN 'conflict' WHEN n.email IS NOT NULL THEN 'fixed' ELSE 'update' END AS action
FROM c LEFT JOIN acc o ON o.email = old_email LEFT JOIN acc n ON n.email = new_email""")
def correct_emails(spark, d):
    k = F.col("s_suppkey")
    mail = lambda a, b: F.concat(F.lit(a), b.cast("string"), F.lit("@x.vn"))
    c = read_table(spark, d, "supplier").select(k.alias("row"), mail("u", k * 3).alias("old_email"), F.when(k % 2 == 0, mail("n", k)).otherwise(mail("u", k)).alias("new_email"))
    return users.correction_actions(c, accounts(spark, d), 11).select("row", "action")


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 100, s_name FROM supplier WHERE s_suppkey * 100 NOT IN (SELECT c_custkey FROM customer)")
def insert_missing(spark, d):
    c = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"))
    s = read_table(spark, d, "supplier").select((F.col("s_suppkey") * 100).cast("long").alias("k"), F.col("s_name").alias("name"))
    return users.insert_missing(c, s, "k")


# Guidelines and versions


@query("""WITH v AS (SELECT o_orderkey AS version_id, o_custkey AS guideline_id, CAST(o_orderdate AS DATE) AS release_date, o_orderstatus AS status FROM orders),
n AS (SELECT guideline_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY guideline_id ORDER BY release_date DESC NULLS LAST, version_id DESC) AS n FROM v WHERE guideline_id % 3 = 0) WHERE n = 1)
SELECT v.guideline_id, v.version_id, CASE WHEN v.version_id = n.version_id THEN 'active' WHEN n.version_id IS NOT NULL AND lower(status) = 'o' THEN 'inactive' ELSE status END AS status FROM v LEFT JOIN n ON n.guideline_id = v.guideline_id""")
def promote_latest(spark, d):
    g = roles.guidelines(spark, d).where("guideline_id % 3 = 0")
    return versions.promote_latest(roles.versions(spark, d), g, ACTIVE, "active").select("guideline_id", "version_id", "status")


@query("SELECT o_custkey AS guideline_id, count(*) AS n FROM orders JOIN (SELECT o_custkey AS k, max(o_orderkey) AS keep FROM orders GROUP BY 1) ON k = o_custkey WHERE o_orderstatus = 'O' AND o_orderkey <> keep GROUP BY 1")
def count_deactivated(spark, d):
    v = roles.versions(spark, d)
    return versions.count_deactivated(v, v.groupBy("guideline_id").agg(F.max("version_id").alias("keep_id")), ACTIVE)


@query("SELECT o_orderkey, coalesce(CAST(o_orderdate AS DATE) >= lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS valid FROM orders")
def version_dates(spark, d):
    """Intervals from the date of a customer's order before to this one's, open where there is none."""
    before = F.lag(F.to_date("o_orderdate")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return read_table(spark, d, "orders").select("o_orderkey", versions.valid_interval(before, F.to_date("o_orderdate")).alias("valid"))


@query("""WITH s AS (SELECT p_partkey AS section_id, p_name AS heading, p_type AS content FROM part), u AS (SELECT section_id, CASE WHEN section_id % 3 = 0 THEN '  ' WHEN section_id % 3 = 1 THEN ' New ' END AS heading, CASE WHEN section_id % 3 = 2 THEN 'text' END AS content FROM s WHERE section_id % 2 = 0)
SELECT s.section_id, CASE WHEN u.heading IS NOT NULL THEN nullif(trim(u.heading), '') ELSE s.heading END AS heading, coalesce(u.content, s.content) AS content FROM s LEFT JOIN u ON u.section_id = s.section_id""")
def edit_sections(spark, d):
    s = read_table(spark, d, "part").select(F.col("p_partkey").alias("section_id"), F.col("p_name").alias("heading"), F.col("p_type").alias("content"))
    k = F.col("section_id") % 3
    u = s.where("section_id % 2 = 0").select("section_id", F.when(k == 0, "  ").when(k == 1, " New ").alias("heading"), F.when(k == 2, "text").alias("content"))
    return versions.edit_sections(s, u)


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), e AS (SELECT doc_id * 100000 + i AS section_id, substr(line, 1, 20) AS heading, line AS content, CASE WHEN i % 2 = 0 THEN trim(substr(line, 1, 20)) ELSE substr(line, 1, 20) END AS new_heading, regexp_replace(line, '([.,])\s*([.,])', '\1', 'g') AS new_content FROM s)
SELECT section_id, md5(new_content) AS content FROM e WHERE heading <> new_heading OR content <> new_content""")
def changed_sections(spark, d):
    """Edits that strip every other heading and take doubled stops out of contents; an empty content stands as null on one side."""
    s = roles.sections(spark, d).select((F.col("version_id") * 100000 + F.col("pos")).alias("section_id"), F.substring("content", 1, 20).alias("heading"), "content", "pos")
    new = F.regexp_replace("content", r"([.,])\s*([.,])", "$1")
    e = s.select("section_id", F.when(F.col("pos") % 2 == 0, F.trim("heading")).otherwise(F.col("heading")).alias("heading"), F.nullif(new, F.lit("")).alias("content"))
    return versions.changed_sections(s.drop("pos"), e).select("section_id", F.md5(F.coalesce("content", F.lit(""))).alias("content"))


@query("""WITH e AS (SELECT user_id AS job_id, ts AS moment, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'seen' END AS event FROM events),
f AS (SELECT job_id, min(moment) FILTER (WHERE event = 'queued') AS q, min(moment) FILTER (WHERE event = 'running') AS r, min(moment) FILTER (WHERE event = 'succeeded') AS s, min(moment) FILTER (WHERE event = 'failed') AS f FROM e GROUP BY job_id),
g AS (SELECT job_id, CASE WHEN r >= q THEN r END AS started_at, s, f FROM f WHERE q IS NOT NULL), h AS (SELECT job_id, started_at, CASE WHEN s >= started_at THEN s END AS s, CASE WHEN f >= started_at THEN f END AS f FROM g)
SELECT job_id, started_at, CASE WHEN started_at IS NULL THEN 'queued' WHEN s IS NULL AND f IS NULL THEN 'running' WHEN f IS NULL OR s < f THEN 'succeeded' ELSE 'failed' END AS state, least(s, f) AS finished_at FROM h""")
def job_states(spark, d):
    t = F.col("event_type")
    event = F.when(t == "view", "queued").when(t == "click", "running").when(t == "purchase", "succeeded").when(t == "error", "failed").otherwise("seen")
    e = read_table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), event.alias("event"), F.col("props").alias("message"))
    return versions.next_states(e).select("job_id", "started_at", "state", "finished_at")


@query("SELECT user_id AS version_id, event_id AS job_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') WHERE n = 1")
def active_job(spark, d):
    return versions.top_one(roles.jobs(spark, d), ["version_id"], [F.col("requested_at").desc(), F.col("job_id").desc()], F.col("status") == "click").select("version_id", "job_id")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Trạm y tế' WHEN 1 THEN 'Trạm y tế' WHEN 2 THEN NULL ELSE c_mktsegment END AS specialty FROM customer")
def specialties(spark, d):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, " trạm Y tế ").when(k == 1, "Tram-y-te").when(k == 2, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return read_table(spark, d, "customer").select("c_custkey", T.specialty(raw).alias("specialty"))


@query(f"WITH RECURSIVE {_BELOW}, h AS (SELECT user_id AS top, user_id, 0 AS d FROM below UNION ALL SELECT h.top, a.user_id, h.d + 1 FROM h JOIN acc a ON a.parent_id = h.user_id) SELECT top AS user_id, max(d) AS height FROM h GROUP BY top")
def delete_order(spark, d):
    return access.delete_order(accounts(spark, d), 12)


@query("""WITH RECURSIVE e AS (SELECT user_id // 3 AS version_id, user_id AS job_id, ts AS moment, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' END AS event FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')),
o AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY moment, job_id, CASE event WHEN 'queued' THEN 1 WHEN 'running' THEN 2 WHEN 'succeeded' THEN 3 ELSE 4 END) AS n FROM e),
w AS (SELECT DISTINCT version_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS active, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS outcome FROM o
  UNION ALL SELECT w.version_id, o.n, CASE WHEN active IS NULL AND event = 'queued' THEN job_id WHEN active = job_id AND state = 'running' AND event IN ('succeeded', 'failed') THEN NULL ELSE active END,
    CASE WHEN active IS NULL THEN CASE WHEN event = 'queued' THEN 'queued' END WHEN active = job_id AND state = 'queued' AND event = 'running' THEN 'running' WHEN active = job_id AND state = 'running' AND event IN ('succeeded', 'failed') THEN NULL ELSE state END,
    CASE WHEN event = 'queued' THEN CASE WHEN active IS NULL THEN 'accepted' ELSE 'refused' END WHEN active = job_id AND state = 'queued' AND event = 'running' THEN 'started' WHEN active = job_id AND state = 'running' AND event IN ('succeeded', 'failed') THEN 'ended' ELSE 'ignored' END
  FROM w JOIN o ON o.version_id = w.version_id AND o.n = w.n + 1)
SELECT o.version_id, job_id, moment AS at, event, outcome FROM w JOIN o ON o.version_id = w.version_id AND o.n = w.n""")
def job_admissions(spark, d):
    """The table of events read as a stream into a table of outcomes, in the shared checkpoint folder."""
    kind = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed")
    e = spark.readStream.schema(read_table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out = job_feed.admit(e.select(F.floor(F.col("user_id") / 3).alias("version_id"), F.col("user_id").alias("job_id"), F.col("ts").alias("at"), kind.alias("event")))
    folder = new_folder(spark, "job-admissions")
    job_feed.append_to(out, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/table")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 THEN 'station' || substr(lower(c_name), 9) || '@health.vn' END AS moved, 'a' || c_custkey || '_ocr.md' AS scanned,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Bảng biểu' WHEN 'MACHINERY' THEN 'Hình ảnh' ELSE upper(substr(c_mktsegment, 1, 1)) || substr(lower(c_mktsegment), 2) END AS kind FROM customer""")
def display_names(spark, d):
    """Addresses under another domain, names of scanned texts, and what kinds of assets are called."""
    k, segment = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    address = F.concat(F.lit("mailto: "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("x"), "c_name")), F.lit("@"), segment, F.lit(".vn;"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" a"), k, F.lit(".pdf "))).when(F.col("c_custkey") % 3 == 1, "  ")
    kind = F.when(segment == "building", "table").when(segment == "machinery", "chart").otherwise(segment)
    return read_table(spark, d, "customer").select("c_custkey", T.moved_email(address, "building.vn", "health.vn", "customer", "station").alias("moved"), outline.source_name(name, F.concat(F.lit("/data/9/a"), k, F.lit(".pdf"))).alias("scanned"), outline.asset_label(kind).alias("kind"))


@query(f"""WITH {_ACCOUNTS} SELECT user_id, CASE role WHEN 'admin' THEN 'Admin' WHEN 'health_department' THEN 'Sở y tế' WHEN 'hospital' THEN 'Bệnh viện' WHEN 'health_station' THEN 'Trạm y tế' WHEN 'doctor' THEN 'Bác sĩ' END AS label FROM acc""")
def role_labels(spark, d):
    return accounts(spark, d).select("user_id", outline.role_label(F.col("role")).alias("label"))
