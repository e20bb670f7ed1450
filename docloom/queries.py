"""Registered queries of the library's own operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import account_queries, document_queries, tree_queries
from docloom.functions import text as T
from docloom.operators import access, sections, versions
from docloom.operators import users as users_ops
from docloom.plans import listing
from docloom.session import read_table
from docloom.sources import roles
from docloom.sources.roles import ACTIVE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = tree_queries.QUERIES | account_queries.QUERIES | document_queries.QUERIES
ORACLE_SQL: dict[str, str] = tree_queries.ORACLE_SQL | account_queries.ORACLE_SQL | document_queries.ORACLE_SQL

_USERS = """users AS (SELECT 1::BIGINT AS user_id, NULL::BIGINT AS parent_id, 'admin' AS role, true AS inherits UNION ALL SELECT 2, 1, 'admin', true
  UNION ALL SELECT r_regionkey + 100, CASE WHEN r_regionkey % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN r_regionkey = 4 THEN 'health_station' ELSE 'hospital' END, r_regionkey % 3 <> 0 FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100, CASE WHEN n_nationkey % 4 = 0 THEN 'health_station' ELSE 'doctor' END, n_nationkey % 3 <> 0 FROM nation),
anc AS (SELECT user_id, user_id AS ancestor_id, 0 AS distance FROM users
  UNION ALL SELECT a.user_id, u.parent_id, a.distance + 1 FROM anc a JOIN users u ON u.user_id = a.ancestor_id WHERE u.parent_id IS NOT NULL)"""
_VISIBLE = f"""{_USERS}, full_chain AS (SELECT a.*, u.role AS a_role, u.inherits AS a_inherits FROM anc a JOIN users u ON u.user_id = a.ancestor_id),
chain AS (SELECT *, distance = 0 OR a_role <> 'admin' AS near FROM full_chain c WHERE NOT EXISTS (SELECT 1 FROM full_chain b WHERE b.user_id = c.user_id AND b.a_role = 'admin' AND b.distance > 0 AND b.distance < c.distance)),
state AS (SELECT user_id, bool_or(near AND NOT a_inherits) AS shut, bool_or(NOT near) AS met, bool_or(distance = 0 AND a_role = 'admin') AS is_admin FROM chain GROUP BY user_id),
visible AS (SELECT c.user_id, ancestor_id AS owner_id FROM chain c JOIN state s ON s.user_id = c.user_id WHERE near OR NOT shut
  UNION SELECT s.user_id, x.user_id FROM state s, users x WHERE x.role = 'admin' AND s.met AND NOT s.shut AND NOT s.is_admin),
stations AS (SELECT user_id, bool_or(a_role = 'health_station') AS in_scope FROM chain GROUP BY user_id)"""
_GUIDELINES = """g AS (SELECT c_custkey AS guideline_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 'Bệnh số ' || c_custkey END AS disease, c_mktsegment AS publisher,
  CASE WHEN c_custkey % 4 = 0 THEN 'Trạm y tế' WHEN c_custkey % 4 = 1 THEN ' TRAM Y-TE' ELSE c_mktsegment END AS specialty,
  CAST(CASE WHEN c_custkey % 10 = 0 THEN 1 WHEN c_custkey % 10 = 1 THEN 2 ELSE c_nationkey + 1000 END AS BIGINT) AS owner_id FROM customer)"""
_VERSIONS = "versions AS (SELECT o_orderkey AS version_id, o_custkey AS guideline_id, CAST(o_orderdate AS DATE) AS release_date, o_orderstatus AS status, o_orderpriority AS label FROM orders)"
_SECTIONS = r"""sections AS (SELECT doc_id AS version_id, CAST(i - 1 AS INTEGER) AS pos, lines[i] AS content, CAST(CASE WHEN i > 1 THEN (i - 2) // 3 END AS INTEGER) AS parent_pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
_ACCENTS = "translate(lower(coalesce({}, '')), '{}', '{}')"


def _key(column: str) -> str:
    return f"regexp_replace({_ACCENTS.format(column, *T.accent_table())}, '[^a-z0-9]+', '', 'g')"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Access and listing


_SEARCHED = " OR ".join(f"{_key(c)} LIKE '%1%'" for c in listing.SEARCHED)


@query(f"""WITH RECURSIVE {_VISIBLE}, {_VERSIONS}, {_GUIDELINES},
seen AS (SELECT * FROM g WHERE owner_id IN (SELECT owner_id FROM visible WHERE user_id = 1007) AND ({_SEARCHED}) AND {_key('publisher')} LIKE '%e%'),
page AS (SELECT *, (SELECT count(*) FROM seen) AS total FROM seen ORDER BY guideline_id DESC LIMIT 20),
act AS (SELECT *, row_number() OVER (PARTITION BY guideline_id ORDER BY release_date DESC NULLS LAST, version_id DESC) AS n FROM versions WHERE lower(status) = 'o')
SELECT page.guideline_id, title, publisher, page.owner_id, CASE WHEN u.role = 'admin' THEN 'global' WHEN page.owner_id = 1007 THEN 'owned' ELSE 'inherited' END AS scope, false AS can_manage, act.version_id, act.release_date, total
FROM page LEFT JOIN users u ON u.user_id = page.owner_id LEFT JOIN act ON act.guideline_id = page.guideline_id AND act.n = 1""")
def list_guidelines_page(spark, d):
    return listing.list_guidelines(roles.guidelines(spark, d), roles.versions(spark, d), roles.users(spark, d), 1007, "doctor", ACTIVE, search=" 1 ", page=1, page_size=20, publisher="E")


@query(f"""WITH RECURSIVE {_VISIBLE}, {_GUIDELINES} SELECT guideline_id, owner_id FROM g WHERE owner_id IN (SELECT owner_id FROM visible WHERE user_id = 1004) AND {_key('specialty')} = 'tramyte' AND (SELECT in_scope FROM stations WHERE user_id = 1004)""")
def station_guidelines(spark, d):
    return listing.tenant_guidelines(roles.guidelines(spark, d), roles.users(spark, d), 1004, "health_station").select("guideline_id", "owner_id")


@query(f"WITH {_GUIDELINES} SELECT guideline_id FROM g WHERE owner_id = 2")
def guidelines_of_owner(spark, d):
    return listing.tenant_guidelines(roles.guidelines(spark, d), roles.users(spark, d), 1, "admin", owner_id=2).select("guideline_id")


@query(f"WITH RECURSIVE {_VISIBLE}, {_GUIDELINES} SELECT count(*) AS total FROM g WHERE owner_id IN (SELECT owner_id FROM visible WHERE user_id = 1007)")
def count_guidelines(spark, d):
    return listing.total(listing.visible_guidelines(roles.guidelines(spark, d), roles.users(spark, d), 1007, "doctor"))


@query(f"WITH {_VERSIONS} SELECT version_id, release_date, status FROM versions WHERE guideline_id = 85 AND lower(status) = 'f' ORDER BY release_date DESC NULLS LAST, version_id DESC LIMIT 5")
def list_versions(spark, d):
    return listing.list_versions(roles.guidelines(spark, d), roles.versions(spark, d), roles.users(spark, d), 1, "admin", 85, status=" F", page_size=5).select("version_id", "release_date", "status")


@query(f"WITH RECURSIVE {_VISIBLE} SELECT user_id, owner_id FROM visible")
def visible_owners(spark, d):
    return access.visible_owners(roles.users(spark, d))


@query(f"WITH RECURSIVE {_USERS} SELECT user_id, ancestor_id, distance FROM anc")
def user_ancestors(spark, d):
    return access.ancestors(roles.users(spark, d))


@query(f"WITH RECURSIVE {_USERS} SELECT ancestor_id AS user_id, max(distance) AS height FROM anc GROUP BY ancestor_id")
def subtree_height(spark, d):
    return access.subtree_height(roles.users(spark, d))


@query(f"WITH RECURSIVE {_VISIBLE} SELECT user_id, in_scope FROM stations")
def station_scope(spark, d):
    return access.station_scope(roles.users(spark, d))


@query(f"SELECT c_custkey, {_key('c_name')} AS name_key, {_key('c_mktsegment')} AS segment_key FROM customer")
def search_keys(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", T.search_key(F.col("c_name")).alias("name_key"), T.search_key(F.col("c_mktsegment")).alias("segment_key"))


@query("SELECT DISTINCT c_mktsegment AS publisher FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
def filter_options(spark, d):
    return listing.filter_options(roles.guidelines(spark, d), "publisher")


# Versions and snapshots


@query(f"WITH {_VERSIONS} SELECT guideline_id, version_id, release_date, status, label FROM (SELECT *, row_number() OVER (PARTITION BY guideline_id ORDER BY release_date DESC NULLS LAST, version_id DESC) AS n FROM versions WHERE lower(coalesce(status, '')) = 'o') WHERE n = 1")
def active_versions(spark, d):
    return versions.active_versions(roles.versions(spark, d), ACTIVE)


@query("SELECT o_custkey AS guideline_id, count(*) AS n_versions, CAST(count(*) + 1 AS VARCHAR) AS next_label FROM orders GROUP BY o_custkey")
def count_versions(spark, d):
    return versions.count_by(roles.versions(spark, d), "guideline_id", "n_versions").withColumn("next_label", versions.next_label(F.col("n_versions")))


@query(f"""WITH {_VERSIONS}, keep AS (SELECT guideline_id, max(version_id) AS keep_id FROM versions GROUP BY guideline_id)
SELECT v.guideline_id, version_id, release_date, CASE WHEN lower(status) = 'o' AND version_id <> keep_id THEN 'inactive' ELSE status END AS status, label FROM versions v LEFT JOIN keep k ON k.guideline_id = v.guideline_id""")
def deactivate_versions(spark, d):
    v = roles.versions(spark, d)
    return versions.deactivate_others(v, v.groupBy("guideline_id").agg(F.max("version_id").alias("keep_id")), ACTIVE)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def cascade_delete(spark, d):
    doomed = read_table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return versions.survivors(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), doomed, "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def guidelines_without_versions(spark, d):
    g, v = read_table(spark, d, "customer"), roles.versions(spark, d).where("status = 'P'").select(F.col("guideline_id").alias("c_custkey"))
    return versions.without(g, v, "c_custkey").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN c_custkey % 10 < 2 OR c_custkey IS NULL THEN -1 ELSE c.c_nationkey + 1000 END AS BIGINT) AS owner_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer c ON c_custkey = o_custkey")
def backfill_owner(spark, d):
    documents = read_table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("version_id"), F.lit(None).cast("long").alias("owner_id"))
    found = versions.backfill_owner(documents, roles.versions(spark, d), roles.guidelines(spark, d).withColumn("owner_id", F.when(F.col("owner_id") > 2, F.col("owner_id"))), -1)
    return found.select(F.col("version_id").alias("l_orderkey"), "l_linenumber", "owner_id")


@query("SELECT o.o_orderkey, o.o_custkey, count(*) AS n_documents, sum(l_quantity) AS quantity FROM orders o JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o.o_orderkey GROUP BY ALL")
def documents_of_versions(spark, d):
    li, o, c = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("n_documents"), F.sum("l_quantity").alias("quantity"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_guidelines(spark, d):
    c = read_table(spark, d, "customer")
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.create_map(F.lit("c_name"), F.concat(F.lit("new "), F.col("c_custkey").cast("string")), F.lit("c_mktsegment"), F.lit(None).cast("string")).alias("patch"))
    return versions.patch(c, "c_custkey", changes)


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def keep_first(spark, d):
    return versions.first_by(read_table(spark, d, "part"), ["p_name"], [F.col("p_partkey")]).select("p_name", "p_partkey", "p_brand")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag = 'R' ELSE l_discount < 0.05 END AS is_suspect FROM lineitem")
def suspect_flags(spark, d):
    score = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sections.is_suspect(score, F.col("l_returnflag") == "R", 0.05).alias("is_suspect"))


# Jobs

_JOBS = "jobs AS (SELECT event_id AS job_id, user_id AS version_id, ts AS requested_at, event_type AS status FROM events)"


@query(f"""WITH {_JOBS}, latest AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY requested_at DESC, job_id DESC) AS n FROM jobs)
SELECT c_custkey AS version_id, coalesce(l.status, 'idle') AS status, s.succeeded_at FROM customer LEFT JOIN latest l ON l.version_id = c_custkey AND n = 1
LEFT JOIN (SELECT version_id, max(requested_at) AS succeeded_at FROM jobs WHERE status = 'purchase' GROUP BY version_id) s ON s.version_id = c_custkey""")
def job_status(spark, d):
    return versions.job_status(read_table(spark, d, "customer").select(F.col("c_custkey").alias("version_id")), roles.jobs(spark, d), "purchase")


@query(f"""WITH {_JOBS} SELECT version_id, job_id, requested_at, status FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY requested_at, job_id) AS n FROM jobs
WHERE status <> 'error' AND version_id NOT IN (SELECT version_id FROM jobs WHERE status = 'error' AND job_id % 7 = 0)) WHERE n = 1""")
def enqueue_jobs(spark, d):
    j = roles.jobs(spark, d)
    return versions.enqueue(j.where("status <> 'error'"), j.where("job_id % 7 = 0"), ("error",))


@query(f"WITH {_JOBS} SELECT status, count(*) AS n, min(requested_at) AS earliest FROM jobs GROUP BY status")
def job_counters(spark, d):
    return versions.outcomes(roles.jobs(spark, d))


# Sections


@query(f"WITH {_SECTIONS} SELECT version_id, pos, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY version_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sections")
def section_offsets(spark, d):
    return sections.with_offsets(roles.sections(spark, d)).select("version_id", "pos", "start")


@query(f"""WITH {_SECTIONS}, a AS (SELECT *, CASE WHEN pos % 3 = 0 THEN pos * 10 ELSE -1 END AS anchor FROM sections)
SELECT version_id, pos, CAST(coalesce(min(CASE WHEN anchor >= 0 THEN anchor END) OVER (PARTITION BY version_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1000000) AS INTEGER) AS until FROM a""")
def next_anchor(spark, d):
    s = roles.sections(spark, d).withColumn("anchor", F.when(F.col("pos") % 3 == 0, F.col("pos") * 10).otherwise(-1))
    return sections.next_anchor(s, end=F.lit(10**6)).select("version_id", "pos", "until")


@query(f"WITH {_SECTIONS} SELECT version_id, pos FROM (SELECT *, lag(content) OVER (PARTITION BY version_id ORDER BY pos) AS b FROM sections) WHERE b IS NULL OR b <> content")
def consecutive_dedup(spark, d):
    return sections.drop_consecutive_repeats(roles.sections(spark, d)).select("version_id", "pos")


@query(f"WITH {_SECTIONS} SELECT version_id, pos, max(CASE WHEN length(content) < 30 THEN pos END) OVER (PARTITION BY version_id ORDER BY pos) AS heading_pos FROM sections")
def last_heading(spark, d):
    return sections.last_heading(roles.sections(spark, d), F.length("content") < 30).select("version_id", "pos", "heading_pos")


@query(r"""WITH c AS (SELECT doc_id % 40 AS version_id, doc_id || '-' || (i - 1) AS id, lines[i] AS text, CASE WHEN (i - 1) % 3 = 2 THEN 'figure' ELSE 'text' END AS type, CASE WHEN (i - 1) % 7 <> 6 THEN (i - 1) % 10 / 10.0 + 0.05 END AS top
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
b AS (SELECT version_id, id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM c WHERE type = 'text' AND (top < 0.10 OR top > 0.85)),
k AS (SELECT version_id, id, lower(regexp_replace(regexp_replace(regexp_replace(bare, '^\d{1,4}\s*[|/\-]\s*', ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS key FROM b WHERE length(bare) <= 200)
SELECT version_id, id, count(*) OVER (PARTITION BY version_id, key) AS times FROM k WHERE key <> '' QUALIFY count(*) OVER (PARTITION BY version_id, key) >= 3""")
def repeated_noise(spark, d):
    return sections.repeated_noise(roles.chunks(spark, d), 3).select("version_id", "id", "times")


@query(f"WITH {_SECTIONS} SELECT s.version_id, s.pos, p.pos IS NULL AS is_root, length(p.content) AS parent_length FROM sections s LEFT JOIN sections p ON p.version_id = s.version_id AND p.pos = s.parent_pos")
def section_parents(spark, d):
    return sections.with_parents(roles.sections(spark, d)).select("version_id", "pos", "is_root", F.length("parent_content").alias("parent_length"))


@query(f"WITH {_SECTIONS} SELECT version_id, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY pos) FILTER (content <> ''), '') AS full_text FROM sections GROUP BY version_id")
def full_text(spark, d):
    return sections.full_text(roles.sections(spark, d))


@query(f"WITH {_SECTIONS} SELECT version_id, parent_pos, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS children, count(*) AS n_children FROM sections WHERE parent_pos IS NOT NULL GROUP BY ALL")
def section_children(spark, d):
    return sections.children(roles.sections(spark, d))


@query(f"WITH {_SECTIONS} SELECT version_id, pos, CAST(row_number() OVER (PARTITION BY version_id, parent_pos ORDER BY pos) AS INTEGER) AS sibling FROM sections")
def sibling_numbers(spark, d):
    return sections.sibling_numbers(roles.sections(spark, d)).select("version_id", "pos", "sibling")


@query(f"WITH {_SECTIONS}, b AS (SELECT version_id, max(pos) AS last FROM sections GROUP BY version_id) SELECT s.version_id, s.pos, CAST(k.batch AS INTEGER) AS batch FROM sections s JOIN b ON b.version_id = s.version_id, LATERAL (SELECT unnest(range(0, b.last // 7 + 1)) AS batch) k WHERE s.pos BETWEEN k.batch * 7 AND k.batch * 7 + 9")
def overlapping_batches(spark, d):
    return sections.overlapping_batches(roles.sections(spark, d), 10, 3).select("version_id", "pos", "batch")


@query(f"""WITH {_SECTIONS} SELECT version_id, pos, round(coalesce(sum(w) OVER (PARTITION BY version_id, coalesce(parent_pos, -1) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY version_id, coalesce(parent_pos, -1)), 9) AS place,
  round(sum(w) OVER (PARTITION BY version_id, coalesce(parent_pos, -1) ORDER BY pos) / sum(w) OVER (PARTITION BY version_id, coalesce(parent_pos, -1)), 9) AS until
FROM (SELECT *, CASE WHEN sum(length(content)) OVER (PARTITION BY version_id, parent_pos) > 0 THEN length(content) ELSE 1 END AS w FROM sections)""")
def shared_anchor_spread(spark, d):
    s = roles.sections(spark, d).withColumn("p", F.coalesce("parent_pos", F.lit(-1)))
    return sections.spread(s, ["version_id", "p"], "pos", F.length("content")).select("version_id", "pos", F.round("place", 9).alias("place"), F.round("until", 9).alias("until"))


@query("SELECT l_orderkey, l_suppkey % 3 AS page, round(min(l_discount), 6) AS \"left\", round(min(l_tax), 6) AS top, round(max(l_discount + 0.1), 6) AS \"right\", round(max(l_tax + 0.2), 6) AS bottom FROM lineitem GROUP BY ALL")
def bounding_boxes(spark, d):
    b = read_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("page"), F.col("l_discount").alias("left"), F.col("l_tax").alias("top"), (F.col("l_discount") + 0.1).alias("right"), (F.col("l_tax") + 0.2).alias("bottom"))
    return sections.bounding_boxes(b, ["l_orderkey", "page"])


@query("""WITH i AS (SELECT l_orderkey AS v, l_linenumber AS id, CAST(l_quantity AS INTEGER) % 10 AS f, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) % 10 + l_linenumber END AS l FROM lineitem),
p AS (SELECT o_orderkey AS v, CAST(o_custkey % 12 AS INTEGER) AS page FROM orders)
SELECT version_id, page, interval_id FROM (SELECT p.v AS version_id, page, id AS interval_id, row_number() OVER (PARTITION BY p.v, page ORDER BY coalesce(l, f) - f, f DESC, id DESC) AS n FROM p JOIN i ON i.v = p.v AND page BETWEEN f AND coalesce(l, f)) WHERE n = 1""")
def locate_page(spark, d):
    q = F.col("l_quantity").cast("int") % 10
    i = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("interval_id"), q.alias("first"), F.when(F.col("l_linenumber") % 3 != 0, q + F.col("l_linenumber")).alias("last")).distinct()
    p = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_custkey") % 12).cast("int").alias("page"))
    return sections.best_interval(p, i)


# Text


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(w, b)) / (len(w) + len(b)) END, 9) AS dice FROM p WHERE b IS NOT NULL""")
def turn_overlap(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    c = c.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return c.select("conv_id", "turn", F.round(T.dice(F.col("w"), F.col("before")), 9).alias("dice"))


@query(r"""WITH p AS (SELECT page_id, replace(html, '<h1>', '<!-- page BREAK --><A class="x"></a><a name=y>z</a>') AS html FROM pages),
q AS (SELECT page_id, html, regexp_replace(html, '(?i)<a\s[^>]*></a>', '', 'g') AS a FROM p), b AS (SELECT *, regexp_replace(a, '(?i)<!--\s*PAGE\s*BREAK\s*-->', '<$BREAK$>', 'g') AS b FROM q),
c AS (SELECT *, replace(regexp_replace(b, '(?is)<!--.*?-->', '', 'g'), '<$BREAK$>', '<!-- PAGE_BREAK -->') AS c FROM b)
SELECT page_id, md5(c) AS clean_md5, length(c) AS found, length(html) - length(a) AS anchors, (length(c) - length(replace(c, '<!-- PAGE_BREAK -->', ''))) // 19 AS breaks, true AS as_expected FROM c""")
def clean_markup(spark, d):
    html = F.replace("html", F.lit("<h1>"), F.lit('<!-- page BREAK --><A class="x"></a><a name=y>z</a>'))
    p = read_table(spark, d, "pages").select("page_id", T.clean_markup(html).alias("clean"), T.cleaning_audit(html).alias("audit"))
    breaks = (F.length("clean") - F.length(F.replace("clean", F.lit(T.PAGE_BREAK), F.lit("")))) / 19
    return p.select("page_id", F.md5(F.col("clean").cast("binary")).alias("clean_md5"), F.length("clean").cast("long").alias("found"), F.col("audit.anchors").cast("long").alias("anchors"), breaks.cast("long").alias("breaks"), F.expr("audit.expected = audit.found and audit.same_breaks").alias("as_expected"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '(?m)^[ \t]*\d+[ \t]*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""")
def section_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(T.section_text(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT c_custkey, e AS email, regexp_full_match(e, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS valid FROM (SELECT c_custkey, regexp_replace(lower(c_name), '#', '.') || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '@' || lower(c_mktsegment) || '.vn' END AS e FROM customer)")
def import_emails(spark, d):
    raw = F.concat(F.lit(" mailto:"), F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit(" @"), "c_mktsegment", F.lit(".VN"))), F.lit(" ;"))
    e = T.email(raw)
    return read_table(spark, d, "customer").select("c_custkey", e.alias("email"), T.is_email(e).alias("valid"))


@query("SELECT page_id, substr(sha1(url), 1, 12) AS node_id, CASE WHEN length(html) = 0 THEN 0 ELSE (length(html) - length(replace(html, '<li>', ''))) // 4 + 1 END AS n_parts FROM pages")
def page_nodes(spark, d):
    return read_table(spark, d, "pages").select("page_id", T.node_id(F.col("url")).alias("node_id"), T.page_count(F.col("html"), "<li>").alias("n_parts"))


@query("SELECT label, count(*) AS n, sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END) AS n_right_size FROM embeddings GROUP BY label")
def embedding_sizes(spark, d):
    return read_table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum((F.size("embedding") == 64).cast("int")).alias("n_right_size"))


@query("""SELECT s_suppkey, CASE WHEN c.c_custkey IS NULL THEN 'create' WHEN c.c_nationkey = s_nationkey THEN 'skip' ELSE 'conflict' END AS action FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey * 20""")
def reconcile_import(spark, d):
    accounts = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 20).cast("string").alias("email"), F.col("s_nationkey").alias("name"))
    users = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("email"), F.col("c_nationkey").alias("name"))
    return users_ops.import_actions(accounts, users).select("s_suppkey", "action")
