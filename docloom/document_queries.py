"""Registered queries of texts, contents, chunks and places on pages, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import jsons, markup, outline
from docloom.functions import text as T
from docloom.operators import boundaries, chunks, positions, sections, toc
from docloom.plans import workspace
from docloom.session import read_table
from docloom.sources import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SECTIONS = r"""sections AS (SELECT doc_id AS version_id, CAST(i - 1 AS INTEGER) AS pos, lines[i] AS content
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Texts


@query(rf"""WITH {_SECTIONS}, s AS (SELECT version_id AS doc_id, pos AS number, CASE WHEN content <> '' AND length(content) < 70 AND pos % 2 = 0 THEN repeat('#', length(content) % 7 + 1) || ' ' || content WHEN length(content) % 5 = 0 THEN '**' || content || '**' WHEN length(content) % 5 = 1 THEN '<b>' || pos || '.' || (pos % 4) || '. ' || content || '</b>' ELSE content END AS line FROM sections),
a AS (SELECT doc_id, number, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM s), b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), '<::.*?::>', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(plain, '\*{{1,3}}|_{{1,3}}', '', 'g'), '^\s+|\s+$', '', 'g') AS c, regexp_extract(s, '^(#{{1,6}})\s+(.+)', 1) AS marks, regexp_replace(regexp_replace(regexp_extract(s, '^(#{{1,6}})\s+(.+)', 2), '\*{{1,3}}|_{{1,3}}', '', 'g'), '^\s+|\s+$', '', 'g') AS marked FROM b),
h AS (SELECT doc_id, number, CASE WHEN regexp_full_match(s, '[\d\s,.\-/]*') OR c = '' THEN NULL WHEN marks <> '' THEN CASE WHEN marked <> '' THEN marks || ' ' || marked END WHEN regexp_matches(lower(c), '^(chương|phần|bước|mục|điều|phụ lục|phụlục|chuyên đề|chuyênđề|phan|chuong|buoc|muc|dieu)\s+\S') OR regexp_matches(c, '(?i)^(XIV|XIII|XII|XI|IX|VIII|VII|VI|IV|III|II|XV|I|X|V)\.\s+\S') THEN c
  WHEN regexp_matches(c, '^\d+(\.\d+)*\s*[.)]\s*.+') THEN CASE WHEN contains(regexp_extract(c, '^(\d+(\.\d+)*)', 1), '.') THEN c END
  WHEN length(c) > 4 AND c = upper(c) AND NOT contains(c, 'ß') AND NOT regexp_full_match(c, '[\-=*_\s|/\\.]+') AND NOT regexp_full_match(c, '[\d\s,.\-/]+') AND (length(c) >= 10 OR contains(c, ' ')) THEN c END AS heading FROM c)
SELECT doc_id, number, heading FROM (SELECT *, lag(heading) OVER (PARTITION BY doc_id ORDER BY number) AS b FROM h WHERE heading IS NOT NULL) WHERE b IS NULL OR b <> heading""")
def heading_outline(spark, d):
    """Whole documents, short lines marked with up to seven marks, others bold or numbered inside tags."""
    lit = F.lit

    def marked(c, p):
        n = F.length(c)
        line = F.when((c != "") & (n < 70) & (p % 2 == 0), F.concat(F.repeat(lit("#"), n % 7 + 1), lit(" "), c)).when(n % 5 == 0, F.concat(lit("**"), c, lit("**")))
        return line.when(n % 5 == 1, F.concat(lit("<b>"), p.cast("string"), lit("."), (p % 4).cast("string"), lit(". "), c, lit("</b>"))).otherwise(c)

    text = F.array_join(F.transform(F.split("text", "\n"), marked), "\n")
    return outline.heading_outline(read_table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query(rf"""WITH {_SECTIONS}, t AS (SELECT version_id, pos, CASE length(content) % 6 WHEN 0 THEN '## ' || content WHEN 1 THEN ' Chương ' || pos || '.' || length(content) || ' ' || content WHEN 2 THEN pos || '.' || (length(content) % 7) || '. ' || content WHEN 3 THEN 'TÀI  LIỆU ' || pos || ' ' || content WHEN 4 THEN 'annex ' || pos || ' ' || content ELSE pos || ' ' || content END AS raw FROM sections),
k AS (SELECT version_id, pos, regexp_replace(regexp_replace(raw, '^#+\s*', ''), '^\s+|\s+$', '', 'g') AS title FROM t), m AS (SELECT *, regexp_extract(title, '^(\d+(?:\.\d+)*)[.\s]', 1) AS number, regexp_replace(regexp_extract(title, '^\S*', 0), '\.+$', '') AS first, '(?i)^(tài\s*liệu|chương|phần|mục|bài)\s+([0-9]+|[IVX]+)' AS p FROM k)
SELECT version_id, pos, CASE WHEN regexp_matches(title, p) THEN regexp_replace(lower(regexp_extract(title, p, 1)), '\s+', '', 'g') || ' ' || upper(regexp_extract(title, p, 2)) ELSE '' END AS key, md5(title) AS title, CASE WHEN number <> '' THEN length(number) - length(replace(number, '.', '')) + 1 WHEN regexp_matches(title, '(?i)^Annex\s+\d+') THEN 1 ELSE 9 END AS level,
  CASE WHEN regexp_matches(title, '(?i)^(CHƯƠNG|PHẦN)\s+[IVX\d]+') OR regexp_matches(title, '^\d+(\.\d+)*[\s.)]') THEN length(first) - length(replace(first, '.', '')) + 1 END AS number_level FROM m""")
def title_keys(spark, d):
    """The lines of documents as titles, marked and numbered by their lengths."""
    n, c, p = F.length("content"), F.col("content"), F.col("pos").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    title = F.when(n % 6 == 0, text("## ", c)).when(n % 6 == 1, text(" Chương ", p, ".", n.cast("string"), " ", c)).when(n % 6 == 2, text(p, ".", (n % 7).cast("string"), ". ", c))
    title = title.when(n % 6 == 3, text("TÀI  LIỆU ", p, " ", c)).when(n % 6 == 4, text("annex ", p, " ", c)).otherwise(text(p, " ", c))
    s = roles.sections(spark, d).select("version_id", "pos", outline.title_key(title).alias("title"))
    t = F.col("title")
    return s.select("version_id", "pos", F.coalesce(F.array_join(outline.structural_key(t), " "), F.lit("")).alias("key"), F.md5("title").alias("title"), outline.corrected_level(t, F.lit(9)).alias("level"), outline.number_level(t).alias("number_level"))


@query(r"""SELECT page_id, md5(substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<a[^>]+>.*?</a>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, CASE WHEN page_id % 2 = 0 THEN 1500 ELSE 1100 END)) AS preview_md5 FROM pages""")
def chunk_previews(spark, d):
    p = read_table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 2 == 0, "text").otherwise("table")
    return p.select("page_id", F.md5(outline.preview(F.col("html"), kind).cast("binary")).alias("preview_md5"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)</?(?:table|thead|tbody|tfoot|tr)(?:\s[^>]*)?>', chr(10), 'g'), '(?i)<(?:td|th)(?:\s[^>]*)?>', '', 'g'), '(?i)</(?:td|th)>', '  |  ', 'g') AS t FROM (SELECT page_id, replace(replace(html, '<li>', '<td>'), '</li>', '</td></tr>') AS html FROM pages))
SELECT page_id, md5(trim(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '\s*\d{1,4}\s*')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS plain_md5 FROM t""")
def plain_tables(spark, d):
    html = F.replace(F.replace("html", F.lit("<li>"), F.lit("<td>")), F.lit("</li>"), F.lit("</td></tr>"))
    return read_table(spark, d, "pages").select("page_id", F.md5(outline.without_tables(html).cast("binary")).alias("plain_md5"))


@query(r"""WITH t AS (SELECT doc_id, text || chr(10) || CASE n_chars % 4 WHEN 0 THEN 'ISBN (e-book) 978-' || lpad(CAST(n_chars AS VARCHAR), 9, '1') || chr(10) || 'isbn: 979-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || 'X' WHEN 1 THEN 'ISBN 978-' || lpad(CAST(n_chars AS VARCHAR), 9, '2') || ' ISBN: 978-' || lpad(CAST(doc_id AS VARCHAR), 9, '3') WHEN 2 THEN 'ISSN: 1234-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || 'X' || chr(10) || 'No. ' || doc_id || '/' || (1950 + n_chars % 100) ELSE 'Published by ' || source || ', ' || lang || ' ' || (1950 + n_chars % 100) END AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, 'ISBN[:\s]+([\d\-X]{10,17})', 1) AS bare, regexp_extract(text, '(?i)ISBN\s*[(（]?(?:electronic|online|e-?book|epub)[)）]?\s*[:\-]?\s*([\d\-X]{10,17})', 1) AS e, regexp_extract(text, '(?i)ISBN\s*[(（]?(?:print|hardcover|softcover|pbk)?[)）]?\s*[:\-]?\s*([\d\-X]{10,17})', 1) AS p,
  regexp_extract(text, '(?i)ISSN[:\s]+(\d{4}-\d{3}[\dX])', 1) AS issn, regexp_extract(text, '(?i)(?:WHO/[\w/\-.]+|No\.?\s*[\w/\-.]+(?:/\d{4})|(?:Thông tư|Nghị định|Quyết định)\s+[\d/\-]+(?:/\w+)*)', 0) AS decision, regexp_extract(text, '\b(?:19|20)\d{2}\b', 0) AS date, regexp_matches(text, '(?i)World Health Organization|WHO\b') AS who,
  regexp_extract(text, '(?i)((?:Published by|©\s*\d{4}\s+)[^\n]{0,80})', 1) AS named, regexp_extract(text, '(?i)(?:sexually transmitted|STI|HIV|antibiotic|dược lâm sàng|oncology)', 0) AS topic FROM t)
SELECT doc_id, coalesce(nullif(e, ''), bare[2]) AS isbn_electronic, coalesce(nullif(p, ''), bare[1]) AS isbn_print, nullif(issn, '') AS issn, trim(nullif(decision, '')) AS decision, nullif(date, '') AS date, CASE WHEN who THEN 'World Health Organization' ELSE trim(substr(nullif(named, ''), 1, 80)) END AS publisher, nullif(topic, '') AS specialty FROM m""")
def scrape_metadata(spark, d):
    """What whole documents tell, with an imprint behind them made of their columns."""
    n, k, lit = F.col("n_chars"), F.col("doc_id"), F.lit
    pad = lambda c, size, fill: F.lpad(c.cast("string"), size, fill)
    year = (1950 + n % 100).cast("string")
    imprint = F.when(n % 4 == 0, F.concat(lit("ISBN (e-book) 978-"), pad(n, 9, "1"), lit("\nisbn: 979-"), pad(k, 8, "0"), lit("X"))).when(n % 4 == 1, F.concat(lit("ISBN 978-"), pad(n, 9, "2"), lit(" ISBN: 978-"), pad(k, 9, "3")))
    imprint = imprint.when(n % 4 == 2, F.concat(lit("ISSN: 1234-"), pad(k % 1000, 3, "0"), lit("X\nNo. "), k.cast("string"), lit("/"), year)).otherwise(F.concat(lit("Published by "), "source", lit(", "), "lang", lit(" "), year))
    t = read_table(spark, d, "documents").select("doc_id", F.concat("text", lit("\n"), imprint).alias("text"))
    names = ("isbn_electronic", "isbn_print", "issn", "decision", "date", "publisher", "specialty")
    return t.select("doc_id", outline.metadata(F.col("text")).alias("m")).select("doc_id", *(f"m.{x}" for x in names))


@query(r"""WITH p AS (SELECT doc_id % 50 AS version_id, doc_id // 50 AS page, text FROM documents), l AS (SELECT version_id, page, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM p WHERE page < 8)
SELECT version_id, count(DISTINCT page) FILTER (WHERE lower(line) IN ('mục lục', 'muc luc', 'table of contents', 'contents')) AS heading_hits, count(*) FILTER (WHERE length(line) >= 8 AND (contains(line, '...') AND regexp_matches(line, '\d$') OR regexp_matches(line, '^(?:\d+(?:\.\d+)*|[A-Z]\.?)\s+.+\s+\d{1,4}$'))) AS entries FROM l GROUP BY version_id""")
def toc_metrics(spark, d):
    p = read_table(spark, d, "documents").select((F.col("doc_id") % 50).alias("version_id"), F.floor(F.col("doc_id") / 50).alias("page"), "text")
    return outline.toc_metrics(p).select("version_id", "heading_hits", "entries")


@query(r"""WITH p AS (SELECT doc_id % 50 AS version_id, doc_id // 50 AS page, coalesce(text, '') AS text FROM documents)
SELECT version_id, CAST(sum(len(list_filter(regexp_split_to_array(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+'), lambda w: length(w) >= 2))) AS BIGINT) AS words, CAST(sum(length(regexp_replace(lower(text), '[^ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹíìỉĩịóòỏõọúùủũụýỳỷỹỵ]', '', 'g'))) AS BIGINT) AS letters FROM p WHERE page < 5 GROUP BY version_id""")
def text_metrics(spark, d):
    p = read_table(spark, d, "documents").select((F.col("doc_id") % 50).alias("version_id"), F.floor(F.col("doc_id") / 50).alias("page"), "text")
    return outline.text_metrics(p).select("version_id", F.col("words").cast("long").alias("words"), F.col("letters").cast("long").alias("letters"))


@query("""WITH m AS (SELECT o_orderkey AS version_id, o_orderkey % 30 AS page_count, o_orderkey % 7 = 0 AS vietnamese, o_custkey % 3 <> 0 AS outline_root, o_custkey % 11 AS entries, o_custkey % 8 AS actionable, o_orderkey % 90 AS words, o_orderkey % 4 = 0 AS weak FROM orders)
SELECT version_id, CASE WHEN page_count = 0 THEN 'empty_pdf' WHEN vietnamese THEN 'detected_vietnamese_forced_ocr' WHEN NOT (outline_root AND entries >= 1 AND actionable / entries >= 0.7) THEN 'missing_native_outline_tree' WHEN words < 30 THEN 'native_outline_but_text_layer_unextractable'
  WHEN weak THEN 'extractable_text_but_weak_document_structure' ELSE 'native_outline_tree_and_extractable_text' END AS reason FROM m""")
def route_documents(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = read_table(spark, d, "orders").select(k.alias("version_id"), (k % 30).alias("page_count"), (k % 7 == 0).alias("vietnamese"), (c % 3 != 0).alias("outline_root"), (c % 11).alias("entries"), (c % 8).alias("actionable"), (k % 90).alias("words"), (k % 4 == 0).alias("weak"))
    return toc.route(m).select("version_id", "reason")


@query(rf"""WITH {_SECTIONS}, l AS (SELECT version_id, content AS c FROM sections),
m AS (SELECT d.doc_id AS version_id, source AS creator, CAST(length(text) // 500 + 1 AS BIGINT) AS page_count, count(c) FILTER (length(c) BETWEEN 1 AND 60) AS entries, count(c) FILTER (length(c) BETWEEN 1 AND 60 AND NOT regexp_matches(c, '\d')) AS actionable, CASE WHEN bool_or(contains(c, ':')) THEN 2 ELSE 1 END AS depth, lang = 'en' AS visible, source = 'web' AS struct_tree,
  CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS words FROM documents d LEFT JOIN l ON l.version_id = d.doc_id GROUP BY ALL),
x AS (SELECT *, entries >= 1 AND actionable >= CAST(0.7 AS DOUBLE) * entries AS native, entries >= 8 AND (depth >= 2 OR entries >= CAST(0.12 AS DOUBLE) * page_count) AS rich FROM m WHERE page_count IS NOT NULL),
y AS (SELECT *, native AND CASE WHEN contains(creator, 'coreldraw') AND NOT visible THEN true ELSE NOT (visible OR struct_tree OR rich) AND depth <= 1 AND entries <= least(6, greatest(3, page_count // 8)) END AS weak FROM x)
SELECT version_id, rich, weak, CASE WHEN NOT native THEN 'missing_native_outline_tree' WHEN words < 30 THEN 'native_outline_but_text_layer_unextractable' WHEN weak THEN 'extractable_text_but_weak_document_structure' ELSE 'native_outline_tree_and_extractable_text' END AS reason FROM y""")
def document_structure(spark, d):
    """Short lines as bookmarks, those without a digit leading somewhere: which documents have a rich or a weak structure, and the way each goes."""
    t, lines = F.col("text"), F.filter(F.split("text", "\n"), lambda x: F.length(x).between(1, 60))
    m = read_table(spark, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("version_id"), F.col("source").alias("creator"), (F.floor(F.length(t) / 500) + 1).alias("page_count"), F.lit(True).alias("outline_root"),
        F.size(lines).cast("long").alias("entries"), F.size(F.filter(lines, lambda x: ~x.rlike(r"[0-9]"))).cast("long").alias("actionable"), F.when(t.contains(":"), 2).otherwise(1).alias("depth"), (F.col("lang") == "en").alias("visible"),
        (F.col("source") == "web").alias("struct_tree"), (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("long").alias("words"), *(F.lit(None).cast("string").alias(c) for c in ("title", "producer", "format")), F.lit(None).cast("boolean").alias("vietnamese"),
    )
    return toc.route(toc.with_structure(m)).select("version_id", "rich", "weak", "reason")


@query(rf"""WITH {_SECTIONS} SELECT version_id, pos, trim(regexp_replace(translate(lower(substr(content, 1, 60)), '{T.accent_table()[0]}', '{T.accent_table()[1]}'), '[^a-z0-9]+', ' ', 'g')) AS header,
  substr(regexp_replace(regexp_replace(regexp_replace(content, '[^\pL\pM\pN_\s.\-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), 1, 80) AS file_name FROM sections""")
def header_keys(spark, d):
    s = roles.sections(spark, d)
    return s.select("version_id", "pos", outline.header_key(F.substring("content", 1, 60)).alias("header"), outline.safe_name(F.col("content")).alias("file_name"))


@query(rf"""WITH {_SECTIONS}, t AS (SELECT version_id, pos, regexp_replace(content, '^\s+|\s+$', '', 'g') AS a, regexp_replace(coalesce(lead(content) OVER (PARTITION BY version_id ORDER BY pos), ''), '^\s+|\s+$', '', 'g') AS b, CASE WHEN length(content) < 60 THEN trim(content) ELSE '' END AS h FROM sections)
SELECT version_id, pos, md5(a || CASE WHEN a <> '' AND b <> '' THEN chr(10) || chr(10) ELSE '' END || b) AS text, CASE WHEN h <> '' THEN h WHEN pos % 2 = 0 THEN 'Section ' || version_id || '.' || pos ELSE 'Section ' || pos END AS label FROM t""")
def section_labels(spark, d):
    """Lines joined with the next, and what they are called: short ones by their text, others by a path or their number."""
    after = F.lead("content").over(Window.partitionBy("version_id").orderBy("pos"))
    s = roles.sections(spark, d).select("version_id", "pos", "content", after.alias("after"))
    path = F.when(F.col("pos") % 2 == 0, F.concat_ws(".", "version_id", "pos")).otherwise(" ")
    label = outline.section_label(F.when(F.length("content") < 60, F.col("content")), path, F.col("pos"))
    return s.select("version_id", "pos", F.md5(outline.joined(F.col("content"), F.lit("  "), F.col("after"))).alias("text"), label.alias("label"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), t AS (SELECT doc_id, lines, list_transform(lines, lambda x: trim(regexp_replace(x, '^#+\s*', '')) || '|' || trim(regexp_replace(substr(x, 1, 12), '^#+\s*', ''))) AS titles FROM l)
SELECT doc_id, len(lines) AS pages, CAST(2 * len(lines) AS INTEGER) AS n_nodes, md5(array_to_string(titles, '|')) AS titles FROM t""")
def parse_tables_of_contents(spark, d):
    """Answers of a model with each document's lines as chapters: whole, fenced, or broken off at its end; the same tree comes out of each."""
    n = F.col("n_chars")
    chapters = F.transform(F.split("text", "\n"), lambda x: F.struct(F.concat(F.lit("## "), x).alias("title"), F.array(F.struct(F.substring(x, 1, 12).alias("title"))).alias("sections")))
    whole = F.to_json(F.struct(F.size(F.split("text", "\n")).alias("total_pages"), chapters.alias("chapters")))
    text = F.when(n % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```"))).when(n % 3 == 1, whole.substr(F.lit(1), F.length(whole) - n % 6 - 1)).otherwise(whole)
    fixed = jsons.repair(read_table(spark, d, "documents").select("doc_id", text.alias("answer")), "answer", "json")
    tree = fixed.select("doc_id", jsons.toc_of(F.col("json")).alias("t"))
    titles = F.transform("t.children", lambda x: F.concat_ws("|", x["title"], x["children"][0]["title"]))
    return tree.select("doc_id", F.col("t.total_pages").cast("long").alias("pages"), F.aggregate("t.children", F.lit(0), lambda s, x: s + 1 + F.size(x["children"])).alias("n_nodes"), F.md5(F.array_join(titles, "|")).alias("titles"))


# Places on pages


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity / 40, 0), 1), 6) AS y, CASE WHEN l_discount > 0 THEN least(1, l_discount + 0.05) - greatest(0, l_tax - 0.05) > 0 ELSE least(1, 0.05) - greatest(0, l_tax - 0.05) > 0 END AS valid FROM lineitem")
def page_units(spark, d):
    b = F.struct(F.lit(0).alias("page"), F.col("l_tax").alias("left"), F.lit(0.1).alias("top"), F.col("l_discount").alias("right"), F.lit(0.2).alias("bottom"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", positions.unit(F.col("l_quantity"), F.lit(40.0)).alias("y"), positions.widened(b, 0.05).isNotNull().alias("valid"))


_BOXES = """b AS (SELECT l_orderkey AS version_id, l_linenumber AS section_id, CAST(l_suppkey % 4 AS INTEGER) AS page, l_discount AS top, l_discount + 0.1 AS bottom, l_tax AS tax, l_quantity AS q FROM lineitem)"""


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    page = (F.col("l_suppkey") % 4).cast("int")
    box = F.struct(page.alias("page"), F.lit(0.1).alias("left"), F.col("l_discount").alias("top"), F.lit(0.9).alias("right"), (F.col("l_discount") + 0.1).alias("bottom"))
    second = F.struct((page + 1).alias("page"), F.lit(0.1).alias("left"), F.col("l_tax").alias("top"), F.lit(0.9).alias("right"), (F.col("l_tax") + 0.3).alias("bottom"))
    k = F.col("l_linenumber") % 3
    none = F.lit(None).cast(positions.BOX)
    return li.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("section_id"), F.when(k == 0, box.cast(positions.BOX)).otherwise(none).alias("heading_box"), F.when(k == 1, F.array(box.cast(positions.BOX), second.cast(positions.BOX))).alias("boxes"), F.lit(7).alias("page_start"), F.lit(8).alias("page_end"), F.lit(0.25).alias("start_y"), F.lit(0.75).alias("end_y"), F.col("l_quantity").alias("q"))


@query(f"""WITH {_BOXES} SELECT version_id, section_id, CASE WHEN section_id % 3 = 2 THEN 7 ELSE page + 1 END AS page_start, CASE section_id % 3 WHEN 0 THEN page + 1 WHEN 1 THEN page + 2 ELSE 8 END AS page_end, round(CASE WHEN section_id % 3 = 2 THEN 0.25 ELSE top END, 9) AS start_y,
  round(CASE section_id % 3 WHEN 0 THEN bottom WHEN 1 THEN tax + 0.3 ELSE 0.75 END, 9) AS end_y FROM b""")
def viewer_positions(spark, d):
    p = positions.viewer_position(*(F.col(c) for c in ("heading_box", "boxes", "page_start", "page_end", "start_y", "end_y")))
    return _boxed(spark, d).withColumn("p", p).select("version_id", "section_id", "p.page_start", "p.page_end", F.round("p.start_y", 9).alias("start_y"), F.round("p.end_y", 9).alias("end_y"))


@query(f"""WITH {_BOXES} SELECT version_id AS l_orderkey, section_id AS l_linenumber, CASE WHEN q < 20 THEN CAST(q AS INTEGER) WHEN section_id % 3 <> 2 THEN page + 1 END AS page_start, CASE WHEN q >= 40 THEN CAST(q AS INTEGER) WHEN section_id % 3 = 0 THEN page + 1 WHEN section_id % 3 = 1 THEN page + 2 END AS page_end,
  round(CASE WHEN q % 2 = 0 THEN q / 100 WHEN section_id % 3 <> 2 THEN top END, 9) AS start_y, round(CASE WHEN q % 4 = 1 THEN q / 50 WHEN section_id % 3 = 0 THEN bottom WHEN section_id % 3 = 1 THEN tax + 0.3 END, 9) AS end_y FROM b""")
def stored_positions(spark, d):
    """What is told explicitly, by the quantity of a line item, before what the boxes say."""
    q = F.col("q")
    given = F.when(q < 20, q.cast("int")), F.when(q >= 40, q.cast("int")), F.when(q % 2 == 0, q / 100), F.when(q % 4 == 1, q / 50)
    p = _boxed(spark, d).withColumn("p", positions.stored_position(F.col("heading_box"), F.col("boxes"), *given))
    return p.select(F.col("version_id").alias("l_orderkey"), F.col("section_id").alias("l_linenumber"), "p.page_start", "p.page_end", F.round("p.start_y", 9).alias("start_y"), F.round("p.end_y", 9).alias("end_y"))


@query(f"""WITH {_SECTIONS}, s AS (SELECT version_id, pos, pos // 4 AS grp, CAST(length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS DOUBLE) AS w FROM sections),
g AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY version_id, grp) > 0 THEN w ELSE 1 END AS v, count(*) OVER (PARTITION BY version_id, grp) AS n FROM s),
c AS (SELECT *, coalesce(sum(v) OVER (PARTITION BY version_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(v) OVER (PARTITION BY version_id, grp) AS f FROM g)
SELECT version_id, pos, CASE WHEN n > 1 THEN CAST(printf('%.6f', least(CAST(0.7 AS DOUBLE), CAST(0.2 AS DOUBLE) + (CAST(0.7 AS DOUBLE) - CAST(0.2 AS DOUBLE)) * f)) AS DOUBLE) ELSE 0.9 END AS start_y FROM c""")
def shared_heading_boxes(spark, d):
    s = roles.sections(spark, d)
    grp = F.floor(F.col("pos") / 4).cast("int")
    box = F.struct(grp.alias("page"), F.lit(0.0).alias("left"), F.lit(0.2).alias("top"), F.lit(1.0).alias("right"), F.lit(0.7).alias("bottom"))
    at = F.struct((grp + 1).alias("page_start"), (grp + 1).alias("page_end"), F.lit(0.9).alias("start_y"), F.lit(0.95).alias("end_y"))
    s = s.select("version_id", F.col("pos").alias("section_id"), F.col("pos").alias("order"), box.alias("heading_box"), at.alias("position"), F.col("content").alias("text"))
    return positions.apart(s).select("version_id", F.col("section_id").alias("pos"), "position.start_y")


@query(f"""WITH {_SECTIONS}, h AS (SELECT version_id, pos, pos // 10 AS page, (pos % 10) * 0.1 AS y FROM sections)
SELECT p.version_id, p.pos, max(h.pos) AS section_id FROM h p LEFT JOIN h ON h.version_id = p.version_id AND h.pos % 6 = 0 AND (h.page < p.page OR h.page = p.page AND h.y <= p.y + 0.15) WHERE p.pos % 6 <> 0 GROUP BY p.version_id, p.pos""")
def last_headings(spark, d):
    s = roles.sections(spark, d).select("version_id", "pos", F.floor(F.col("pos") / 10).alias("page"), (F.col("pos") % 10 * 0.1).alias("y"))
    h = s.where("pos % 6 = 0").select("version_id", F.col("pos").alias("section_id"), F.lit(1).alias("level"), "page", "y")
    found = positions.last_heading_above(s.where("pos % 6 <> 0"), h, slack=0.15)
    return found.select("version_id", (F.col("page") * 10 + F.round(F.col("y") * 10)).cast("int").alias("pos"), "section_id")


@query(f"""WITH {_SECTIONS}, a AS (SELECT version_id, pos, CASE WHEN pos % 5 = 1 THEN pos * 7 END AS anchor FROM sections)
SELECT a.version_id, a.pos, arg_min(b.anchor, abs(a.pos - b.pos) * 2 + CASE WHEN b.pos > a.pos THEN 1 ELSE 0 END) AS near FROM a LEFT JOIN a b ON b.version_id = a.version_id AND b.anchor IS NOT NULL GROUP BY a.version_id, a.pos""")
def nearest_anchors(spark, d):
    s = roles.sections(spark, d).select("version_id", "pos", F.when(F.col("pos") % 5 == 1, F.col("pos") * 7).alias("anchor"))
    return positions.nearest_anchored(s).select("version_id", "pos", "near")


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS section_id, CAST(l_quantity AS INTEGER) % 10 AS a, CAST(l_quantity AS INTEGER) % 10 + l_linenumber % 3 AS b FROM lineitem)
SELECT section_id, CAST(page AS INTEGER) AS page, CAST(CASE WHEN page = a THEN 0.3 ELSE 0 END AS DOUBLE) AS top, CAST(CASE WHEN page = b THEN 0.6 ELSE 1 END AS DOUBLE) AS bottom FROM (SELECT *, unnest(range(a, b + 1)) AS page FROM s)""")
def highlight_boxes(spark, d):
    q = F.col("l_quantity").cast("int") % 10
    s = read_table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section_id"), q.alias("page_start"), (q + F.col("l_linenumber") % 3).cast("int").alias("page_end"), F.lit(0.3).alias("start_y"), F.lit(0.6).alias("end_y"))
    return positions.highlight_boxes(s).select("section_id", "page", "top", "bottom")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS v, l_linenumber AS id, CAST(l_quantity AS INTEGER) % 10 AS a, CAST(l_quantity AS INTEGER) % 10 + l_linenumber % 3 AS b, l_linenumber % 2 AS level, CASE WHEN l_linenumber % 5 > 0 THEN l_discount END AS y, CASE WHEN l_linenumber % 4 > 0 THEN 0.5 END AS z FROM lineitem),
p AS (SELECT o_orderkey AS v, CAST(o_custkey % 12 AS INTEGER) AS page, 0.05 AS py FROM orders), m AS (SELECT p.*, s.id, s.a, s.b, s.level, coalesce(y, 0) AS lo, coalesce(z, 0) AS hi, y, z FROM p JOIN s ON s.v = p.v),
c AS (SELECT *, CASE WHEN a = b THEN y IS NULL AND z IS NULL OR lo <= py AND py <= hi ELSE NOT (page = a AND y IS NOT NULL AND py < lo) AND NOT (page = b AND z IS NOT NULL AND py > hi) END AND a <= page AND page <= b AS inside, a <= page AND page <= b AS on_page,
  CASE WHEN a < b THEN b - a + 1 WHEN y IS NULL AND z IS NULL THEN 1 ELSE greatest(hi - lo, 0) END AS span FROM m WHERE a <= page),
r AS (SELECT v, page, id, row_number() OVER (PARTITION BY v, page ORDER BY CASE WHEN inside THEN 0 WHEN on_page THEN 1 ELSE 2 END, CASE WHEN on_page THEN b - a END, CASE WHEN inside THEN span END, CASE WHEN on_page THEN -level END, -a, CASE WHEN inside THEN -lo END, -level, id) AS n FROM c)
SELECT p.v AS version_id, p.page, r.id AS section_id FROM p LEFT JOIN r ON r.v = p.v AND r.page = p.page AND n = 1""")
def sections_at(spark, d):
    q = F.col("l_quantity").cast("int") % 10
    s = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("section_id"), (F.col("l_linenumber") % 2).alias("level"), q.alias("page_start"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_discount")).alias("start_y"), (q + F.col("l_linenumber") % 3).cast("int").alias("page_end"), F.when(F.col("l_linenumber") % 4 > 0, 0.5).alias("end_y"))
    p = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_custkey") % 12).cast("int").alias("page"), F.lit(0.05).alias("y"))
    return sections.section_at(p, s.distinct()).select("version_id", "page", "section_id")


# Tables of contents


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Sections as nodes of a tree of three children to a node; every third has a chunk."""
    s = roles.section_paths(spark, d)
    titles = F.transform("path", lambda p: F.concat(F.lit("t"), p.cast("string")))
    chunk = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("c"), F.col("pos").cast("string")))
    return s.select("version_id", F.col("pos").alias("idx"), F.array_join(titles, "/").alias("path"), F.size("path").alias("level"), F.element_at(titles, -1).alias("title"), chunk.alias("chunk_id"))


def _chunk_places(spark: SparkSession, d: str) -> DataFrame:
    return roles.sections(spark, d).where("pos % 3 = 1").select("version_id", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("chunk_id"), (F.col("pos") * 2).alias("position"))


_UP = f"""{_SECTIONS}, up AS (SELECT version_id, pos AS node, pos AS above, 0 AS d FROM sections UNION ALL SELECT version_id, node, CAST((above - 1) // 3 AS INTEGER), d + 1 FROM up WHERE above > 0)"""


@query(f"""WITH RECURSIVE {_UP}, l AS (SELECT version_id, node, max(d) + 1 AS level FROM up GROUP BY ALL),
c AS (SELECT u.version_id, u.node, u.above, u.d FROM up u JOIN l a ON a.version_id = u.version_id AND a.node = u.above JOIN l n ON n.version_id = u.version_id AND n.node = u.node WHERE u.above % 3 = 1 AND (u.d = 0 OR n.level >= 5 AND a.level >= 4))
SELECT s.version_id, s.pos AS idx, 'c' || (SELECT arg_min(above, d) FROM c WHERE c.version_id = s.version_id AND c.node = s.pos) AS chunk_id FROM sections s""")
def inherit_deep(spark, d):
    return toc.inherit_deep(_nodes(spark, d)).select("version_id", "idx", "chunk_id")


@query(f"WITH {_SECTIONS} SELECT version_id, pos AS idx, 'c' || max(CASE WHEN pos % 3 = 1 THEN pos END) OVER (PARTITION BY version_id ORDER BY pos) AS chunk_id FROM sections")
def from_predecessor(spark, d):
    return toc.from_predecessor(_nodes(spark, d)).select("version_id", "idx", "chunk_id")


@query(f"WITH RECURSIVE {_UP} SELECT s.version_id, s.pos AS idx, CASE WHEN s.pos % 3 = 1 THEN 'c' || s.pos ELSE 'c' || (SELECT min(node) FROM up WHERE up.version_id = s.version_id AND up.above = s.pos AND node % 3 = 1) END AS chunk_id FROM sections s")
def from_below(spark, d):
    return toc.from_below(_nodes(spark, d), _chunk_places(spark, d)).select("version_id", "idx", "chunk_id")


@query(f"""WITH {_SECTIONS}, n AS (SELECT version_id, pos, CASE WHEN pos > 0 THEN (pos - 1) // 3 END AS up, CASE WHEN pos % 3 = 1 THEN pos * 2 END AS place FROM sections),
w AS (SELECT *, arg_max(pos, pos) FILTER (place IS NOT NULL) OVER (PARTITION BY version_id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS near FROM n)
SELECT version_id, pos AS idx, CASE WHEN place IS NOT NULL THEN 'c' || pos WHEN up % 3 = 1 AND (near IS NULL OR abs(up * 2 - near * 2) <= 40) THEN 'c' || up END AS chunk_id FROM w""")
def from_parent(spark, d):
    return toc.from_parent(_nodes(spark, d), _chunk_places(spark, d), distance=40).select("version_id", "idx", "chunk_id")


@query()
def settled_contents(spark, d):
    """Nodes matched to chunks in any order: those against the document's order give theirs up, but the second level is sure, and gaps are filled."""
    places = _chunk_places(spark, d).withColumn("position", F.col("position") * 7919 % 1009)
    nodes = _nodes(spark, d)
    return toc.settle(nodes, places, nodes.where("level = 2")).select("version_id", "idx", "chunk_id")


@query()
def fill_gaps(spark, d):
    return toc.fill_gaps(_nodes(spark, d), _chunk_places(spark, d)).select("version_id", "idx", "chunk_id")


@query("""WITH r AS (SELECT o_orderkey % 20 AS version_id, o_orderkey AS first, o_orderkey + 8 AS last FROM orders), m AS (SELECT l_orderkey % 20 AS version_id, l_orderkey AS idx, min(l_partkey) AS position FROM lineitem WHERE l_linenumber = 3 GROUP BY 1, 2), n AS (SELECT version_id, 500 AS n FROM r GROUP BY 1),
w AS (SELECT r.*, n.n, count(m.idx) AS k, coalesce(max(position) FILTER (WHERE idx <= first), 0) AS before, coalesce(min(position) FILTER (WHERE idx >= last), n.n) AS behind, coalesce(max(position) FILTER (WHERE idx < first), 0) AS earlier FROM r JOIN n ON n.version_id = r.version_id LEFT JOIN m ON m.version_id = r.version_id GROUP BY r.version_id, r.first, r.last, n.n),
x AS (SELECT *, greatest(CASE WHEN earlier > 0 THEN (earlier + before) // 2 ELSE 0 END, before - 25) AS low, least(n, behind + 2) AS high FROM w)
SELECT version_id, first, CAST(CASE WHEN k = 0 THEN 0 WHEN low >= high THEN greatest(0, before - 25) ELSE low END AS INTEGER) AS low, CAST(CASE WHEN k = 0 THEN n WHEN low >= high THEN least(n, before + 100) ELSE high END AS INTEGER) AS high FROM x""")
def search_windows(spark, d):
    r = read_table(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("version_id"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + 8).alias("last"))
    m = read_table(spark, d, "lineitem").where("l_linenumber = 3").select((F.col("l_orderkey") % 20).alias("version_id"), F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("position"))
    return toc.windows(r, toc.landmarks(m), r.select("version_id").distinct().withColumn("n", F.lit(500))).select("version_id", "first", "low", "high")


@query("""WITH w AS (SELECT o_custkey AS version_id, o_orderkey AS first, o_custkey % 700 AS low, least(900, o_custkey % 700 + 10 + o_orderkey % 400) AS high FROM orders), h AS (SELECT o_orderkey AS first, o_custkey % 700 + l_partkey % (10 + o_orderkey % 200) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT first, min(p) AS least, max(p) AS largest FROM h GROUP BY 1), x AS (SELECT w.*, least, largest, high - low AS size, greatest(5, CAST(floor((high - low) * CAST(0.15 AS DOUBLE)) AS BIGINT)) AS edge FROM w JOIN e ON e.first = w.first),
y AS (SELECT *, CASE WHEN least < low + edge THEN greatest(0, low - size) ELSE low END AS a, CASE WHEN largest > high - 1 - edge THEN least(900, high + size) ELSE high END AS b, greatest(0, (least + largest) // 2 - 300) AS m FROM x)
SELECT version_id, first, CAST(CASE WHEN b - a > 600 THEN greatest(0, least(900, m + 600) - 600) ELSE a END AS INTEGER) AS low, CAST(CASE WHEN b - a > 600 THEN least(900, m + 600) ELSE b END AS INTEGER) AS high FROM y WHERE a <> low OR b <> high""")
def windows_at_edges(spark, d):
    o, item = read_table(spark, d, "orders"), read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    low = F.col("o_custkey") % 700
    w = o.select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("first"), low.alias("low"), F.least(F.lit(900), low + 10 + F.col("o_orderkey") % 400).alias("high"))
    hits = o.join(item, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").alias("first"), (low + F.col("l_partkey") % (F.col("o_orderkey") % 200 + 10)).alias("position"))
    return toc.expand_at_edges(w, hits, w.select("version_id").distinct().withColumn("n", F.lit(900))).select("version_id", "first", "low", "high")


@query("""WITH p AS (SELECT user_id AS version_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS page, event_type FROM events), f AS (SELECT version_id, min(page) AS first FROM p WHERE event_type = 'click' AND page < 20 GROUP BY 1)
SELECT f.version_id, f.first, coalesce((SELECT min(page) FROM p WHERE p.version_id = f.version_id AND page > first AND page <= first + 14 AND event_type = 'error') - 1, (SELECT max(page) FROM p WHERE p.version_id = f.version_id AND page > first AND page <= first + 14), f.first) AS last FROM f""")
def contiguous_contents(spark, d):
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    p = read_table(spark, d, "events").select(F.col("user_id").alias("version_id"), page.alias("page"), "event_type")
    return toc.contiguous_toc(p, F.col("event_type") == "click", F.col("event_type") != "error").select("version_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("SELECT l_orderkey AS version_id, count(*) AS entries, count(*) FILTER (WHERE l_suppkey % 3 > 0) AS actionable, max(l_linenumber) AS depth FROM lineitem GROUP BY 1")
def outline_summary(spark, d):
    e = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("level"), F.when(F.col("l_suppkey") % 3 != 2, F.col("l_suppkey") % 3).otherwise(2).alias("page"))
    return toc.outline_summary(e)


@query(r"""WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), b AS (SELECT doc_id, i, line, unnest(string_split(line, '. ')) AS part, unnest(range(len(string_split(line, '. ')))) AS j FROM a),
n AS (SELECT doc_id, i, -1 AS j, -1 AS k, line AS path, 1 AS level FROM a UNION ALL SELECT doc_id, i, j, -1, line || '/' || part, 2 FROM b UNION ALL SELECT doc_id, i, j, 0, line || '/' || part || '/' || string_split(part, ' ')[1], 3 FROM b)
SELECT doc_id AS version_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS INTEGER) AS idx, md5(path) AS path, level FROM n""")
def flatten_contents(spark, d):
    """Every document as a tree: its lines, their sentences, and the first word of each."""
    node = lambda t, *below: F.struct(t.alias("title"), F.lit(None).cast("string").alias("chunk_id"), *below)
    word = lambda s: F.array(node(F.substring_index(s, " ", 1))).alias("children")
    sentences = lambda line: F.transform(F.split(line, r"\. "), lambda s: node(s, word(s))).alias("children")
    tree = F.transform(F.split("text", "\n"), lambda line: node(line, sentences(line)))
    return toc.flatten(read_table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), tree.alias("children")), 3).select("version_id", "idx", F.md5("path").alias("path"), "level")


# Chunks in texts

_MARKED = f"""{_SECTIONS}, m AS (SELECT version_id, string_agg('<a id=''k' || pos || '''></a>' || content, chr(10) ORDER BY pos) AS text FROM sections GROUP BY version_id)"""


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with an anchor before each line, and the lines as chunks; some chunks have no anchor."""
    s = roles.sections(spark, d).select("version_id", "pos", F.concat(F.lit("k"), F.col("pos").cast("string")).alias("id"), "content")
    line = F.concat(F.lit("<a id='"), "id", F.lit("'></a>"), "content")
    texts = s.groupBy("version_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    kind = F.when(F.col("pos") % 5 == 1, "logo").when(F.col("pos") % 5 == 2, "figure").when(F.col("pos") % 5 == 3, "table").otherwise("text")
    boxes = F.array(F.struct(F.lit(0).alias("page"), F.lit(0.1).alias("left"), F.lit(0.5).alias("top"), F.lit(0.9).alias("right"), F.lit(0.6).alias("bottom")))
    body = F.concat(F.lit("<a id='"), "id", F.lit("'></a>"), "content")
    chunks_ = s.select("version_id", "pos", F.when(F.col("pos") % 11 == 10, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), kind.alias("type"), body.alias("text"), boxes.alias("boxes"))
    return texts, chunks_


@query(f"""WITH {_MARKED}, c AS (SELECT s.version_id, pos, CASE WHEN pos % 11 = 10 THEN -1 ELSE instr(m.text, '<a id=''k' || pos || '''></a>') - 1 END AS start, length(m.text) AS size FROM sections s JOIN m ON m.version_id = s.version_id)
SELECT version_id, pos, CAST(start AS INTEGER) AS start, CAST(coalesce(min(CASE WHEN start >= 0 THEN start END) OVER (PARTITION BY version_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size) AS INTEGER) AS "end" FROM c""")
def chunk_offsets(spark, d):
    texts, c = _marked(spark, d)
    return chunks.chunk_offsets(c.drop("text"), texts).select("version_id", "pos", "start", "end")


_PLACED = f"""{_MARKED}, o AS (SELECT s.version_id, pos, content, CASE WHEN pos % 11 = 10 THEN -1 ELSE instr(m.text, '<a id=''k' || pos || '''></a>') - 1 END AS start, length(m.text) AS size FROM sections s JOIN m ON m.version_id = s.version_id),
placed AS (SELECT *, coalesce(min(CASE WHEN start >= 0 THEN start END) OVER (PARTITION BY version_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size) AS stop FROM o),
noise AS (SELECT version_id, pos, start, stop, CASE pos % 5 WHEN 1 THEN '' WHEN 2 THEN '[figure:k' || pos || ']' ELSE '[table:k' || pos || ']' END AS mark FROM placed WHERE start >= 0 AND stop > start AND pos % 5 IN (1, 2, 3))"""


@query(f"""WITH {_PLACED} SELECT version_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", mark FROM noise""")
def noise_intervals(spark, d):
    texts, c = _marked(spark, d)
    return chunks.noise_intervals(chunks.chunk_offsets(chunks.measured(c), texts)).select("version_id", "start", "end", "mark")


@query(f"""WITH {_PLACED}, p AS (SELECT version_id, pos, start, stop, CASE WHEN pos % 5 = 1 THEN '' WHEN pos % 5 IN (2, 3) THEN '[' || CASE pos % 5 WHEN 2 THEN 'figure' ELSE 'table' END || ':k' || pos || ']' END AS mark FROM placed WHERE start >= 0),
x AS (SELECT p.version_id, p.pos, coalesce(p.mark, substr(m.text, CAST(start AS INTEGER) + 1, CAST(stop - start AS INTEGER))) AS part FROM p JOIN m ON m.version_id = p.version_id)
SELECT version_id, md5(string_agg(part, '' ORDER BY pos)) AS spliced_md5 FROM x GROUP BY version_id""")
def spliced_texts(spark, d):
    texts, c = _marked(spark, d)
    noise = chunks.noise_intervals(chunks.chunk_offsets(chunks.measured(c), texts)).groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("noise"))
    t = texts.join(noise, "version_id", "left")
    return t.select("version_id", F.md5(chunks.spliced(F.col("text"), F.lit(0), F.length("text"), F.col("noise")).cast("binary")).alias("spliced_md5"))


@query(f"""WITH {_PLACED}, t AS (SELECT version_id, pos, start, stop FROM placed WHERE pos % 2 = 0 AND start >= 0)
SELECT t.version_id, t.pos AS idx, CAST(start AS INTEGER) AS start, CAST(coalesce((SELECT min(u.start) FROM t u WHERE u.version_id = t.version_id AND u.start > t.start AND u.pos % 4 <= t.pos % 4), size) AS INTEGER) AS "end" FROM t JOIN (SELECT version_id, length(text) AS size FROM m) z ON z.version_id = t.version_id""")
def section_spans(spark, d):
    texts, c = _marked(spark, d)
    placed = chunks.chunk_offsets(c.drop("text"), texts)
    nodes = placed.where("pos % 2 = 0").select("version_id", F.col("pos").alias("idx"), (F.col("pos") % 4 + 1).alias("level"), F.col("id").alias("title"), F.col("id").alias("chunk_id"))
    return chunks.section_spans(nodes, placed, texts).select("version_id", "idx", "start", "end")


def _outline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, placed chunks and texts of documents whose lines are chunks: every other line is the title of a section, by turns a chapter and what is below it, and every fourth stands in the chunk before."""
    texts, c = _marked(spark, d)
    placed = chunks.chunk_offsets(chunks.measured(c), texts)
    title = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 60)
    before, upto = Window.partitionBy("version_id").orderBy("pos"), Window.partitionBy("version_id").orderBy("idx")
    n = c.select("version_id", "pos", "id", F.when(F.col("pos") % 2 == 0, title).alias("line")).withColumn("before", F.lag("id").over(before)).where("pos % 2 = 0")
    n = n.select("version_id", F.col("pos").alias("idx"), F.when(F.col("pos") % 6 == 0, 1).otherwise(2).alias("level"), F.concat(F.col("pos").cast("string"), F.lit(" "), "line").alias("title"), F.when(F.col("pos") % 8 == 4, F.col("before")).otherwise(F.col("id")).alias("chunk_id"))
    chapter = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(upto)
    n = n.withColumn("path", F.when(F.col("level") == 1, F.col("title")).otherwise(F.concat_ws("/", chapter, "title")))
    return n.select("version_id", "idx", "path", "level", "title", "chunk_id"), placed, texts


@query()
def section_boundaries(spark, d):
    return boundaries.section_bounds(*_outline(spark, d)).select("version_id", "idx", "first", "until", "start", "end", "own_end", "score")


@query()
def section_nodes(spark, d):
    found = chunks.section_nodes(*_outline(spark, d))
    return found.select("version_id", "idx", "node_id", "start", "end", F.md5(F.col("content").cast("binary")).alias("content_md5"), "page_start", "page_end", "score", F.size("boxes").alias("n_boxes"), F.size("landing_chunks").alias("n_landing"))


@query()
def section_contents(spark, d):
    nodes, placed, texts = _outline(spark, d)
    found = chunks.section_contents(boundaries.section_bounds(nodes, placed, texts), texts, chunks.noise_intervals(placed))
    return found.select("version_id", "idx", F.md5(F.col("content").cast("binary")).alias("content_md5"), "page_start", "page_end")


@query()
def find_numbered_headings(spark, d):
    """Titles with numbers, in lines, behind other cells of a line, and with more behind them."""
    s = roles.sections(spark, d)
    number = lambda k: F.concat(F.floor(k / 7 + 1).cast("string"), F.lit("."), (k % 7 + 1).cast("string"))
    titled = F.concat(number(F.col("pos")), F.lit(" "), "content")
    line = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("| cell | "), titled, F.lit(" | more of it"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("## "), titled)).otherwise(titled)
    texts = s.groupBy("version_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    titles = s.select("version_id", F.col("pos").alias("section_id"), titled.alias("title"), F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))
    return boundaries.find_headings(titles, texts).select("version_id", "section_id", "offset", F.round("score", 9).alias("score"))


@query(rf"""WITH {_SECTIONS}, o AS (SELECT version_id, pos, content, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY version_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM sections),
w AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '^#{{1,6}}\s*', '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS b FROM o),
t AS (SELECT version_id, pos, list_distinct(list_filter(string_split(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS a FROM sections WHERE pos % 5 = 0 AND NOT regexp_matches(trim(content), '^\d')),
s AS (SELECT t.version_id, t.pos AS section_id, w.start, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 9) AS score FROM t JOIN w ON w.version_id = t.version_id AND len(a) > 0 AND len(b) > 0 AND w.start < 60000)
SELECT version_id, section_id, arg_max(start, (score, -start)) AS "offset", max(score) AS score FROM s WHERE score >= 0.55 GROUP BY ALL""")
def find_headings(spark, d):
    s = roles.sections(spark, d)
    titles = s.where(r"pos % 5 = 0 and not trim(content) rlike '^\\d'").select("version_id", F.col("pos").alias("section_id"), F.col("content").alias("title"), F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))
    texts = read_table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), "text")
    return boundaries.find_headings(titles, texts).select("version_id", "section_id", "offset", F.round("score", 9).alias("score"))


@query(r"""WITH t AS (SELECT page_id, '<table><tr><td>a</td></tr></table>' || url || ' [figure:' || page_id || '] <:: flow : x -> y ::> <:: ::>' || '<table>' || page_id || '</table>' AS t FROM pages)
SELECT page_id, CAST(k AS INTEGER) AS number, CASE k WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'asset' WHEN 3 THEN 'flowchart' ELSE 'text' END AS type FROM pages, (SELECT unnest(range(0, 5)) AS k)""")
def content_blocks(spark, d):
    k = F.col("page_id").cast("string")
    rich = F.concat(F.lit("<table><tr><td>a</td></tr></table>"), "url", F.lit(" [figure:"), k, F.lit("] <:: flow : x -> y ::> <:: ::>"), F.lit("<table>"), k, F.lit("</table>"))
    return markup.content_blocks(read_table(spark, d, "pages").select("page_id", rich.alias("rich")), "page_id", "rich").select("page_id", "number", "type")


@query(f"WITH RECURSIVE {_UP}, a AS (SELECT version_id, pos, pos % 4 AS asset FROM sections) SELECT a.version_id, a.pos, a.asset FROM a WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.version_id = a.version_id AND up.above = a.pos AND up.d > 0 AND up.node % 4 = a.asset)")
def own_assets(spark, d):
    s = roles.section_paths(spark, d).select("version_id", "path", (F.col("pos") % 4).alias("asset_id"))
    return markup.own_assets(s, s).select("version_id", F.element_at("path", -1).alias("pos"), F.col("asset_id").alias("asset"))


@query("SELECT o_orderkey AS section_id, CASE WHEN o_orderkey % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'f' ELSE 'z' END || o_custkey AS image_url FROM orders")
def resolve_placeholders(spark, d):
    o = read_table(spark, d, "orders")
    c = F.col("o_custkey").cast("string")
    asset = lambda kind, mark: o.select(F.col("o_orderkey").alias("section_id"), F.lit(kind).alias("type"), c.alias("id"), F.concat(F.lit(mark), c).alias("image_url"))
    holes = o.select(F.col("o_orderkey").alias("section_id"), F.when(F.col("o_orderkey") % 2 == 0, "figure").otherwise("table").alias("kind"), c.alias("id"))
    return markup.resolved(holes, asset("figure", "f").union(asset("photo", "z"))).select("section_id", "kind", "image_url")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM events")
def asset_lists(spark, d):
    k = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"id": "'), k, F.lit('", "image_url": "u"}, {"id": "", "image_url": "u"}, {"id": "x"}]'))).when(F.col("event_id") % 3 == 1, "nothing")
    return read_table(spark, d, "events").select("event_id", F.size(markup.assets(raw)).alias("n"))


# Workspace


@query(f"""WITH {_SECTIONS}, s AS (SELECT version_id, pos, content, CASE WHEN pos % 3 <> 0 THEN (pos % 10) / 10.0 END AS score, pos % 6 = 0 AS flag FROM sections), o AS (SELECT o_orderkey AS version_id, o_custkey AS guideline_id FROM orders),
c AS (SELECT version_id, count(*) AS n_sections, count(*) FILTER (WHERE CASE WHEN score IS NULL THEN flag ELSE score < 0.65 END) AS n_suspect, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY pos % 7 = 0, pos) FILTER (WHERE regexp_matches(content, '\\S')), '') AS t FROM s GROUP BY 1),
f AS (SELECT l_orderkey AS version_id, count(DISTINCT l_linenumber) AS n_documents, CASE WHEN min(l_linenumber) FILTER (WHERE l_linenumber % 2 = 0) IS NOT NULL THEN 'spatial_pdf' END AS mode FROM lineitem GROUP BY 1)
SELECT o.version_id, c_name AS title, coalesce(n_documents, 0) AS n_documents, mode, CASE WHEN mode IS NULL THEN 'page_range' ELSE 'spatial_heading_anchor' END AS positioning, coalesce(n_sections, 0) AS n_sections, coalesce(n_suspect, 0) AS n_suspect, md5(t) AS text_md5
FROM o JOIN customer ON c_custkey = guideline_id LEFT JOIN c ON c.version_id = o.version_id LEFT JOIN f ON f.version_id = o.version_id""")
def workspaces(spark, d):
    s = roles.sections(spark, d)
    own = s.select("version_id", F.col("pos").alias("section_id"), F.when(F.col("pos") % 7 != 0, F.col("pos")).alias("order_index"), F.when(F.col("pos") % 3 != 0, F.col("pos") % 10 / 10.0).alias("score"), (F.col("pos") % 6 == 0).alias("is_suspect"), "content")
    docs = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("document_id"), F.when(F.col("l_linenumber") % 2 == 0, " Spatial_PDF").otherwise(" ").alias("mode")).distinct()
    w = workspace.workspace(roles.versions(spark, d).select("version_id", "guideline_id"), roles.guidelines(spark, d).select("guideline_id", "title"), docs, own)
    return w.select("version_id", "title", F.coalesce(F.size("documents"), F.lit(0)).cast("long").alias("n_documents"), "mode", "positioning", "n_sections", "n_suspect", F.md5(F.col("full_text").cast("binary")).alias("text_md5"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'ocr_llm' WHEN 2 THEN 'spatial_pdf' WHEN 3 THEN 'spatial_pdf' ELSE 'other' END AS mode FROM part")
def pipeline_modes(spark, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 1, "OCR").when(k == 2, "PyMuPDF ").when(k == 3, "native_pdf").when(k == 4, "other")
    return read_table(spark, d, "part").select("p_partkey", workspace.pipeline_mode(raw).alias("mode"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(html, '<li>', '<td>'), '(?i)</?(?:tbody|thead|tfoot|tr|td|th)\b[^>]*>', ' ', 'g'), '(?m)^[ \t]*\d+[ \t]*$', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS shown_md5 FROM pages""")
def viewer_texts(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.md5(outline.viewer_text(F.replace("html", F.lit("<li>"), F.lit("<td>"))).cast("binary")).alias("shown_md5"))


@query(r"SELECT doc_id, n_chars > 0 AND regexp_matches(text, '^\S') AS starts FROM documents")
def first_pages(spark, d):
    t = F.regexp_replace("text", "\n", T.PAGE_BREAK)
    return read_table(spark, d, "documents").select("doc_id", (outline.first_pages(t, 1) == F.split("text", "\n")[0]).alias("same"), F.col("text").rlike(r"^\S").alias("starts"), (F.col("n_chars") > 0).alias("some")).select("doc_id", (F.col("starts") & F.col("some") & F.col("same")).alias("starts"))


@query(rf"""WITH {_SECTIONS}, m AS (SELECT version_id, pos, CASE WHEN length(content) < 60 THEN '## ' || content WHEN length(content) < 110 THEN upper(replace(content, 'ß', 'ss')) ELSE content END AS line FROM sections),
c AS (SELECT version_id, pos // 2 AS chunk, '<a id=''' || (pos // 2) || '''></a>' || string_agg(line, chr(10) || chr(10) ORDER BY pos) AS text FROM m GROUP BY 1, 2), b AS (SELECT version_id, chunk, regexp_replace(regexp_replace(text, '<a\s+id=''[^'']*''>.*?</a>', '', 'gs'), '^\s+|\s+$', '', 'g') AS body FROM c)
SELECT version_id, chunk, length(body) BETWEEN 1 AND 500 AND len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '')) > 0 AND len(list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '' AND NOT (regexp_matches(trim(x), '^#{{1,6}}') OR (length(body) <= 100 AND trim(x) = upper(trim(x)))))) = 0 AS heading_only FROM b""")
def heading_only_chunks(spark, d):
    """Chunks of two lines: short lines as marked headings, middling ones in capitals."""
    n, c = F.length("content"), F.col("content")
    line = F.when(n < 60, F.concat(F.lit("## "), c)).when(n < 110, F.upper(F.replace(c, F.lit("ß"), F.lit("ss")))).otherwise(c)
    s = roles.sections(spark, d).select("version_id", F.floor(F.col("pos") / 2).cast("int").alias("chunk"), "pos", line.alias("line"))
    texts = s.groupBy("version_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    text = F.concat(F.lit("<a id='"), F.col("chunk").cast("string"), F.lit("'></a>"), F.array_join("rows.line", "\n\n"))
    return texts.select("version_id", "chunk", outline.heading_only(text).alias("heading_only"))


@query("""WITH c AS (SELECT l_orderkey AS version_id, l_linenumber * 10 AS position, l_linenumber AS page FROM lineitem WHERE l_linenumber % 2 = 1), g AS (SELECT DISTINCT l_orderkey AS version_id, l_linenumber AS page FROM lineitem WHERE l_quantity > 10),
v AS (SELECT o_orderkey AS version_id, o_custkey % 60 AS cutoff FROM orders), l AS (SELECT v.version_id, max(page) AS last FROM v LEFT JOIN c ON c.version_id = v.version_id AND position < cutoff GROUP BY 1),
r AS (SELECT l.version_id, last, (SELECT min(p) FROM (SELECT unnest(range(CAST(last AS INTEGER) + 1, 20)) AS p) WHERE p NOT IN (SELECT page FROM g WHERE g.version_id = l.version_id)) AS stop FROM l)
SELECT version_id, CAST(coalesce(stop - 1, last, 99) AS INTEGER) AS page FROM r""")
def last_contents_page(spark, d):
    li = read_table(spark, d, "lineitem")
    c = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("version_id"), (F.col("l_linenumber") * 10).alias("position"), F.col("l_linenumber").alias("page"))
    cut = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), (F.col("o_custkey") % 60).alias("cutoff"), F.lit(99).alias("fallback"))
    more = li.where("l_quantity > 10").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("page"))
    return toc.last_toc_page(c, cut, more).select("version_id", F.col("page").cast("int").alias("page"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_suppkey % 5 = 4 THEN 9999 ELSE l_suppkey % 5 END, CASE WHEN l_suppkey % 5 = 4 THEN 0 ELSE l_discount END, CASE WHEN l_suppkey % 5 = 4 THEN 0 ELSE l_tax END, l_linenumber * 1000000 + l_partkey) AS place FROM lineitem""")
def reading_order(spark, d):
    from pyspark.sql import Window

    page = F.col("l_suppkey") % 5
    box = F.when(page != 4, F.struct(page.alias("page"), F.col("l_discount").alias("top"), F.col("l_tax").alias("left")))
    c = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*positions.reading_order(c)))
    return c.select("l_orderkey", "l_linenumber", place.cast("long").alias("place"))
