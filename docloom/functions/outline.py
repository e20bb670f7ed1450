"""Headings, tables of contents and metadata in texts, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import PAGE_BREAK, accent_table, strip_text

_SPACES = r"(?U)\s+"

# The words that open a heading, a table of contents and a numbered part.
PART_WORDS = ("chương", "phần", "bước", "mục", "điều", "phụ lục", "phụlục", "chuyên đề", "chuyênđề", "phan", "chuong", "buoc", "muc", "dieu")
TOC_MARK = r"(?iu)MUC\s*LUC|MỤC\s*LỤC|TABLE\s+OF\s+CONTENTS"
TOC_TITLES = ("mục lục", "muc luc", "table of contents", "contents")
NUMBERED_WORDS = ("tài\\s*liệu", "chương", "phần", "mục", "bài")
STOP_WORDS = ("và", "của", "những", "như", "được", "các", "trong", "cho", "với")
VIETNAMESE = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹíìỉĩịóòỏõọúùủũụýỳỷỹỵ"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")


def collapsed(text: Column) -> Column:
    """White space collapsed, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def title_key(title: Column) -> Column:
    """A title without heading marks before it and white space around it."""
    return strip_text(F.regexp_replace(title, r"^#+\s*", ""))


def structural_key(title: Column) -> Column:
    """Keyword and number of a numbered part (chapter 3) as an array of two, null if it is none."""
    pattern = rf"(?iu)^({'|'.join(NUMBERED_WORDS)})\s+([0-9]+|[IVX]+)"
    bare = title_key(title)
    found = F.array(F.regexp_replace(F.lower(F.regexp_extract(bare, pattern, 1)), r"\s+", ""), F.upper(F.regexp_extract(bare, pattern, 2)))
    return F.when(bare.rlike(pattern), found)


def outline_key(title: Column) -> Column:
    """A title in lower case, white space collapsed: what composite keys compare."""
    return F.lower(collapsed(F.coalesce(title, F.lit(""))))


def first_pages(text: Column, n: int, mark: str = PAGE_BREAK) -> Column:
    """The first ``n`` pages of a text; all of it if ``n`` is not positive."""
    if n <= 0:
        return text
    return F.array_join(F.slice(F.split(text, F.lit("\\Q" + mark + "\\E"), -1), 1, n), mark)


def has_toc(text: Column, n: int) -> Column:
    """Whether the first pages hold the title of a table of contents."""
    return first_pages(text, n).rlike(TOC_MARK)


def toc_goes_on(page: Column) -> Column:
    """Whether a page looks like more of a table of contents: a table at its top, three entries, or a numbered part and one entry."""
    body = F.regexp_replace(F.regexp_replace(page, r"^\s+", ""), r"(?i)^(\s*<a\s+[^>]+>\s*</a>\s*)+", "")
    body = F.regexp_replace(body, r"^\s+", "")
    n = lambda pattern: F.size(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    entries, dotted = n(r"(?m)^\s*\d+[. )]\s+\S.{3,}\s+\d{1,4}\s*$"), n(r"(?m)^\s*\S.{3,}[.…]{3,}\s*\d{1,4}\s*$")
    parts = n(r"(?imu)^\s*(?:\*{1,2})?(?:PHẦN|CHƯƠNG|PHỤ LỤC)\s+\d+.{0,80}\d{1,4}\s*(?:\*{1,2})?\s*$")
    return F.coalesce(body.startswith("<table") | (entries >= 3) | (dotted >= 3) | ((parts > 0) & ((entries > 0) | (dotted > 0))), F.lit(False))


def without_tables(text: Column) -> Column:
    """A text as plain lines: anchors and attributes off, cells parted by bars, page numbers and runs of empty lines off."""
    out = F.regexp_replace(text, r"(?i)<a\s+id=['\"][^'\"]*['\"]>\s*</a>", "")
    out = F.regexp_replace(out, r"(?s)<::.*?::>", "")
    out = F.regexp_replace(out, r"(?i)</?(?:table|thead|tbody|tfoot|tr)(?:\s[^>]*)?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(?:td|th)(?:\s[^>]*)?>", ""), r"(?i)</(?:td|th)>", "  |  ")
    kept = F.filter(lines(out), lambda x: ~x.rlike(r"^\s*\d{1,4}\s*$"))
    return strip_text(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def heading_of(line: Column) -> Column:
    """A line as a heading of the outline, null if it is none: marked ones, named or Roman parts, decimal numbers, capitals."""
    s = strip_text(line)
    plain = _plain(s)
    return _heading(s, plain, _unmarked(plain))


def _plain(s: Column) -> Column:
    return strip_text(F.regexp_replace(strip_text(F.regexp_replace(s, r"<[^>]+>", "")), r"<::.*?::>", ""))


def _unmarked(plain: Column) -> Column:
    return strip_text(F.regexp_replace(plain, r"\*{1,3}|_{1,3}", ""))


def _heading(s: Column, plain: Column, clean: Column) -> Column:
    """A heading by its stripped line, that without tags, and that without marks of type."""
    number_only = s.rlike(r"^\s*[\d\s,.\-/]+\s*$")
    low = F.lower(clean)
    marks, marked = F.regexp_extract(s, r"^(#{1,6})\s+(.+)", 1), strip_text(F.regexp_replace(F.regexp_extract(s, r"^(#{1,6})\s+(.+)", 2), r"\*{1,3}|_{1,3}", ""))
    words = "|".join(PART_WORDS)
    named, roman = low.rlike(rf"(?u)^({words})\s+\S"), clean.rlike(r"(?i)^(XIV|XIII|XII|XI|IX|VIII|VII|VI|IV|III|II|XV|I|X|V)\.\s+\S")
    numbered = clean.rlike(r"^\d+(?:\.\d+)*\s*[.)]\s*.+")
    number, rest = F.regexp_extract(clean, r"^(\d+(?:\.\d+)*)\s*[.)]\s*(.+)", 1), strip_text(F.regexp_extract(clean, r"^(\d+(?:\.\d+)*)\s*[.)]\s*(.+)", 2))
    listed = ~number.contains(".") & ~F.lower(rest).rlike(rf"(?u)^({words})\s+")
    capitals = (F.length(clean) > 4) & (clean == F.upper(clean)) & ~clean.rlike(r"^[\-=*_\s|/\\.]+$") & ~clean.rlike(r"^\s*[\d\s,.\-/]+\s*$") & ((F.length(clean) >= 10) | clean.contains(" "))
    return (
        F.when((s == "") | (s == PAGE_BREAK) | number_only | (plain == "") | (clean == ""), None)
        .when(marks != "", F.when(marked != "", F.concat_ws(" ", marks, marked)))
        .when(named | roman, clean)
        .when(numbered, F.when(~listed, clean))
        .when(capitals, clean)
    )


def heading_outline(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, heading) of the headings of each text in order; of equal ones that follow each other the first. Only headings move."""
    # an array of one element, exploded, is computed once; as a plain column it would be put into each of its uses
    once = lambda x, name: F.explode(F.array(x)).alias(name)
    found = texts.select(key, F.posexplode(lines(F.col(text))).alias("number", "line")).select(key, "number", once(strip_text(F.col("line")), "s")).where("s <> ''")
    found = found.select(key, "number", "s", once(_plain(F.col("s")), "plain")).where("plain <> ''")
    found = found.select(key, "number", "s", "plain", once(_unmarked(F.col("plain")), "clean")).where("clean <> ''")
    found = found.select(key, "number", once(_heading(F.col("s"), F.col("plain"), F.col("clean")), "heading")).where("heading is not null")
    before = F.lag("heading").over(Window.partitionBy(key).orderBy("number"))
    return found.withColumn("before", before).where("before is null or before <> heading").drop("before")


def heading_only(text: Column) -> Column:
    """Whether a text of 500 characters at most is nothing but headings: marked ones, or capitals in a text of 100 at most."""
    body = strip_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<a\s+id='[^']*'>.*?</a>", ""))
    rows = F.filter(F.transform(lines(body), strip_text), lambda x: x != "")
    good = F.forall(rows, lambda x: x.rlike(r"^#{1,6}\s*") | ((F.length(body) <= 100) & (x == F.upper(x))))
    return (F.length(body) > 0) & (F.length(body) <= 500) & (F.size(rows) > 0) & good


def number_level(title: Column) -> Column:
    """The level that a title's number tells (1.2 is 2); chapters and parts by name are 1; null without either."""
    first = F.regexp_replace(F.regexp_extract(title, r"(?U)^\S*", 0), r"\.+$", "")
    dots = F.length(first) - F.length(F.replace(first, F.lit("."), F.lit("")))
    return F.when(title.rlike(r"(?iu)^(CHƯƠNG|PHẦN)\s+[IVX\d]+") | title.rlike(r"^\d+(\.\d+)*[\s.)]"), dots + 1)


def corrected_level(title: Column, level: Column) -> Column:
    """A bookmark's level by its number; annexes are 1, others keep theirs."""
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)[.\s\u00a0]", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(number != "", dots + 1).when(title.rlike(r"(?i)^Annex\s+\d+"), 1).otherwise(level)


def preview(text: Column, kind: Column) -> Column:
    """The start of a chunk's text without anchors and tags: 1500 characters, 1100 of figures and tables."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<a[^>]+>.*?</a>", ""), r"<[^>]+>", " ")
    return F.substring(collapsed(body), 1, F.when(kind.isin("figure", "table"), 1100).otherwise(1500))


def previews(chunks: DataFrame, toc_end: int | None = None) -> DataFrame:
    """Chunks (version_id, id, type, text, page or null) with ``preview``, without noise and the pages of contents."""
    kept = chunks.where(~F.coalesce("type", F.lit("")).isin("marginalia", "logo", "scan_code", "attestation"))
    if toc_end is not None:
        kept = kept.where(F.col("page").isNull() | (F.col("page") > toc_end))
    return kept.withColumn("preview", preview(F.col("text"), F.col("type")))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def metadata(text: Column, subject: Column | None = None, created: Column | None = None) -> Column:
    """What the first pages tell: ISBN of the electronic and of the printed issue, ISSN, decision, year, publisher, specialty.

    An ISBN that is not told apart counts for the printed issue, a second one for the electronic. ``created`` is a PDF date (D:YYYYMMDD).
    """
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_extract_all(t, F.lit(r"ISBN[:\s]+([\d\-X]{10,17})"), F.lit(1))
    electronic = _first(t, r"(?i)ISBN\s*[(（]?(?:electronic|online|e-?book|epub)[)）]?\s*[:\-]?\s*([\d\-X]{10,17})")
    printed = _first(t, r"(?i)ISBN\s*[(（]?(?:print|hardcover|softcover|pbk)?[)）]?\s*[:\-]?\s*([\d\-X]{10,17})")
    decision = _first(t, r"(?iu)(?:WHO/[\w/\-.]+|No\.?\s*[\w/\-.]+(?:/\d{4})|(?:Thông tư|Nghị định|Quyết định)\s+[\d/\-]+(?:/\w+)*)", 0)
    who = t.rlike(r"(?i)World Health Organization|WHO\b")
    named = _first(t, r"(?i)((?:Published by|©\s*\d{4}\s+)[^\n]{0,80})")
    pdf_date = None if created is None else F.when(created.rlike(r"D:\d{8}"), F.concat_ws("-", *(F.regexp_extract(created, r"D:(\d{4})(\d{2})(\d{2})", k) for k in (1, 2, 3))))
    year = _first(t, r"\b(?:19|20)\d{2}\b", 0)
    topic = _first(t, r"(?iu)(?:sexually transmitted|STI|HIV|antibiotic|dược lâm sàng|oncology)", 0)
    return F.struct(
        F.coalesce(electronic, F.try_element_at(bare, F.lit(2))).alias("isbn_electronic"), F.coalesce(printed, F.try_element_at(bare, F.lit(1))).alias("isbn_print"),
        _first(t, r"(?i)ISSN[:\s]+(\d{4}-\d{3}[\dX])").alias("issn"), F.trim(decision).alias("decision"),
        (year if pdf_date is None else F.coalesce(pdf_date, year)).alias("date"), F.when(who, F.lit("World Health Organization")).otherwise(F.trim(F.substring(named, 1, 80))).alias("publisher"),
        (topic if subject is None else F.coalesce(F.nullif(subject, F.lit("")), topic)).alias("specialty"),
    )


def toc_metrics(pages: DataFrame, first: int = 8) -> DataFrame:
    """Of the first pages (version_id, page from 0, text) of each version: pages with the title of contents, entries, and whether both say that contents are seen."""
    seen = pages.where(F.col("page") < first).select("version_id", F.filter(F.transform(lines(F.col("text")), collapsed), lambda x: x != "").alias("rows"))
    entry = lambda x: (F.length(x) >= 8) & ((x.contains("...") & x.rlike(r"\d$")) | x.rlike(r"^(?:\d+(?:\.\d+)*|[A-Z]\.?)\s+.+\s+\d{1,4}$"))
    hits = F.sum(F.exists("rows", lambda x: F.lower(x).isin(*TOC_TITLES)).cast("int"))
    out = seen.groupBy("version_id").agg(hits.alias("heading_hits"), F.sum(F.size(F.filter("rows", entry))).alias("entries"))
    return out.withColumn("visible", (F.col("heading_hits") > 0) & (F.col("entries") >= 4))


def text_metrics(pages: DataFrame, first: int = 5) -> DataFrame:
    """Of the first pages of each version: words of two characters or more, Vietnamese letters, stop words, and whether these say that it is Vietnamese."""
    t = F.coalesce("text", F.lit(""))
    n_words = F.size(F.filter(F.split(t, _SPACES), lambda w: F.length(w) >= 2))
    letters = F.regexp_count(F.lower(t), F.lit(f"[{VIETNAMESE}]"))
    stops = reduce(lambda a, b: a + b, [F.regexp_count(F.lower(t), F.lit(w)) for w in STOP_WORDS])
    out = pages.where(F.col("page") < first).groupBy("version_id").agg(F.sum(n_words).alias("words"), F.sum(letters).alias("letters"), F.sum(stops).alias("stops"))
    return out.withColumn("vietnamese", (F.col("letters") >= 20) | (F.col("stops") >= 8))


def header_key(value: Column) -> Column:
    """A workbook's header: accents off, lower case, all but letters and digits to single spaces."""
    bare = F.translate(F.lower(F.coalesce(value, F.lit(""))), *accent_table())
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def safe_name(text: Column, longest: int = 80) -> Column:
    """A text as a file name: what is no letter, digit, mark or blank off, white space to underscores, cut."""
    bare = strip_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s.\-]", ""))
    return F.substring(F.regexp_replace(bare, _SPACES, "_"), 1, longest)


def source_name(original: Column, stored: Column) -> Column:
    """The name of a document's scanned text: the stem of its original file name, or else of the stored file's, and ``_ocr.md``."""

    def stem(name: Column) -> Column:
        file = F.regexp_extract(strip_text(F.coalesce(name, F.lit(""))), r"([^/]*)/*$", 1)
        return F.nullif(F.regexp_replace(file, r"^(.+)\.[^.]+$", "$1"), F.lit(""))

    return F.concat(F.coalesce(stem(original), stem(stored), F.lit("")), F.lit("_ocr.md"))


#: What kinds of assets and roles are called (fixed values).
ASSET_LABELS = {"table": "Bảng biểu", "figure": "Hình ảnh", "diagram": "Hình ảnh", "chart": "Hình ảnh", "image": "Hình ảnh", "logo": "Hình ảnh"}
ROLE_LABELS = {"admin": "Admin", "health_department": "Sở y tế", "central_hospital": "Bệnh viện Trung ương", "hospital": "Bệnh viện", "health_station": "Trạm y tế", "doctor": "Bác sĩ"}


def _labelled(value: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.try_element_at(known, value)


def asset_label(kind: Column) -> Column:
    """What an asset of a kind is called; an unknown kind by its name with a capital, none as a document."""
    text = F.coalesce(kind, F.lit(""))
    capital = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))
    return F.coalesce(_labelled(text, ASSET_LABELS), F.when(text == "", F.lit("Tài liệu")).otherwise(capital))


def role_label(role: Column) -> Column:
    """What a role is called; an unknown one by its name, null is empty."""
    return F.coalesce(_labelled(role, ROLE_LABELS), role, F.lit(""))


def joined(*parts: Column) -> Column:
    """Non-blank parts, stripped, with an empty line between them."""
    return F.array_join(F.filter(F.array(*(strip_text(F.coalesce(p, F.lit(""))) for p in parts)), lambda x: x != ""), "\n\n")


def section_label(heading: Column, path: Column, section_id: Column) -> Column:
    """What a section is called: its heading, or its path, or its number."""
    named = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(named(heading), F.concat(F.lit("Section "), named(path)), F.concat(F.lit("Section "), section_id.cast("string")))


def viewer_text(text: Column) -> Column:
    """A section's text for display: line ends, page breaks and page numbers off, tables without rows or cells as text, stray table tags off."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<!--\s*PAGE_BREAK\s*-->", "\n"), r"(?m)^[ \t]*\d+[ \t]*$", "\n")
    # a whole table is kept as it is if each of its rows has a cell
    good = r"(?is)^<table\b[^>]*>(?:(?!<tr\b).)*(?:<tr\b[^>]*>(?:(?!</tr|<tr\b).)*<t[hd]\b(?:(?!</tr|<tr\b).)*</tr\s*>(?:(?!<tr\b).)*)+</table>$"
    parts = F.split(F.regexp_replace(out, r"(?is)(<table\b[^>]*>.*?</table>)", "\u0000$1\u0000"), "\u0000")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))
    stray = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)<table\b[^>]*>", " "), r"(?i)</?(?:tbody|thead|tfoot|tr|td|th)\b[^>]*>", " ")
    shown = F.transform(parts, lambda x: F.when(x.rlike(good), x).when(x.rlike(r"(?is)^<table\b.*</table>$"), bare(x)).otherwise(stray(x)))
    return strip_text(F.regexp_replace(F.array_join(shown, ""), r"\n{3,}", "\n\n"))
