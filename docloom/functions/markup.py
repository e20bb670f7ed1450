"""Markup inside texts, by regular expressions in the JVM: table cells, list items, headings, bold spans, placeholders."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(column: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(pattern), F.lit(group))


def plain(column: Column) -> Column:
    """Without tags; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), "(?s)<[^>]*>", " "), r"\s+", " "))


def html_cells(df: DataFrame, key: str, column: str) -> DataFrame:
    """The cells of a text's tables: key, row and column (from 0), text, colspan, rowspan, is_header. Tables follow each other in row numbers; tables within cells are not told apart."""
    rows = df.select(key, F.posexplode(_all(F.col(column), r"(?is)<tr\b[^>]*>(.*?)</tr\s*>")).alias("row", "html"))
    cells = rows.select(key, "row", F.posexplode(_all(F.col("html"), r"(?is)<t[hd]\b[^>]*>.*?</t[hd]\s*>", 0)).alias("column", "cell"))
    span = lambda name: F.coalesce(F.regexp_extract("cell", rf"(?is)^<t[hd]\b[^>]*\b{name}\s*=\s*['\"]?(\d+)", 1).try_cast("int"), F.lit(1))
    return cells.select(key, "row", "column", plain(F.col("cell")).alias("text"), span("colspan").alias("colspan"), span("rowspan").alias("rowspan"), F.lower("cell").startswith("<th").alias("is_header"))


def list_items(column: Column) -> Column:
    return F.transform(_all(column, r"(?is)<li\b[^>]*>(.*?)</li\s*>"), plain)


def html_headings(column: Column) -> Column:
    return F.transform(_all(column, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"), plain)


def bold_spans(column: Column) -> Column:
    return _all(column, r"\*\*([^*\n]+)\*\*")


def flow_steps(column: Column) -> Column:
    """The steps of a flow chart written with arrows."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\s*(?:-->|->|=>|→|⇒|↓|⬇)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def placeholders(column: Column) -> Column:
    """``[figure:id]`` and ``[table:id]`` in a text, whatever their case, as structs of kind and id."""
    found = _all(column, r"(?i)\[((?:figure|table):[^\]]*[^\]\s][^\]]*)\]")
    return F.transform(found, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("kind"), F.trim(F.regexp_replace(x, "^[A-Za-z]+:", "")).alias("id")))


def assets(column: Column) -> Column:
    """Assets in a JSON array: those with an id and an address, of kind ``asset`` if they tell none."""
    raw = F.from_json(column, "array<struct<id:string,type:string,image_url:string>>")
    good = F.filter(F.coalesce(raw, F.array().cast("array<struct<id:string,type:string,image_url:string>>")), lambda a: (F.coalesce(a["id"], F.lit("")) != "") & (F.coalesce(a["image_url"], F.lit("")) != ""))
    return F.transform(good, lambda a: F.struct(a["id"].alias("id"), F.coalesce(a["type"], F.lit("asset")).alias("type"), a["image_url"].alias("image_url")))


def own_assets(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assets (version_id, path, asset_id) that no section below has too. nodes: version_id, path (array of places on the way down)."""
    below = assets.withColumn("above", F.explode(F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))))).select("version_id", F.col("above").alias("path"), "asset_id")
    return assets.join(nodes.select("version_id", "path"), ["version_id", "path"], "left_semi").join(below.distinct(), ["version_id", "path", "asset_id"], "left_anti")


def resolved(placeholders: DataFrame, assets: DataFrame, key: str = "section_id") -> DataFrame:
    """Placeholders (section_id, kind, id) with the ``image_url`` of their section's asset (section_id, type, id, image_url): of the same kind first, else of the id alone."""
    last = lambda by: assets.groupBy(key, *by).agg(F.max("image_url").alias("url"))
    typed = last(["type", "id"]).withColumnsRenamed({"type": "kind", "url": "typed"})
    plain = last(["id"]).withColumnRenamed("url", "plain")
    return placeholders.join(typed, [key, "kind", "id"], "left").join(plain, [key, "id"], "left").select(key, "kind", "id", F.coalesce("typed", "plain").alias("image_url"))


# What opens a block, how a block may end and be named, and arrows between the steps of a flow chart.
_ASSET = r"\[(?i:figure|table):(?=[^\]]*[^\]\s])[^\]]+\]"
_OPENS = re.compile(rf"(?P<table><table)|(?P<custom><::)|(?P<asset>{_ASSET})")
_WHOLE_TABLE = re.compile(r"(?is)<table\b.*?</table>")
_TYPED_END, _LAST_TYPE, _FIRST_TYPE = re.compile(r":\s*[A-Za-z][\w-]*\s*::>"), re.compile(r":\s*([A-Za-z][\w-]*(?:\s+[A-Za-z][\w-]*)*)\s*::>\s*$"), re.compile(r"^<::\s*([A-Za-z][\w-]*)\s*:(?!:>)\s*")
_ARROW, _ARROWS_ONLY = re.compile(r"->|=>|→|↓|⬇"), re.compile(r"^(?:↓|⬇|->|=>|→)+$")
_MARKS = re.compile(rf"(?i)<::\s*[a-z][\w-]*(?:\s+[a-z][\w-]*)*\s*::>|</?(?:table|tbody|thead|tfoot|tr|td|th)\b[^>]*>|{_ASSET}|<::\s*|\n?[ \t]*:[ \t]*[a-z][\w-]*(?:\s+[a-z][\w-]*)*[ \t]*::>\s*$|\s*::>", re.MULTILINE)


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", _MARKS.sub(" ", text))).strip()


def _custom_end(text: str, at: int) -> tuple[int, bool]:
    """Where the custom block at ``at`` ends, and whether by its own mark: before the next whole table, placeholder, or block that begins a line."""
    limit = len(text)
    for m in _OPENS.finditer(text, at + 3):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if m["asset"] or (m["table"] and _WHOLE_TABLE.match(text, m.start())) or (m["custom"] and not line.strip()):
            limit = m.start()
            break
    typed = _TYPED_END.search(text, at + 3, limit)
    plain_end = text.find("::>", at + 3, limit)
    return (typed.end(), True) if typed else (plain_end + 3, True) if plain_end >= 0 else (limit, False)


def _custom(raw: str, closed: bool) -> tuple[str, str]:
    """Type and value of a custom block; one that does not end counts only if it looks like one."""
    last, first = _LAST_TYPE.search(raw), _FIRST_TYPE.match(raw)
    name = re.sub(r"[\s_]+", "-", (last or first)[1].strip().lower()) if last or first else ""
    body = raw[first.end() :] if first else re.sub(r"^<::\s*", "", raw)
    value = _tidy(_LAST_TYPE.sub("", body) if last else body)
    if not value:
        return "text", _tidy(raw)
    rows = [x.strip() for x in value.split("\n") if x.strip()]
    if name in ("flow", "flowchart", "flow-chart"):
        sure = len(rows) == 1 and _ARROW.search(rows[0]) and not _ARROWS_ONLY.match(rows[0]) or len(rows) > 2 and any(map(_ARROWS_ONLY.match, rows))
        kind = "flowchart"
    else:
        sure, kind = name or re.match(r"^<::\s*[A-Za-z][\w-]*\s*:[^\n]+$", raw), "custom"
    return (kind, value) if closed or sure else ("text", _tidy(raw))


def blocks_of(text: str | None) -> list[tuple[str, str]]:
    """Type and value of the blocks of one rich text, in order."""
    text, out, at = text or "", [], 0
    while m := _OPENS.search(text, at):
        out.append(("text", _tidy(text[at : m.start()])))
        at = m.start()
        if m["asset"]:
            out.append(("asset", m[0]))
            at = m.end()
        elif m["table"]:
            whole = _WHOLE_TABLE.match(text, at)
            if whole:
                has_rows = re.search(r"(?is)<tr\b[^>]*>.*?<t[hd]\b", whole[0])
                out.append(("table", whole[0]) if has_rows else ("text", _tidy(whole[0])))
                at = whole.end()
            else:  # only its own mark goes
                at = max(at, text.find(">", at)) + 1
        else:
            end, closed = _custom_end(text, at)
            out.append(_custom(text[at:end], closed))
            at = max(at + 3, end)
    out.append(("text", _tidy(text[at:])))
    return [(kind, value) for kind, value in out if value]


def _blocks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"type": kind, "value": value} for kind, value in blocks_of(t)])


def content_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """The blocks of rich texts in order: key, number, type (text, asset, table, flowchart or custom) and value.

    Blocks are tables, custom blocks between ``<::`` and ``::>``, and placeholders of figures and tables; what is between them is text. A custom block may name its
    type first or last (``<:: flow : A -> B``). One that does not end goes on to the next block or the end, if it is of a type or looks
    like one, else it is text. A table that does not end loses its mark, one without rows is text. Null and empty texts have no blocks; the key may have any name.
    """
    found = df.select(F.col(f"`{key}`").alias("of"), F.posexplode(F.pandas_udf(_blocks, "array<struct<type:string,value:string>>")(F.col(f"`{column}`"))).alias("number", "block"))
    return found.select(F.col("of").alias(key), "number", F.col("block.type").alias("type"), F.col("block.value").alias("value"))


def unplaced_assets(assets: DataFrame, texts: DataFrame, key: str = "section_id") -> DataFrame:
    """Assets (section_id, asset_id) that their section's text (section_id, text) has no placeholder for."""
    placed = texts.select(key, F.explode(placeholders(F.col("text"))).alias("p")).select(key, F.col("p.id").alias("asset_id"))
    return assets.join(placed, [key, "asset_id"], "left_anti")


def pack_paragraphs(column: Column, longest: int) -> Column:
    """A text's paragraphs joined into parts of ``longest`` characters at most. A longer paragraph is cut, and its cuts stay parts of their own."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    piece = lambda text, whole: F.struct(text.alias("text"), whole.alias("whole"))
    text = strip(F.coalesce(column, F.lit("")))
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")
    cuts = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / longest).cast("int")), lambda k: strip(F.substring(p, k * longest + 1, F.lit(longest))))
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= longest, F.array(piece(p, F.lit(True)))).otherwise(F.transform(F.filter(cuts(p), lambda x: x != ""), lambda x: piece(x, F.lit(False))))))

    def add(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = (F.size(done) > 0) & last["whole"] & p["whole"] & (F.length(last["text"]) + 2 + F.length(p["text"]) <= longest)
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(fits, F.concat(head, F.array(piece(F.concat(last["text"], F.lit("\n\n"), p["text"]), F.lit(True))))).otherwise(F.concat(done, F.array(p)))

    packed = F.transform(F.aggregate(pieces, F.array().cast("array<struct<text:string,whole:boolean>>"), add), lambda x: x["text"])
    # a text that fits is one part as it stands
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= longest, F.array(text)).otherwise(packed)
