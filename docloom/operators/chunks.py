"""Chunks of scanned pages in a document's text: offsets, noise, headings, and the sections cut out of it.

texts: version_id, text. chunks: version_id, pos (order), id, type, text, boxes (array of boxes). Offsets count characters from 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.boundaries import bound_rows, heading_only, without_heading
from docloom.operators.positions import BOX, break_offsets, page_of_offset
from docloom.operators.sections import at_edge, noise_key

# Kinds of chunks that are noise; what the last line of an attribute block says of media, and what its first one says of no text.
NOISE = ("marginalia", "logo", "scan_code", "attestation")
MEDIA = (
    "flowchart", "figure", "photo", "chart", "diagram", "illustration", "table", "image", "visual content", "photos", "food photos", "collage of photos",
    "end_flowchart", "end_parallel_path", "parallel_path", "start", "end", "step", "path", "action", "decision",
    "transcription of the content: flowchart", "transcription of the content: figure",
)
NO_TEXT = ("flowchart", "figure", "table", "chart", "diagram", "start", "end", "image", "photo", "visual content", "transcription of the content")
ALT_TEXT = r"(?i)^(A |An |The |This |Two |Three |Four |Five |Several |Multiple |logo:|attestation:|flowchart:|table:|image:|figure:|diagram:|Image |Images |Image showing|A close-up|A composite|A split|A visual)"
_ANCHOR, _TABLE = r"<a id='([^']*)'></a>", r"(?i)<table[\s>]"


def _anchored(texts: DataFrame) -> DataFrame:
    """(version_id, size, id, start) of every anchor, and of what is behind the last one (without an id). A text is split once, and running sums of its parts' lengths give the offsets: no part of it is sorted."""
    lengths = F.transform(F.split("text", _ANCHOR, -1), lambda x: F.length(x)).alias("n")
    zipped = F.arrays_zip(lengths, F.regexp_extract_all("text", F.lit(_ANCHOR), F.lit(1)).alias("id"))
    # an array of one element, exploded, is computed once: a text's size would be computed anew for each of its anchors
    parts = texts.select("version_id", F.explode(F.array(F.struct(F.length("text").alias("size"), zipped.alias("parts")))).alias("t"))
    parts = parts.select("version_id", "t.size", F.posexplode_outer("t.parts").alias("k", "x"))
    n = F.col("x.n") + F.coalesce(F.length("x.id") + len("<a id=''></a>"), F.lit(0))
    before = Window.partitionBy("version_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n).over(before), F.lit(0)) + F.col("x.n")
    return parts.select("version_id", "size", F.col("x.id").alias("id"), start.cast("int").alias("start"))


def anchors(texts: DataFrame) -> DataFrame:
    """(version_id, id, start) of the first anchor of each id."""
    return _anchored(texts).where("id is not null").groupBy("version_id", "id").agg(F.min("start").alias("start"))


def _top() -> Column:
    """Where a chunk's first box begins."""
    return F.try_element_at("boxes", F.lit(1))["top"]


def measured(chunks: DataFrame) -> DataFrame:
    """Chunks with what the operators here ask of their texts, in place of these: ``only`` (has only headings), ``attribute`` (place of the first one), ``markup`` (has a table), ``noise_key`` (of text that is a header or footer, where chunks tell their type and boxes)."""
    edge = (F.col("type") == "text") & at_edge(_top()) if {"type", "boxes"} <= set(chunks.columns) else F.lit(True)
    key = F.when(edge, noise_key(F.col("text")))
    asked = {"only": heading_only(F.col("text")), "attribute": F.instr("text", "<::"), "markup": F.col("text").rlike(_TABLE), "noise_key": key}
    return chunks.withColumns(asked).drop("text")


def chunk_offsets(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks with ``start`` (-1 without an anchor) and ``end``: where the next chunk that has an anchor starts, or the text's length.

    Chunks and anchors meet by version_id, and ids inside of it, so chunks move once. They take all their columns along: ``measured`` ones have no text.
    """
    rest = [c for c in chunks.columns if c != "version_id"]
    own = F.struct(*(F.col(f"`{c}`") for c in rest))
    marks = _anchored(texts).groupBy("version_id").agg(F.first("size").alias("size"), F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "start"))).alias("anchors"))
    c = chunks.groupBy("version_id").agg(F.collect_list(own).alias("chunks")).join(marks, "version_id")
    kind = c.schema["chunks"].dataType.elementType
    rows = F.transform("chunks", lambda x: F.struct(x.alias("of"), x["id"].alias("id"), F.lit(None).cast("int").alias("start")))
    other = F.transform("anchors", lambda x: F.struct(F.lit(None).cast(kind).alias("of"), x["id"].alias("id"), x["start"].alias("start")))
    c = c.select("version_id", "size", F.explode(F.concat(rows, other)).alias("x")).select("version_id", "size", "x.*")
    c = c.withColumn("start", F.coalesce(F.min("start").over(Window.partitionBy("version_id", "id")), F.lit(-1))).where("of is not null")
    c = c.select("version_id", "size", *(F.col(f"of.`{x}`").alias(x) for x in rest), "start")
    later = Window.partitionBy("version_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(F.first(F.when(F.col("start") >= 0, F.col("start")), ignorenulls=True).over(later), F.col("size"))
    return c.withColumn("end", end).drop("size")


def noise_intervals(placed: DataFrame, times: int = 15) -> DataFrame:
    """(version_id, start, end, mark) of what is cut out of a document's text: noise and repeated headers and footers; figures and tables leave a mark.

    Of a figure the part from its first attribute on goes, of a table in markup only the anchor. placed: chunks with start and end, and text or what ``measured`` has of it.
    """
    c = placed if "noise_key" in placed.columns else measured(placed)
    c = c.withColumn("noise_key", F.when((F.col("type") == "text") & at_edge(_top()), F.col("noise_key")))
    c = c.withColumn("n", F.count("noise_key").over(Window.partitionBy("version_id", "noise_key")))
    c = c.withColumn("often", F.max(F.col("n") >= times).over(Window.partitionBy("version_id", "id"))).where("start >= 0 and end > start")
    anchor = F.length("id") + len("<a id=''></a>")
    noise = F.col("type").isin(*NOISE) | F.col("often")
    figure, table = F.col("type") == "figure", F.col("type") == "table"
    begin = F.when(~noise & figure & (F.col("attribute") > 0), F.least(F.col("start") + F.col("attribute") - 1, F.col("end"))).otherwise(F.col("start"))
    end = F.when(~noise & table & F.col("markup"), F.least(F.col("start") + anchor, F.col("end"))).otherwise(F.col("end"))
    mark = F.when(noise, "").when(figure | table, F.concat(F.lit("["), "type", F.lit(":"), "id", F.lit("]")))
    return c.select("version_id", begin.alias("start"), end.alias("end"), mark.alias("mark")).where("mark is not null")


def spliced(text: Column, start: Column, end: Column, noise: Column) -> Column:
    """A section's part of a text without the noise in it, marks in its place. noise: array of structs of start, end, mark, in order."""
    inside = F.filter(F.coalesce(noise, F.array().cast("array<struct<start:int,end:int,mark:string>>")), lambda n: (n["end"] > start) & (n["start"] < end))
    none = F.struct(start.cast("int").alias("at"), F.lit("").alias("out"))

    def cut(state: Column, n: Column) -> Column:
        begin, stop = F.greatest(n["start"], start), F.least(n["end"], end)
        kept = F.when(begin > state["at"], F.substring(text, state["at"] + 1, begin - state["at"])).otherwise("")
        return F.struct(F.greatest(state["at"], stop).cast("int").alias("at"), F.concat(state["out"], kept, n["mark"]).alias("out"))

    return F.aggregate(inside, none, cut, lambda s: F.concat(s["out"], F.when(s["at"] < end, F.substring(text, s["at"] + 1, end - s["at"])).otherwise("")))


def without_attributes(text: Column) -> Column:
    """A text whose attribute blocks keep only a body: one that ends in a line that names a medium, and does not begin with a description."""

    def body(block: Column) -> Column:
        rows = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
        last, first = T.strip_text(F.element_at(rows, -1)), T.strip_text(F.element_at(rows, 1))
        named = F.lower(T.strip_text(F.regexp_replace(last, "^:+", ""))).isin(*MEDIA)
        described = first.rlike(ALT_TEXT) | F.lower(first).isin(*NO_TEXT)
        rest = T.strip_text(F.array_join(F.filter(rows, lambda x: T.strip_text(x) != last), "\n"))
        return F.when(F.size(rows) < 2, "").when(named & ~described, rest).otherwise("")

    pattern = r"(?s)<::(.*?)::>"

    def without(text: Column) -> Column:
        parts, blocks = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        out = F.array_join(F.zip_with(parts, blocks, lambda p, b: F.concat(p, F.when(b.isNull(), "").otherwise(body(b)))), "")
        return F.regexp_replace(out, r"(?s)<::.*", "")

    out = T.let(text, lambda text: F.when(F.contains(text, F.lit("<::")), without(text)).otherwise(text))
    return F.regexp_replace(F.replace(out, F.lit("::>"), F.lit("")), r"\n{3,}", "\n\n")


def with_boxes(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections (version_id, section_id, chunk_ids) with ``chunks``: structs of id, type, box and boxes of theirs, in their order; unknown ids keep their place."""
    at = sections.select("version_id", "section_id", F.posexplode("chunk_ids").alias("k", "id"))
    found = at.join(chunks.select("version_id", "id", "type", "boxes"), ["version_id", "id"], "left")
    one = F.struct("k", "id", "type", F.try_element_at("boxes", F.lit(1)).alias("box"), "boxes")
    rows = found.groupBy("version_id", "section_id").agg(F.sort_array(F.collect_list(one)).alias("chunks"))
    return sections.join(rows, ["version_id", "section_id"], "left")


def _ends(rows: list[dict]) -> list[int | None]:
    """For nodes in pre-order (level, place or None): the place of the first later node that is no deeper and stands further on."""
    out: list[int | None] = [None] * len(rows)
    open_: list[int] = []
    for i, r in enumerate(rows):
        if r["place"] is None:
            continue
        still = []
        for k in open_:
            if rows[k]["level"] >= r["level"] and r["place"] > rows[k]["place"]:
                out[k] = r["place"]
            else:
                still.append(k)
        open_ = [*still, i]
    return out


def section_spans(nodes: DataFrame, placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes of a table of contents (version_id, idx, level, title, chunk_id) with the ``start`` and ``end`` of their text, and ``floor``.

    A node starts at its chunk and ends where the first later node starts that is no deeper and stands further on, or at the text's
    end. It starts no earlier than the nodes above it. A span turned round ends where its chunk ends; if that is no later either, nowhere.
    A row is one table of contents; many go to Python at once.
    """
    starts = placed.where("start >= 0").select("version_id", F.col("id").alias("chunk_id"), F.col("start").alias("place"), F.col("end").alias("chunk_end"))
    sizes = texts.select("version_id", F.length("text").alias("size"))
    n = nodes.select("version_id", "idx", "level", "title", "chunk_id").join(starts, ["version_id", "chunk_id"], "left").join(sizes, "version_id")

    @F.arrow_udf("array<struct<floor:int,next:int>>")
    def reach(levels: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for rows in ([{"level": a, "place": b} for a, b in zip(x, y, strict=True)] for x, y in zip(levels.to_pylist(), places.to_pylist(), strict=True)):
            floors, above = [], []
            for r in rows:
                above = [x for x in above if x[0] < r["level"]]
                floors.append(max((x[1] for x in above), default=0))
                if r["place"] is not None:
                    above.append((r["level"], max(r["place"], floors[-1])))
            out.append([{"floor": x, "next": y} for x, y in zip(floors, _ends(rows), strict=True)])
        return pa.array(out, pa.list_(pa.struct([("floor", pa.int32()), ("next", pa.int32())])))

    s = n.groupBy("version_id", "size").agg(F.sort_array(F.collect_list(F.struct("idx", "level", "title", "chunk_id", "place", "chunk_end"))).alias("nodes"))
    s = s.withColumn("reach", reach(F.transform("nodes", lambda x: x["level"]), F.transform("nodes", lambda x: x["place"])))
    s = s.select("version_id", "size", F.explode(F.arrays_zip("nodes", "reach")).alias("x")).select("version_id", "size", "x.nodes.*", "x.reach.*")
    start = F.greatest("place", "floor")
    end = F.coalesce("next", "size")
    end = F.when(end > start, end).when(F.col("chunk_end") > start, F.col("chunk_end"))
    return s.where("place is not null").select("version_id", "idx", "level", "title", "chunk_id", start.alias("start"), end.alias("end"), "floor")


def section_contents(spans: DataFrame, texts: DataFrame, noise: DataFrame, mark: str = T.PAGE_BREAK) -> DataFrame:
    """Spans with ``content`` (spliced, without heading, anchors, page breaks and attributes; null if empty), ``page_start`` and ``page_end``.

    spans: version_id, title, start, end and, if what belongs to children is to be left out, own_end. Marks of a figure or table that went with its heading come first.
    A text meets all its spans in one row, which cuts it: only the pieces move on.
    """
    marks = noise.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "mark"))).alias("noise"))
    upto = F.col("own_end") if "own_end" in spans.columns else F.col("end")
    s = spans.withColumn("upto", upto).groupBy("version_id").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in spans.columns if c != "version_id"), "upto")).alias("spans"))
    s = s.join(texts.select("version_id", "text", break_offsets(F.col("text"), mark).alias("breaks")), "version_id").join(marks, "version_id", "left")
    none = F.array().cast("array<struct<start:int,end:int,mark:string>>")

    def piece(x: Column) -> Column:
        inside = F.filter(F.coalesce("noise", none), lambda n: (n["mark"] != "") & (n["start"] >= x["start"]) & (n["start"] < x["upto"]))
        raw = F.when(x["upto"] > x["start"], spliced(F.col("text"), x["start"], x["upto"], F.col("noise")))
        return F.struct(x.alias("of"), raw.alias("raw"), F.transform(inside, lambda n: n["mark"]).alias("marks"), page_of_offset(x["start"], F.col("breaks")).alias("page_start"), page_of_offset(x["end"] - 1, F.col("breaks")).alias("page_end"))

    s = s.select("version_id", F.explode(F.transform("spans", piece)).alias("p"))
    bare = F.replace(F.regexp_replace("p.raw", r"(?s)<a\s+id='[^']*'>.*?</a>", ""), F.lit(mark), F.lit(""))
    # an array of one element, exploded, is computed once, for each of the marks too
    s = s.select("version_id", "p", F.explode(F.array(T.strip_text(without_heading(without_attributes(bare), F.col("p.of.title"))))).alias("content"))
    s = s.withColumn("missing", F.filter("p.marks", lambda m: ~F.coalesce(F.col("content"), F.lit("")).contains(m)))
    whole = F.array_join(F.filter(F.array(F.array_join("missing", "\n\n"), F.col("content")), lambda x: x != ""), "\n\n")
    page = lambda c, at: F.when(F.col(f"p.of.{at}").isNotNull(), F.col(f"p.{c}")).cast("int").alias(c)
    own = [F.col("version_id") if c == "version_id" else F.col(f"p.of.`{c}`").alias(c) for c in spans.columns]
    return s.select(*own, F.when(F.col("p.raw").isNotNull(), F.nullif(whole, F.lit(""))).alias("content"), page("page_start", "start"), page("page_end", "end"))


def section_nodes(nodes: DataFrame, placed: DataFrame, texts: DataFrame, mark: str = T.PAGE_BREAK) -> DataFrame:
    """The sections of a table of contents with all that is stored of them.

    nodes: version_id, idx, path (titles joined by ``/``), level, title, chunk_id; placed: chunks with start and end. Returns version_id, idx, node_id, level, title, start, end, content,
    page_start, page_end, score, heading_box (the first of the node's chunk), boxes (of its chunks before its first child's, by page) and
    landing_chunks (id and type of tables and figures there).
    """
    n = nodes.withColumn("node_id", T.node_id(F.col("path")))
    rows = bound_rows(n, placed, texts, node=("node_id",), chunk=("type", "boxes"))
    last = lambda x: F.when(x["child"] > x["first"], x["child"]).otherwise(x["until"])
    own = lambda x: F.transform(F.slice("chunks", x["first"] + 1, F.greatest(F.lit(1), last(x) - x["first"])), lambda c: F.struct(*(c[k].alias(k) for k in ("id", "type", "boxes"))))
    a = rows.select("version_id", F.explode(F.transform("bounds", lambda x: F.struct(x.alias("of"), own(x).alias("own")))).alias("x")).select("version_id", "x.of.*", "x.own")
    # without chunks of its own a node has no boxes at all
    none, has = F.array().cast(f"array<{BOX}>"), F.size("own") > 0
    head = F.try_element_at("own", F.lit(1))
    rest = F.flatten(F.transform(F.filter(F.slice("own", 2, F.greatest(F.lit(1), F.size("own"))), lambda c: c["type"] != "marginalia"), lambda c: F.coalesce(c["boxes"], none)))
    landing = F.transform(F.filter("own", lambda c: c["type"].isin("table", "figure")), lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type")))
    a = a.select("version_id", "idx", "node_id", "level", "title", "start", "end", "own_end", "score", head.alias("head"), F.when(has, rest).alias("rest"), F.when(has, landing).alias("landing_chunks"))
    boxes = F.when(F.size("rest") > 0, F.col("rest")).when(F.col("head.type") != "marginalia", F.coalesce("head.boxes", none)).when(F.col("rest").isNotNull(), none)
    at = lambda f, c: lambda p: f(F.transform(F.filter("boxes", lambda b: b["page"] == p), lambda b: F.round(b[c], 6)))
    by_page = lambda p: F.struct(p.alias("page"), at(F.array_min, "left")(p).alias("left"), at(F.array_min, "top")(p).alias("top"), at(F.array_max, "right")(p).alias("right"), at(F.array_max, "bottom")(p).alias("bottom"))
    a = a.withColumn("boxes", boxes).withColumn("boxes", F.transform(F.array_sort(F.array_distinct(F.transform("boxes", lambda b: b["page"]))), by_page))
    a = a.withColumn("heading_box", F.try_element_at("head.boxes", F.lit(1))).drop("head", "rest")
    out = section_contents(a, texts, noise_intervals(placed), mark)
    return out.select("version_id", "idx", "node_id", "level", "title", "start", "end", "content", "page_start", "page_end", "score", "heading_box", "boxes", "landing_chunks")


def overlap_end(before: str, after: str, reach: int = 4000, size: int = 60) -> int:
    """Where what ``after`` repeats of the end of ``before`` ends.

    Runs of ``size`` characters that both have are counted by how far the two texts are shifted there; the end is that of the furthest run whose
    shift is within 200 of the commonest one, so that a stray sentence that both have elsewhere does not count.
    """
    tail, head = before[-reach:].strip(), after[: 2 * reach]
    first: dict[str, int] = {}
    for k in range(len(head) - size + 1):
        first.setdefault(head[k : k + size], k)
    met = [(k - first[tail[k : k + size]], first[tail[k : k + size]]) for k in range(len(tail) - size + 1) if tail[k : k + size] in first]
    if not met:
        return 0
    shift = Counter(x for x, _ in met).most_common(1)[0][0]
    return max(at for x, at in met if abs(x - shift) <= 200) + size


_TABLE_ID, _ANY_ID = re.compile(r'<table id="(\d+)-'), re.compile(r'\bid="(\d+)-')
#: Pages that two parts have in common (a fixed value).
OVERLAP_PAGES = 3


def _table_shift(before: str, after: str, mark: str = T.PAGE_BREAK) -> int:
    """What must be added to the numbers of tables in ``after``: the first table of the pages in common has one number, else they go on."""
    numbers = lambda text: [int(x) for x in _TABLE_ID.findall(text)]
    old, new = before.split(mark), after.split(mark)
    common = numbers(mark.join(old[-OVERLAP_PAGES:]) if len(old) > OVERLAP_PAGES else before), numbers(mark.join(new[:OVERLAP_PAGES]))
    if all(common):
        return common[0][0] - common[1][0]
    every = numbers(before), numbers(after)
    return max(every[0]) + 1 - min(every[1]) if all(every) else 0


def numbered_tables(parts: list[str]) -> list[str]:
    """Parts of a document whose tables (``id="3-..."``) are numbered on from part to part, cells with them."""
    out = parts[:1]
    for part in parts[1:]:
        shift = _table_shift(out[-1], part)
        out.append(_ANY_ID.sub(lambda m, n=shift: f'id="{int(m[1]) + n}-', part) if shift else part)
    return out


def _joined(parts: list[str]) -> str:
    parts = numbered_tables([p.strip() for p in parts])
    out = parts[0]
    for part in parts[1:]:
        at = overlap_end(out, part)
        if at:
            line = part.find("\n", at)
            part = part[line + 1 if line >= 0 else at :].strip()
        out += f"\n\n{part}" if part else ""
    return out


def join_parts(parts: DataFrame, join: Callable[[list[str]], str] = _joined) -> DataFrame:
    """(version_id, text) of documents scanned in parts (version_id, part, text) whose ends overlap; tables are numbered on from part to part. One group is one document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return pd.DataFrame({"version_id": frame["version_id"].iloc[:1], "text": [join(frame["text"].fillna("").tolist())]})

    return parts.select("version_id", "part", "text").groupBy("version_id").applyInPandas(run, f"version_id {dict(parts.dtypes)['version_id']}, text string")
