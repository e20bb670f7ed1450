"""Sections in reading order: trees, offsets, noise, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import let, strip_text


def in_order(*more: Column) -> Window:
    return Window.partitionBy("version_id").orderBy("pos", *more)


def with_offsets(sections: DataFrame) -> DataFrame:
    """Character offsets of sections that one line feed parts: start and end."""
    before = F.sum(F.length("content") + 1).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return sections.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).withColumn("end", F.col("start") + F.length("content"))


def next_anchor(sections: DataFrame, start: str = "anchor", end: Column | None = None) -> DataFrame:
    """``until``: where the next anchored section begins; for the last ``end``, the text's length, or else null."""
    later = in_order().rowsBetween(1, Window.unboundedFollowing)
    until = F.first(F.when(F.col(start) >= 0, F.col(start)), ignorenulls=True).over(later)
    return sections.withColumn("until", until if end is None else F.coalesce(until, end))


def drop_consecutive_repeats(sections: DataFrame) -> DataFrame:
    before = F.lag("content").over(in_order())
    return sections.withColumn("before", before).where("before is null or before <> content").drop("before")


def last_heading(sections: DataFrame, is_heading: Column) -> DataFrame:
    """``heading_pos``: of the latest heading at or before a section."""
    return sections.withColumn("heading_pos", F.last(F.when(is_heading, F.col("pos")), ignorenulls=True).over(in_order()))


#: Where headers end and footers begin, as a share of the page's height (fixed values).
HEADER_TOP, FOOTER_TOP = 0.10, 0.85


def noise_key(text: Column) -> Column:
    """A text without anchors and a page number before it, in lower case, white space collapsed; null if nothing or over 200 characters."""
    bare = strip_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<a\s+id='[^']*'>.*?</a>", ""))
    key = lambda bare: F.lower(F.regexp_replace(strip_text(F.regexp_replace(bare, r"^\d{1,4}\s*[|/\-]\s*", "")), r"\s+", " "))
    return let(bare, lambda bare: F.when(F.length(bare) <= 200, F.nullif(key(bare), F.lit(""))))


def at_edge(top: Column) -> Column:
    """Whether a box that begins there is a header or a footer."""
    return (top < HEADER_TOP) | (top > FOOTER_TOP)


def repeated_noise(chunks: DataFrame, times: int = 15) -> DataFrame:
    """Text chunks at the top or foot of a page whose text stands there ``times`` times or more in one version, with the number.

    chunks: version_id, id, type, text and top (of the first box, null without boxes).
    """
    keyed = chunks.where((F.col("type") == "text") & at_edge(F.col("top"))).withColumn("key", noise_key(F.col("text"))).where("key is not null")
    same = Window.partitionBy("version_id", "key")
    return keyed.withColumn("times", F.count("*").over(same)).where(F.col("times") >= times)


def suspect_threshold(asked: float | None, default: float = 0.65) -> float:
    """The threshold asked for, between 0 and 1, or the default."""
    if asked is not None and not 0 < asked < 1:
        raise ValueError("a threshold lies between 0 and 1")
    return default if asked is None else asked


def is_suspect(score: Column, stored: Column, threshold: float) -> Column:
    """Whether a score is under the threshold; without a score, what was stored."""
    return F.when(score.isNull(), stored).otherwise(score < threshold)


def count_suspects(sections: DataFrame) -> DataFrame:
    """(version_id, n_suspect) of sections with ``is_suspect``."""
    return sections.groupBy("version_id").agg(F.count_if(F.coalesce("is_suspect", F.lit(False))).alias("n_suspect"))


def with_parents(sections: DataFrame) -> DataFrame:
    """``is_root``: no parent, or one that is not there; and the parent's text."""
    parents = sections.select("version_id", F.col("pos").alias("parent_pos"), F.col("content").alias("parent_content"), F.lit(True).alias("found"))
    return sections.join(parents, ["version_id", "parent_pos"], "left").withColumn("is_root", F.col("found").isNull()).drop("found")


def full_text(sections: DataFrame) -> DataFrame:
    """Non-empty contents in order, parted by an empty line."""
    parts = F.sort_array(F.collect_list(F.when(F.col("content") != "", F.struct("pos", "content"))))
    return sections.groupBy("version_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("full_text"))


def children(sections: DataFrame) -> DataFrame:
    """Each parent's children in order."""
    found = sections.where("parent_pos is not null").groupBy("version_id", "parent_pos")
    return found.agg(F.array_join(F.sort_array(F.collect_list("pos")), ",").alias("children"), F.count("*").alias("n_children"))


def sibling_numbers(sections: DataFrame) -> DataFrame:
    w = Window.partitionBy("version_id", F.coalesce("parent_pos", F.lit(-1))).orderBy("pos")
    return sections.withColumn("sibling", F.row_number().over(w))


def overlapping_batches(sections: DataFrame, size: int, overlap: int) -> DataFrame:
    """Every section once for each batch that holds it; batches begin every ``size - overlap`` sections."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step)).cast("int")
    return sections.withColumn("batch", F.explode(F.sequence(first, F.floor(F.col("pos") / step).cast("int"))))


def spread(rows: DataFrame, keys: list[str], order: str, weight: Column) -> DataFrame:
    """``place`` and ``until``: each row's part of its group's unit interval, by weight; groups without weight are cut evenly."""
    by = Window.partitionBy(*keys)
    rows = rows.withColumn("w", weight)
    rows = rows.withColumn("w", F.when(F.sum("w").over(by) > 0, F.col("w")).otherwise(1))
    before = F.sum("w").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("place", F.coalesce(before, F.lit(0)) / F.sum("w").over(by))
    return rows.withColumn("until", F.coalesce(F.lead("place").over(by.orderBy(order)), F.lit(1.0))).drop("w")


def bounding_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The union of the boxes of each key, to 6 digits."""
    return boxes.groupBy(*keys).agg(*(F.round(f(c), 6).alias(c) for f, c in ((F.min, "left"), (F.min, "top"), (F.max, "right"), (F.max, "bottom"))))


def best_interval(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each point (version_id, page) the shortest interval of its version that holds it, later starts first among equals.

    intervals: version_id, interval_id, first and last (null: its first page). An interval is dealt to the pages that
    points of its version ask for, so that points meet only intervals that hold them.
    """
    asked = points.select("version_id", "page").distinct()
    pages = asked.groupBy("version_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    held = intervals.withColumn("end", F.coalesce("last", "first")).join(pages, "version_id")
    held = held.withColumn("page", F.explode(F.filter("pages", lambda p: (p >= F.col("first")) & (p <= F.col("end")))))
    order = F.struct(-(F.col("end") - F.col("first")), F.col("first"), F.col("interval_id"))
    return held.groupBy("version_id", "page").agg(F.max_by("interval_id", order).alias("interval_id"))


def section_at(points: DataFrame, sections: DataFrame) -> DataFrame:
    """For each point (version_id, page, y or null) the section that it is in: version_id, page, y, section_id.

    Of the sections that hold the point: the one over the fewest pages, then the lowest on its page, the deepest, and the latest. If none does, of those that are
    on its page by the same order without heights; else the latest that begins on an earlier page, the deepest of these; else null.

    sections: version_id, section_id, level, page_start, start_y, page_end, end_y (a null last page: the first; on one page a single null height counts as 0).
    A section is dealt to the pages that points of its version ask for, so that points meet by equality those that are on their page.
    """
    unit = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    p = points.select("version_id", "page", "y").distinct()
    s = sections.where("page_start is not null").select("version_id", "section_id", F.coalesce("level", F.lit(0)).alias("level"), F.col("page_start").alias("first"), F.coalesce("page_end", "page_start").alias("last"), "start_y", "end_y")
    asked = p.groupBy("version_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))
    held = s.join(asked, "version_id").withColumn("page", F.explode(F.filter("pages", lambda x: (x >= F.col("first")) & (x <= F.col("last"))))).drop("pages")
    pages = F.col("last") - F.col("first")
    by_page = held.groupBy("version_id", "page").agg(F.min(F.struct(pages.alias("pages"), -F.col("level"), -F.col("first"), "section_id")).alias("best")).select("version_id", "page", F.col("best.section_id").alias("on_page"))
    one, y = F.col("first") == F.col("last"), unit(F.col("y"))
    low, high = unit(F.col("start_y")), unit(F.col("end_y"))
    blank = F.col("start_y").isNull() & F.col("end_y").isNull()
    above = (F.col("page") == F.col("first")) & F.coalesce(y < low, F.lit(False)) & F.col("start_y").isNotNull()
    under = (F.col("page") == F.col("last")) & F.col("end_y").isNotNull() & (y > high)
    holds = F.when(one, blank | ((low <= y) & (y <= high))).otherwise(~above & ~under)
    span = F.when(~one, (pages + 1).cast("double")).when(blank, 1.0).otherwise(F.greatest(high - low, F.lit(0.0)))
    inside = p.join(held, ["version_id", "page"]).where(holds)
    best = inside.groupBy("version_id", "page", "y").agg(F.min(F.struct(pages.alias("pages"), span.alias("span"), -F.col("level"), -F.col("first"), -low, "section_id")).alias("best")).select("version_id", F.col("page"), F.col("y"), F.col("best.section_id").alias("at_point"))
    # pages and beginnings in one order: the latest beginning before each page
    starts = s.groupBy("version_id", F.col("first").alias("page")).agg(F.max_by("section_id", F.struct("level", F.col("section_id") * -1)).alias("begins"))
    order = Window.partitionBy("version_id").orderBy("page", F.col("begins").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.union(p.select("version_id", "page", F.lit(None).cast(starts.schema["begins"].dataType)).distinct())
    before = both.withColumn("before", F.last("begins", ignorenulls=True).over(order)).where("begins is null").select("version_id", "page", "before")
    same_y = (F.col("p.version_id") == F.col("b.version_id")) & (F.col("p.page") == F.col("b.page")) & F.col("p.y").eqNullSafe(F.col("b.y"))
    out = p.alias("p").join(best.alias("b"), same_y, "left").select("p.version_id", "p.page", "p.y", "b.at_point")
    out = out.join(by_page, ["version_id", "page"], "left").join(before, ["version_id", "page"], "left")
    return out.select("version_id", "page", "y", F.coalesce("at_point", "on_page", "before").alias("section_id"))
