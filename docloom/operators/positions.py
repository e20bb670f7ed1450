"""Places on pages: boxes, viewer positions of sections, character offsets and pages.

A box is a struct of page (from 0), left, top, right and bottom, as shares of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = "struct<page:int,left:double,top:double,right:double,bottom:double>"


def unit(y: Column, height: Column) -> Column:
    """A height on a page as a share of it, between 0 and 1, to 6 digits; 0 on a page without height."""
    return F.when(height > 0, F.round(F.least(F.greatest(y / height, F.lit(0.0)), F.lit(1.0)), 6)).otherwise(0.0)


def flipped(y: Column, height: Column) -> Column:
    """From a height above the page's foot to one below its top, or back."""
    return height - y


def widened(box: Column, margin: float) -> Column:
    """A box with a margin, inside the page; null if it has no area."""
    at = {c: F.greatest(F.lit(0.0), box[c] - margin) for c in ("left", "top")} | {c: F.least(F.lit(1.0), box[c] + margin) for c in ("right", "bottom")}
    out = F.struct(box["page"].alias("page"), *(at[c].alias(c) for c in ("left", "top", "right", "bottom")))
    return F.when((at["right"] > at["left"]) & (at["bottom"] > at["top"]), out)


def in_pixels(box: Column, width: Column, height: Column) -> Column:
    """A box's corner and size on a page of so many pixels."""
    return F.struct((box["left"] * width).alias("x"), (box["top"] * height).alias("y"), ((box["right"] - box["left"]) * width).alias("w"), ((box["bottom"] - box["top"]) * height).alias("h"))


def viewer_position(heading: Column, contents: Column, page_start: Column, page_end: Column, start_y: Column, end_y: Column) -> Column:
    """Where a viewer shows a section: the heading's box, else the first box of its contents, else what is stored; pages count from 1.

    It ends on the last page of its contents, at the bottom of the last box there.
    """
    boxes = F.filter(F.coalesce(contents, F.array().cast(f"array<{BOX}>")), lambda b: b.isNotNull())
    first = F.try_element_at(boxes, F.lit(1))
    begin = F.coalesce(heading["page"], first["page"]) + 1
    end = F.coalesce(F.array_max(F.transform(boxes, lambda b: b["page"])) + 1, begin)
    there = F.filter(boxes, lambda b: end.isNull() | (b["page"] + 1 == end))
    last = F.coalesce(F.try_element_at(there, F.lit(-1)), F.try_element_at(boxes, F.lit(-1)))
    bottom = F.when(F.size(boxes) > 0, last["bottom"]).otherwise(heading["bottom"])
    return F.struct(
        F.coalesce(begin, page_start).alias("page_start"), F.coalesce(end, page_end).alias("page_end"),
        F.coalesce(heading["top"], first["top"], start_y).alias("start_y"), F.coalesce(bottom, end_y).alias("end_y"),
    )


def stored_position(heading: Column, contents: Column, page_start: Column, page_end: Column, start_y: Column, end_y: Column) -> Column:
    """The same when a section is stored: what is given explicitly comes before what the boxes say."""
    none = F.lit(None)
    seen = viewer_position(heading, contents, none.cast("int"), none.cast("int"), none.cast("double"), none.cast("double"))
    given = {"page_start": page_start, "page_end": page_end, "start_y": start_y, "end_y": end_y}
    return F.struct(*(F.coalesce(c, seen[k]).alias(k) for k, c in given.items()))


def binary_round(x: Column, digits: int = 6) -> Column:
    """A double to so many digits by its binary value, halves to even; ``round`` goes by its shortest decimal text instead."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit("")).cast("double")


def apart(sections: DataFrame) -> DataFrame:
    """Sections whose headings share a box get places of their own inside it, by the lengths of their texts.

    sections: version_id, section_id, order (place in the tree), heading_box, position (as ``viewer_position`` gives) and text. Without any
    text the parts are equal. Boxes without a height change nothing.
    """
    box = ["version_id", "position.page_start", "heading_box.left", "heading_box.top", "heading_box.right", "heading_box.bottom"]
    group = Window.partitionBy(*box)
    s = sections.withColumn("weight", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).cast("double"))
    s = s.withColumns({"n": F.count("*").over(group), "all": F.sum("weight").over(group)})
    s = s.withColumn("weight", F.when(F.col("all") > 0, F.col("weight")).otherwise(1.0)).withColumn("all", F.sum("weight").over(group))
    before = F.coalesce(F.sum("weight").over(group.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    top, bottom = F.col("heading_box.top"), F.col("heading_box.bottom")
    s = s.withColumn("start", F.least(bottom, top + (bottom - top) * (before / F.col("all"))))
    s = s.withColumn("next", F.coalesce(F.lead("start").over(group.orderBy("order")), bottom))
    start = binary_round(F.greatest(top, F.col("start")))
    end = binary_round(F.greatest(start, F.least(bottom, F.col("next"))))
    shared = F.col("heading_box").isNotNull() & (F.col("n") > 1) & (bottom > top)
    moved = F.when(shared, F.col("position").withField("start_y", start).withField("end_y", end)).otherwise(F.col("position"))
    return s.withColumn("position", moved).select(*sections.columns)


def page_of_offset(offset: Column, breaks: Column) -> Column:
    """The page, from 1, of a character: one more than the page breaks up to it. breaks: array of their offsets."""
    return F.size(F.filter(breaks, lambda b: b <= offset)) + 1


def break_offsets(text: Column, mark: str) -> Column:
    """The offsets of a mark in a text."""
    parts = F.split(text, F.lit("\\Q" + mark + "\\E"), -1)
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + len(mark), F.lit(0)) + F.length(p))))
    return F.slice(ends, 1, F.size(ends) - 1)


def anchor_offset(text: Column, chunk_id: Column) -> Column:
    """Where a chunk's anchor stands in a text, from 0; -1 if nowhere."""
    return F.instr(text, F.concat(F.lit("<a id='"), chunk_id, F.lit("'></a>"))) - 1


def highlight_boxes(sections: DataFrame) -> DataFrame:
    """A box as wide as the page for each page of a section (section_id, page_start, page_end, start_y, end_y); empty ones go."""
    pages = sections.where("page_start is not null").withColumn("page", F.explode(F.sequence("page_start", F.greatest("page_start", F.coalesce("page_end", "page_start")))))
    top = F.when(F.col("page") == F.col("page_start"), F.coalesce("start_y", F.lit(0.0))).otherwise(0.0)
    bottom = F.when(F.col("page") == F.coalesce("page_end", "page_start"), F.coalesce("end_y", F.lit(1.0))).otherwise(1.0)
    return pages.select("section_id", "page", F.lit(0.0).alias("left"), top.alias("top"), F.lit(1.0).alias("right"), bottom.alias("bottom")).where("bottom > top")


def last_heading_above(points: DataFrame, headings: DataFrame, slack: float = 0.02) -> DataFrame:
    """For each point (version_id, page, y) the last heading (version_id, section_id, level, page, y) that begins above it, or ``slack`` below: one window, no join."""
    kind = headings.schema["section_id"].dataType
    h = headings.select("version_id", "page", "y", F.lit(0).alias("late"), F.col("level").cast("int").alias("level"), "section_id")
    p = points.select("version_id", "page", "y", F.lit(1).alias("late"), F.lit(0).alias("level"), F.lit(None).cast(kind).alias("section_id"))
    both = h.withColumn("at", F.col("y")).union(p.withColumn("at", F.col("y") + slack))
    w = Window.partitionBy("version_id").orderBy("page", "at", "late", "level").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section_id", F.last("section_id", ignorenulls=True).over(w)).where("late = 1").select("version_id", "page", "y", "section_id")


def nearest_anchored(rows: DataFrame, anchor: str = "anchor") -> DataFrame:
    """``near``: the anchor of the nearest row in reading order that has one, the earlier of two as near. rows: version_id, pos (from 0, without gaps)."""
    order = Window.partitionBy("version_id").orderBy("pos")
    here = F.when(F.col(anchor).isNotNull(), F.struct(F.col("pos").alias("at"), F.col(anchor).alias("anchor")))
    before = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    r = rows.withColumns({"before": before, "after": after})
    earlier = F.col("after").isNull() | (F.col("pos") - F.col("before.at") <= F.col("after.at") - F.col("pos"))
    return r.withColumn("near", F.when(F.col("before").isNotNull() & earlier, F.col("before.anchor")).otherwise(F.col("after.anchor"))).drop("before", "after")


def reading_order(chunks: DataFrame) -> list[Column]:
    """Order of chunks on pages: by the first box's page, top and left; those without a box last."""
    return [F.coalesce(F.col("box.page"), F.lit(9999)), F.coalesce(F.col("box.top"), F.lit(0.0)), F.coalesce(F.col("box.left"), F.lit(0.0)), F.col("id")]
