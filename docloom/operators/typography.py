"""Outlines of documents without bookmarks, from the type of their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.outline import number_level
from docloom.functions.text import strip_text
from docloom.operators.positions import binary_round
from docloom.operators.trees import levels_to_parents

#: Points that a heading's type is larger than the body's by, and the bit of bold type (fixed values).
LARGER, BOLD = 1.5, 16


def body_sizes(spans: DataFrame) -> DataFrame:
    """(version_id, body): the size that most spans of a version have; of several the one that comes first."""
    counts = spans.groupBy("version_id", "size").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("version_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def headings_by_type(spans: DataFrame, pages: DataFrame, level: Callable[[Column], Column] = number_level) -> DataFrame:
    """Headings by their type: version_id, pos (from 0), page, y (share of the page), level, title, parent_pos.

    spans: version_id, seq (unique place in the document), page, y0 (of the span's block), size, flags, text; pages: version_id, page, height. A heading
    is numbered (1.2 is of level 2; chapters and parts by name are of level 1) and either larger than the body or bold; of several at one height the
    first counts. Its parent is the nearest earlier heading of a smaller level. Blank and null spans count for nothing, also not for the body's
    size; ``level`` tells another rule of titles' levels (null: no heading; a number or a c or p must begin the title); a missing page or null height is 1 point, one of 0 or less gives y 0; a null size is no size, null flags are none. Only spans that are numbered move
    to meet the body's size, which comes from counts of sizes.
    """
    title = strip_text(F.regexp_replace(F.replace("text", F.lit("\u00ad"), F.lit("")), r"[ \t]+", " "))
    s = spans.where(F.col("text").rlike(r"\S")).select("version_id", "seq", "page", "y0", binary_round(F.col("size"), 1).alias("size"), "flags", "text")
    # titles are cleaned once and only where a number or a chapter may begin: as a plain column the cleaning would be put into every use of the title
    numbered = s.where(F.col("text").rlike(r"^[\s\u00ad]*[\dCcPp]")).withColumn("title", F.explode(F.array(title))).drop("text")
    numbered = numbered.withColumn("level", level(F.col("title"))).where("level is not null")
    large = F.coalesce(F.col("size") > F.col("body") + LARGER, F.lit(False))
    bold = F.coalesce(F.col("flags").bitwiseAND(BOLD) > 0, F.lit(False))
    found = numbered.join(body_sizes(s.where("size is not null").select("version_id", "seq", "size")), "version_id", "left").where(large | bold)
    found = found.groupBy("version_id", "page", "y0").agg(F.min(F.struct("seq", "level", "title")).alias("h")).select("version_id", "page", "y0", "h.*")
    height = F.coalesce("height", F.lit(1.0))
    y = F.when(height > 0, binary_round(F.least(F.greatest(F.col("y0") / height, F.lit(0.0)), F.lit(1.0)))).otherwise(0.0)
    found = found.join(pages.select("version_id", "page", "height"), ["version_id", "page"], "left").withColumn("y", y)
    order = Window.partitionBy("version_id").orderBy("page", "y0")
    placed = found.select("version_id", (F.row_number().over(order) - 1).alias("pos"), "page", "y", "level", "title")
    return levels_to_parents(placed)
