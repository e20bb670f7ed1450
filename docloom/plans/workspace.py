"""One version with all that a viewer shows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip_text
from docloom.operators.positions import apart, viewer_position
from docloom.operators.sections import is_suspect, suspect_threshold

#: Other names of pipelines (fixed values).
MODES = {"auto": ("", "auto"), "ocr_llm": ("ocr", "ocr_llm"), "spatial_pdf": ("spatial", "spatial_pdf", "native_pdf", "pymupdf")}


def pipeline_mode(name: Column) -> Column:
    """A pipeline by its name or another name of it; unknown names stay."""
    bare = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = bare
    for mode, names in MODES.items():
        out = F.when(bare.isin(*names), mode).otherwise(out)
    return out


def positioning_mode(mode: Column) -> Column:
    return F.when(mode == "spatial_pdf", "spatial_heading_anchor").otherwise("page_range")


def mode_used(documents: DataFrame) -> DataFrame:
    """(version_id, mode) of the first document of a version, by id, that tells one."""
    bare = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    return documents.withColumn("mode", bare).where("mode <> ''").groupBy("version_id").agg(F.min_by("mode", "document_id").alias("mode"))


def shown_sections(sections: DataFrame, threshold: float | None = None) -> DataFrame:
    """Sections with what a viewer needs: ``position``, ``suspect``, ``parent`` (null for roots, also where the parent is missing) and ``siblings_order``.

    sections: version_id, section_id, parent_id, order_index, heading_box, boxes, page_start, page_end, start_y, end_y, score, is_suspect, content, tree_order.
    """
    limit = suspect_threshold(threshold)
    s = sections.withColumn("position", viewer_position(F.col("heading_box"), F.col("boxes"), F.col("page_start"), F.col("page_end"), F.col("start_y"), F.col("end_y")))
    s = apart(s.withColumn("order", F.col("tree_order")).withColumn("text", F.col("content")))
    s = s.withColumn("suspect", is_suspect(F.col("score"), F.col("is_suspect"), limit))
    there = sections.select("version_id", F.col("section_id").alias("parent"))
    return s.join(there, (s["version_id"] == there["version_id"]) & (s["parent_id"] == there["parent"]), "left").drop(there["version_id"]).drop("order", "text")


def full_text(sections: DataFrame) -> DataFrame:
    """(version_id, full_text): contents by order, those without one last, parted by empty lines."""
    part = F.when(strip_text(F.coalesce("content", F.lit(""))) != "", F.struct(F.col("order_index").isNull().alias("late"), "order_index", "section_id", "content"))
    return sections.groupBy("version_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["content"]), "\n\n").alias("full_text"))


def workspace(versions: DataFrame, guidelines: DataFrame, documents: DataFrame, sections: DataFrame, threshold: float | None = None, with_text: bool = True) -> DataFrame:
    """A row for each version: its guideline, documents in the order of ids, pipeline, numbers of sections and of suspect ones, and the whole text.

    For one version, filter ``versions``; the filter reaches the other tables through the joins. ``shown_sections`` gives the tree.
    """
    wanted = versions.select("version_id")
    docs = documents.join(wanted, "version_id", "left_semi")
    listed = docs.groupBy("version_id").agg(F.sort_array(F.collect_list("document_id")).alias("documents"))
    own = sections.join(wanted, "version_id", "left_semi")
    counts = own.groupBy("version_id").agg(F.count("*").alias("n_sections"), F.count_if(is_suspect(F.col("score"), F.coalesce("is_suspect", F.lit(False)), suspect_threshold(threshold))).alias("n_suspect"))
    out = versions.join(guidelines, "guideline_id").join(listed, "version_id", "left").join(mode_used(docs), "version_id", "left").join(counts, "version_id", "left")
    out = out.withColumns({"positioning": positioning_mode(F.col("mode")), "n_sections": F.coalesce("n_sections", F.lit(0)), "n_suspect": F.coalesce("n_suspect", F.lit(0))})
    return out.join(full_text(own), "version_id", "left") if with_text else out
