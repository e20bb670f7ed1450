"""Tables as files: versions replaced as a whole, artifacts, texts and trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import clean_markup
from docloom.operators.positions import stored_position
from docloom.session import cut_table


def replace_versions(rows: DataFrame, path: str, key: str = "version_id") -> None:
    """Replaces the rows of every version that ``rows`` has; other versions stay. ``rows`` must not be read from ``path``.

    A version is one folder, so its rows are one task's; the versions of a batch are dealt over all tasks.
    """
    rows.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def section_rows(tree: DataFrame) -> DataFrame:
    """Sections (version_id, section_path, heading, content, any others) with ids that a rerun repeats, parents, level and order."""
    steps = F.split("section_path", r"\.")
    parent = F.when(F.size(steps) > 1, F.array_join(F.slice(steps, 1, F.size(steps) - 1), "."))
    return tree.withColumns({
        "section_id": F.xxhash64("version_id", "section_path"),
        "parent_id": F.when(parent.isNotNull(), F.xxhash64("version_id", parent)),
        "level": F.size(steps),
        "order_index": F.element_at(steps, -1).try_cast("int"),
    })


def placed_sections(tree: DataFrame, documents: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``section_rows`` with the version's first document, the place on its pages, the score to 4 digits and whether it is suspect.

    tree: also heading_box, boxes, page_start, page_end, start_y, end_y and score; what is given comes before what the boxes say.
    """
    first = documents.groupBy("version_id").agg(F.min("document_id").alias("document_id"))
    at = stored_position(*(F.col(c) for c in ("heading_box", "boxes", "page_start", "page_end", "start_y", "end_y")))
    rows = section_rows(tree).join(first, "version_id", "left").withColumn("at", at)
    rows = rows.withColumns({c: F.col("at")[c] for c in ("page_start", "page_end", "start_y", "end_y")}).drop("at")
    return rows.withColumns({"score": F.round("score", 4), "is_suspect": F.coalesce(F.col("score") < threshold, F.lit(False))})


def half_precision(vector: Column, size: int = 3072) -> Column:
    """A vector as the text of half-precision numbers, ``[0.5,1.25]``; null unless it has ``size`` of them.

    A half has 11 significant bits: a number is rounded to the nearest multiple of its size over 1024, half to even.
    """

    def half(x: Column) -> Column:
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
        return F.when(x == 0, 0.0).otherwise(F.rint(x / step) * step)

    return F.when(F.size(vector) == size, F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: half(x.cast("double")).cast("string")), ","), F.lit("]")))


def chunk_rows(chunks: DataFrame, vectors: DataFrame, size: int = 3072) -> DataFrame:
    """Chunks (version_id, path, context, text) with ids that a rerun repeats, and the vector of their text (version_id, path, vector)."""
    v = vectors.select("version_id", "path", half_precision(F.col("vector"), size).alias("embedding"))
    return chunks.join(v, ["version_id", "path"], "left").withColumn("chunk_id", F.xxhash64("version_id", "path"))


def write_artifacts(rows: DataFrame, path: str) -> None:
    """One JSON folder for each guideline and version."""
    rows.write.mode("overwrite").partitionBy("guideline_id", "version_id").json(path)


def write_clean_markdown(texts: DataFrame, path: str) -> None:
    """Cleaned markdown (stem, text): a folder for each stem; a line feed ends each text."""
    clean = texts.select("stem", clean_markup(F.col("text")).alias("value"))
    clean.repartition("stem").write.mode("overwrite").partitionBy("stem").text(path)


def write_trees(trees: DataFrame, path: str) -> None:
    """Tables of contents (stem, toc) as JSON: a folder for each stem."""
    trees.repartition("stem").write.mode("overwrite").partitionBy("stem").json(path)


def delete_folders(doomed: DataFrame, root: str) -> DataFrame:
    """Deletes the folders ``root``/guidelines/guideline/version of deleted versions: guideline_id, version_id (null: all of the guideline), outcome.

    doomed: guideline_id, version_id; rows without a guideline are left out, equal ones are one. Ids are numbers, so no folder outside ``root`` is met. An
    outcome is ``deleted`` or ``absent``: a second run, or a task that is run again, finds nothing left and does not fail. Folders are dealt by guideline over the
    tasks, each guideline's in one, which then deletes its folder if it is empty. The work is done when this returns; the outcomes are a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)

        def kind(path: str) -> fs.FileType:
            return files.get_file_info(path).type

        for batch in batches:
            rows, outcomes = batch.to_pylist(), []
            for row in rows:
                guideline = f"{base}/guidelines/{row['guideline_id']}"
                path = guideline if row["version_id"] is None else f"{guideline}/{row['version_id']}"
                there = kind(path) == fs.FileType.Directory
                outcomes.append("deleted" if there else "absent")
                if there:
                    files.delete_dir(path)
                if path != guideline and kind(guideline) == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(guideline)):
                    files.delete_dir(guideline)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(outcomes, pa.string())], names=["guideline_id", "version_id", "outcome"])

    slim = doomed.select(F.col("guideline_id").cast("long"), F.col("version_id").cast("long")).where("guideline_id is not null").distinct()
    return cut_table(slim.repartition("guideline_id").mapInArrow(run, "guideline_id long, version_id long, outcome string"))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` (DDL), in its order; those that ``df`` lacks are null."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))
