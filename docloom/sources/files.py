"""Files as tables: uploads, markdown, chunk arrays, workbooks, byte ranges."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.outline import header_key

#: A chunk of a scanned document, as the OCR service writes it.
CHUNK_SCHEMA = "id string, type string, markdown string, bboxes array<struct<page:int,left:double,top:double,right:double,bottom:double>>"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_uploads(spark: SparkSession, root: str) -> DataFrame:
    """PDF files under ``root/guideline/version/``: guideline_id, version_id, path, length, content. Other files are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(root)
    ids = [F.regexp_extract("path", r"/(\d+)/(\d+)/[^/]*$", k).try_cast("long") for k in (1, 2)]
    return files.select(ids[0].alias("guideline_id"), ids[1].alias("version_id"), "path", "length", "content").where("version_id is not null")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row for each markdown file: stem and text."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(stem(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON array files: stem, id, type, markdown, bboxes."""
    files = spark.read.schema(CHUNK_SCHEMA).json(path, multiLine=True)
    return files.select(stem(F.col("_metadata.file_name")).alias("stem"), "id", "type", "markdown", "bboxes")


def not_done(inputs: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    """Inputs without output yet."""
    return inputs.join(done.select(key), key, "left_anti")


def is_uuid(column: Column) -> Column:
    return F.coalesce(column.rlike(_UUID), F.lit(False))


def assets_by_id(files: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """Files of ``wanted`` (asset_id) whose name is that id; ids that are no UUID and files outside ``root`` are not found."""
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").contains("/../")
    named = files.where(inside).withColumn("asset_id", F.lower(stem(F.col("path"))))
    return wanted.where(is_uuid(F.col("asset_id"))).withColumn("asset_id", F.lower("asset_id")).join(named, "asset_id")


def byte_range(header: Column, size: Column) -> Column:
    """``start`` and ``end`` (both included) of a range header over ``size`` bytes; null if the header is not one satisfiable range.

    No header, or a blank one, asks for all. White space around its parts and the case of its unit do not matter. An end
    beyond the last byte is cut to it; ``bytes=-n`` asks for the last n bytes, one at least.
    """
    spec = r"(?i)^\s*bytes=\s*(\d*)\s*-\s*(\d*)\s*$"
    first, last = (F.regexp_extract(header, spec, k) for k in (1, 2))
    a, b = first.try_cast("long"), last.try_cast("long")
    end = F.least(F.coalesce(b, size - 1), size - 1)
    start = F.when(first == "", F.greatest(size - b, F.lit(0).cast("long"))).otherwise(a)
    end = F.when(first == "", size - 1).otherwise(end)
    ordered = F.when(first == "", b > 0).otherwise((start < size) & F.coalesce(b >= a, last == ""))
    good = header.rlike(spec) & ((first != "") | (last != "")) & ordered
    whole = F.struct(F.lit(0).cast("long").alias("start"), (size - 1).alias("end"))
    return F.when(header.isNull() | header.rlike(r"^\s*$"), whole).when(good, F.struct(start.alias("start"), end.alias("end")))


def slice_bytes(content: Column, span: Column) -> Column:
    """The bytes of a span of ``byte_range``."""
    return F.substring(content, (span["start"] + 1).cast("int"), (span["end"] - span["start"] + 1).cast("int"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """Non-empty cells of a workbook's first sheet: row, column (from 1) and text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    for cell in ElementTree.fromstring(book.read(names[0])).iter(f"{_SHEET}c") if names else ():
        value, inline = cell.find(f"{_SHEET}v"), cell.find(f"{_SHEET}is")
        text = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t")) if inline is not None else value.text if value is not None else None
        if text is not None:
            text = shared[int(text)] if cell.get("t") == "s" else text
            row = int(re.sub("[A-Z]", "", cell.get("r")))
            yield row, _column(cell.get("r")), text.strip()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the first sheet of each XLSX file: path, row, column, value. Files are read in parallel, each by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in _cells(content)], columns=["path", "row", "column", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, row int, column int, value string")


#: Headers of names and of e-mails, as ``header_key`` spells them (fixed values).
NAME_HEADERS = ("ho va ten", "hoten", "ten", "full name", "name")
EMAIL_HEADERS = ("email", "mail", "e mail")


def account_rows(cells: DataFrame, names: tuple[str, ...] = NAME_HEADERS, emails: tuple[str, ...] = EMAIL_HEADERS) -> DataFrame:
    """Name and e-mail below the first row that holds a header of both kinds, with or without its blanks; the last of several counts: path, row, name, email."""
    key = header_key(F.col("value"))
    at = lambda keys: F.max(F.when(key.isin(*keys) | F.replace(key, F.lit(" "), F.lit("")).isin(*keys), F.col("column")))
    heads = cells.groupBy("path", "row").agg(at(names).alias("name_at"), at(emails).alias("email_at")).where("name_at is not null and email_at is not null")
    head = heads.groupBy("path").agg(F.min_by(F.struct(F.col("row").alias("head"), "name_at", "email_at"), "row").alias("h")).select("path", "h.*")
    below = cells.join(head, "path").where("row > head")
    pick = lambda at: F.max(F.when(F.col("column") == F.col(at), F.col("value")))
    return below.groupBy("path", "row").agg(pick("name_at").alias("name"), pick("email_at").alias("email")).where("coalesce(email, '') <> ''")
