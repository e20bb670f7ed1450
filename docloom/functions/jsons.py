"""JSON as language models write it: cut off, fenced, or with words around it."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def _scan(text: str) -> tuple[str, int, int]:
    """The brackets that are open at the end, whether in a string (the place of its quote, else -1), and the last comma outside strings."""
    open_, quote, comma, skip = [], -1, -1, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote >= 0:
            skip, quote = c == "\\", -1 if c == '"' else quote
        elif c == '"':
            quote = i
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif open_ and c == open_[-1]:
            open_.pop()
        elif c == ",":
            comma = i
    return "".join(reversed(open_)), quote, comma


def closed(text: str) -> str:
    """A text cut off inside JSON, ended: what is half written goes, back to the last comma or bracket, and open brackets close."""
    text = re.sub(r",\s*$", "", text.rstrip())
    _, quote, _ = _scan(text)
    if quote >= 0:
        begun = text[:quote]
        at = max(begun.rfind(","), begun.rfind("{") + 1, begun.rfind("[") + 1)
        text = re.sub(r",\s*$", "", begun[:at].rstrip()) if at > 0 else text + '"'
    return text + _scan(text)[0]


def repaired(text: str | None) -> str | None:
    """The JSON object in a text, null if none can be found: as it stands, closed, from its first to its last brace, or up to a last brace that ends it."""
    if text is None:
        return None
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip())).strip()
    inner = re.search(r"\{.*\}", text, re.DOTALL)
    tries = [text, closed(text)] + ([inner[0], closed(inner[0])] if inner else [])
    ends = [m.start() + 1 for m in re.finditer("}", text)][::-1][:200]
    for t in tries + [text[:e] for e in ends]:
        try:
            json.loads(t)
        except ValueError:
            continue
        return t
    return None


def repair(df: DataFrame, column: str, to: str) -> DataFrame:
    """``to``: the JSON of ``column``. Only texts that Spark cannot parse go to Python."""

    @F.pandas_udf("string")
    def fix(x: pd.Series) -> pd.Series:
        return x.map(repaired)

    good = F.try_parse_json(F.col(column)).isNotNull() & F.col(column).rlike(r"^\s*[\[{]")
    return df.withColumn(to, F.when(good, F.col(column)).otherwise(fix(F.when(~F.coalesce(good, F.lit(False)), F.col(column)))))


#: Children of a node by its depth, and a document's metadata (fixed values).
CHILDREN = ("sections", "subsections", "subsubsections", "subsubsubsections", "subsubsubsubsections")
METADATA = ("title", "publisher", "decision_number", "specialty", "date", "isbn_electronic", "isbn_print", "total_pages")


def toc_schema(depth: int = 6) -> StructType:
    """Metadata and chapters of a table of contents; nodes have title, heading_chunk_id and, but for the deepest, children."""
    node = StructType([StructField("title", StringType()), StructField("heading_chunk_id", StringType())])
    for name in reversed(CHILDREN[: depth - 1]):
        node = StructType([*node.fields[:2], StructField(name, ArrayType(node))])
    return StructType([*(StructField(m, StringType()) for m in METADATA), StructField("chapters", ArrayType(node))])


def _children(node: Column, depth: int, most: int) -> Column:
    """A node with title, chunk_id and, under the one name ``children``, its children."""
    fields = [F.trim(F.regexp_replace(F.coalesce(node["title"], F.lit("")), r"^#+\s*", "")).alias("title"), node["heading_chunk_id"].alias("chunk_id")]
    if depth < most:
        below = F.transform(F.coalesce(node[CHILDREN[depth - 1]], F.array().cast(_array_type(depth, most))), lambda x: _children(x, depth + 1, most))
        fields.append(below.alias("children"))
    return F.struct(*fields)


def _array_type(depth: int, most: int) -> ArrayType:
    at = toc_schema(most)["chapters"].dataType
    for name in CHILDREN[:depth]:
        at = at.elementType[name].dataType
    return at


def toc_of(text: Column, depth: int = 6) -> Column:
    """Metadata and ``children`` of a table of contents in JSON: missing keys are null, titles lose their marks, pages are a number or null."""
    parsed = F.from_json(text, toc_schema(depth))
    chapters = F.coalesce(parsed["chapters"], F.array().cast(toc_schema(depth)["chapters"].dataType))
    meta = [parsed[m].try_cast("int").alias(m) if m == "total_pages" else parsed[m].alias(m) for m in METADATA]
    return F.struct(*meta, F.transform(chapters, lambda n: _children(n, 1, depth)).alias("children"))
