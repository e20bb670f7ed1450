"""Section trees: packing into chunks, bounds, levels, titles, headings above blocks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closure(nodes: DataFrame) -> DataFrame:
    """Every node with itself and each node above it: version_id, node, above, distance. Nodes carry ``path``, the array of sibling numbers.

    Paths hold the whole way up, so no join is needed.
    """
    steps = F.explode(F.sequence(F.lit(1), F.size("path")))
    out = nodes.select("version_id", F.col("path").alias("node"), steps.alias("n"))
    return out.select("version_id", "node", F.slice("node", 1, F.col("n")).alias("above"), (F.size("node") - F.col("n")).alias("distance"))


def bounds_from_children(nodes: DataFrame) -> DataFrame:
    """``first`` and ``last`` of each node: its own, or else the least and largest of all below it. nodes: version_id, path, first, last."""
    below = closure(nodes).join(nodes.withColumnRenamed("path", "node"), ["version_id", "node"])
    found = below.groupBy("version_id", F.col("above").alias("path")).agg(F.min("first").alias("low"), F.max("last").alias("high"))
    out = nodes.join(found, ["version_id", "path"], "left")
    return out.select("version_id", "path", F.coalesce("first", "low").alias("first"), F.coalesce("last", "high").alias("last"))


def tree_stats(nodes: DataFrame) -> DataFrame:
    """Nodes, depth and nodes of the second level for each version."""
    level = F.size("path")
    return nodes.groupBy("version_id").agg(F.count("*").alias("n_nodes"), F.max(level).alias("depth"), F.sum((level == 2).cast("int")).alias("n_second"))


def tree_quality(nodes: DataFrame, grounded: Column, textual: Column, pages: Column, least_pages: int = 5, least_grounded: float = 0.4, least_textual: float = 0.25) -> DataFrame:
    """How many nodes have a place and a text; a tree of a document of some pages is usable if enough do."""
    out = nodes.groupBy("version_id").agg(F.count("*").alias("total"), F.sum(grounded.cast("int")).alias("grounded"), F.sum(textual.cast("int")).alias("textual"), F.max(pages).alias("pages"))
    good = (F.col("grounded") >= least_grounded * F.col("total")) & (F.col("textual") >= least_textual * F.col("total"))
    return out.withColumn("usable", F.when(F.col("pages") >= least_pages, good).otherwise(F.col("grounded") > 0))


def shallowest_titles(nodes: DataFrame, title: Column) -> DataFrame:
    """Nodes without those whose title, or the title of a node above, stands at a higher level of the same version."""
    n = nodes.withColumn("key", title).withColumn("level", F.size("path"))
    top = n.groupBy("version_id", "key").agg(F.min("level").alias("top"))
    doomed = n.join(top, ["version_id", "key"]).where("level > top").select("version_id", F.col("path").alias("above"))
    gone = closure(nodes).join(doomed, ["version_id", "above"], "left_semi").select("version_id", F.col("node").alias("path")).distinct()
    return nodes.join(gone, ["version_id", "path"], "left_anti")


def _nearest_smaller(levels: list[int]) -> list[int]:
    """For each level the place of the nearest earlier smaller one, -1 without one: a stack of rising levels."""
    out, stack = [], []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def levels_to_parents(rows: DataFrame) -> DataFrame:
    """``parent_pos``: of the nearest earlier row of a smaller level. rows: version_id, pos, level (any integers).

    One group is one document's outline; only positions and levels go to Python.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        at = _nearest_smaller(table.column("level").to_pylist())
        parents = table.column("pos").take(pa.array([i if i >= 0 else None for i in at], pa.int64()))
        return pa.table({"version_id": table.column("version_id"), "pos": table.column("pos"), "parent_pos": parents})

    kinds = dict(rows.dtypes)
    slim = rows.select("version_id", "pos", F.col("level").cast("long").alias("level"))
    found = slim.groupBy("version_id").applyInArrow(run, f"version_id {kinds['version_id']}, pos {kinds['pos']}, parent_pos {kinds['pos']}")
    return rows.drop("parent_pos").join(found, ["version_id", "pos"], "left")


def headings_above(headings: DataFrame, blocks: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Each block with the latest heading at or above it on its page or before: one window over both, no join.

    headings: version_id, page, y, heading_id; blocks: version_id, page, y, block_id. A block may begin ``tolerance`` above its heading.
    """
    h = headings.select("version_id", "page", "y", "heading_id", F.lit(None).cast(blocks.schema["block_id"].dataType).alias("block_id"))
    b = blocks.select("version_id", "page", (F.col("y") + tolerance).alias("y"), F.lit(None).cast(headings.schema["heading_id"].dataType).alias("heading_id"), "block_id")
    order = Window.partitionBy("version_id").orderBy("page", "y", F.col("heading_id").asc_nulls_last())
    both = h.union(b).withColumn("heading_id", F.last("heading_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("block_id is not null").select("version_id", "block_id", "heading_id")


def pack_chunks(nodes: DataFrame, longest: int = 3000) -> DataFrame:
    """Chunks of a section tree: the highest subtrees whose text has ``longest`` characters at most, and leaves that are longer.

    nodes: version_id, path, heading, content. A chunk is preceded by the own blocks of the nodes above it, which do
    not count. Nodes without text give no chunk. Result: version_id, path, context, text.
    """
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    joined = lambda parts: F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
    own = nodes.select("version_id", "path", joined(F.array(trim(F.col("heading")), trim(F.col("content")))).alias("own"))
    up = closure(own)
    sizes = up.join(own.select("version_id", F.col("path").alias("node"), F.length("own").alias("n_own")), ["version_id", "node"])
    # lengths first: texts move only to the subtrees that are chunks
    n = F.sum(F.when(F.col("n_own") > 0, F.col("n_own") + 2).otherwise(0)) - 2
    size = sizes.groupBy("version_id", F.col("above").alias("path")).agg(n.alias("size"), F.count("*").alias("nodes"))
    fit = size.where((F.col("size") > 0) & ((F.col("size") <= longest) | (F.col("nodes") == 1)))
    below = up.where("distance > 0").join(fit.select("version_id", F.col("path").alias("above")), ["version_id", "above"], "left_semi")
    top = fit.select("version_id", "path").join(below.select("version_id", F.col("node").alias("path")).distinct(), ["version_id", "path"], "left_anti")
    texts = up.join(top.withColumnRenamed("path", "above"), ["version_id", "above"]).join(own.withColumnRenamed("path", "node"), ["version_id", "node"])
    text = texts.groupBy("version_id", F.col("above").alias("path")).agg(F.sort_array(F.collect_list(F.struct("node", "own"))).alias("parts"))
    text = text.select("version_id", "path", joined(F.transform("parts", lambda x: x["own"])).alias("text"))
    over = up.where("distance > 0").join(top.withColumnRenamed("path", "node"), ["version_id", "node"], "left_semi")
    over = over.join(own.withColumnRenamed("path", "above"), ["version_id", "above"])
    context = over.groupBy("version_id", F.col("node").alias("path")).agg(F.sort_array(F.collect_list(F.struct(-F.col("distance"), "own"))).alias("parts"))
    context = context.select("version_id", "path", joined(F.transform("parts", lambda x: x["own"])).alias("context"))
    return text.join(context, ["version_id", "path"], "left").select("version_id", "path", F.coalesce("context", F.lit("")).alias("context"), "text")


def _rising(values: np.ndarray, strict: bool) -> list[int]:
    """Places of a longest rising subsequence, by patience sorting."""
    tails, at, before = [], [], []
    for i, x in enumerate(values.tolist()):
        k = (bisect_left if strict else bisect_right)(tails, x)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def rising_anchors(anchors: DataFrame, strict: bool = False) -> DataFrame:
    """Of each version's anchors (version_id, idx, position), in order of idx, a longest rising run of positions; the others contradict it.

    One group is one document's table of contents.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["idx", "position"], ignore_index=True)
        return frame.iloc[_rising(frame["position"].to_numpy(), strict)]

    a = anchors.select("version_id", "idx", "position")
    return a.groupBy("version_id").applyInPandas(run, a.schema)


def dotted_paths(rows: DataFrame) -> DataFrame:
    """``dotted``: the sibling numbers from the root down, 1.2.3. rows: version_id, path (array of positions), pos.

    A node's number among its siblings is one window; the numbers on its way down come by joins on the ways up, without a step for each level.
    """
    parent = F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1)).otherwise(F.array().cast("array<int>"))
    number = F.row_number().over(Window.partitionBy("version_id", parent).orderBy("pos"))
    numbers = rows.select("version_id", F.col("path").alias("above"), number.alias("number"))
    ways = closure(rows).join(numbers, ["version_id", "above"])
    dotted = ways.groupBy("version_id", F.col("node").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("distance"), F.col("number")))), lambda x: x["number"].cast("string")), ".").alias("dotted"))
    return rows.join(dotted, ["version_id", "path"])


def tree_order(rows: DataFrame) -> DataFrame:
    """``order``: places in pre-order, from 0. rows: version_id, dotted (or null, which comes last), order_index, section_id."""
    key = F.transform(F.split(F.coalesce("dotted", F.lit("")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(1_000_000_000)))
    w = Window.partitionBy("version_id").orderBy(key, F.col("order_index").asc_nulls_last(), "section_id")
    return rows.withColumn("order", F.row_number().over(w) - 1)


def empty_leaves(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Sections (version_id, section_id, parent_id, content) with neither children, nor text, nor an asset (version_id, section_id, image_url) with an address."""
    parents = rows.select("version_id", F.col("parent_id").alias("section_id")).where("section_id is not null").distinct()
    shown = assets.where("trim(coalesce(image_url, '')) <> ''").select("version_id", "section_id").distinct()
    bare = rows.where(~F.coalesce("content", F.lit("")).rlike(r"\S"))
    return bare.join(parents, ["version_id", "section_id"], "left_anti").join(shown, ["version_id", "section_id"], "left_anti")


def nested(nodes: DataFrame, depth: int = 6) -> DataFrame:
    """(version_id, children): trees as nested arrays of structs of title and children, in the order of idx, up to ``depth`` levels deep.

    nodes: version_id, idx, path (array of positions), title. The deepest level is built first; one grouping for each level. A node deeper than
    ``depth`` is an error when the result is read, as a schema has a fixed depth.
    """
    shallow = F.when(F.size("path") > depth, F.raise_error(F.lit(f"a node lies deeper than {depth} levels"))).otherwise(F.col("path"))
    nodes = nodes.withColumn("path", shallow)
    up = F.slice("path", 1, F.size("path") - 1)
    below = None
    for level in range(depth, 0, -1):
        own = nodes.where(F.size("path") == level).select("version_id", "idx", "path", "title")
        if below is None:
            own = own.withColumn("node", F.struct("idx", "title"))
        else:
            kind = below.schema["children"].dataType
            own = own.join(below, ["version_id", "path"], "left").withColumn("node", F.struct("idx", "title", F.coalesce("children", F.array().cast(kind)).alias("children")))
        below = own.groupBy("version_id", (up if level > 1 else F.array().cast("array<int>")).alias("path")).agg(F.sort_array(F.collect_list("node")).alias("children"))
    return below.select("version_id", "children")


def first_mode(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of several the one that comes first in order."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def last_of_key(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes (title_key, page) with the content of the last chunk (title_key, page, pos, content) of the same title and page; empty without one."""
    last = chunks.groupBy("title_key", "page").agg(F.max_by("content", "pos").alias("content"))
    return nodes.join(last, ["title_key", "page"], "left").withColumn("content", F.coalesce("content", F.lit("")))
