"""Tables of contents: headings matched to chunks, gaps filled, trees merged.

A node is a row of version_id, idx (place in pre-order, from 0), path (titles joined by ``/``), level, title and chunk_id (or null). A chunk is a
row of version_id, chunk_id and position.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.outline import structural_key, title_key
from docloom.operators.trees import rising_anchors
from docloom.session import cut_table

#: Positions that a chapter may lie before a landmark, and levels from which nodes inherit (fixed values).
BUFFER, DEEP = 25, 4


def flatten(trees: DataFrame, depth: int = 6) -> DataFrame:
    """Nodes of nested tables of contents in pre-order: version_id, idx, path, level, title, chunk_id.

    trees: version_id and ``children``, an array of structs of title, chunk_id and, but for the deepest, children. One level is exploded
    at a time; the order is that of the arrays of places.
    """
    rows, found = trees.select("version_id", F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("path"), F.col("children")), []
    for level in range(1, depth + 1):
        rows = rows.select("version_id", "at", "path", F.posexplode("children").alias("k", "node"))
        path = F.concat_ws("/", "path", "node.title")
        rows = rows.select("version_id", F.concat("at", F.array("k")).alias("at"), path.alias("path"), "node")
        found.append(rows.select("version_id", "at", "path", F.lit(level).alias("level"), "node.title", "node.chunk_id"))
        if "children" not in rows.schema["node"].dataType.names:
            break
        rows = rows.select("version_id", "at", "path", F.col("node.children").alias("children"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    idx = F.row_number().over(Window.partitionBy("version_id").orderBy("at")) - 1
    return out.withColumn("idx", idx).select("version_id", "idx", "path", "level", "title", "chunk_id")


def landmarks(pairs: DataFrame) -> DataFrame:
    """The least position of each node among candidates (version_id, idx, position)."""
    return pairs.groupBy("version_id", "idx").agg(F.min("position").alias("position"))


def windows(ranges: DataFrame, marks: DataFrame, n_chunks: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Where the chunks of a run of nodes are to be looked for: ranges (version_id, first, last) with ``low`` and ``high``.

    From the middle of the last two landmarks, but no more than ``buffer`` before the last, to two behind the next; if that is empty, around
    the last. marks: version_id, idx, position; n_chunks: version_id, n. Ranges and landmarks of a version go in one order, upwards by a range's
    first place and downwards by its last, and carry the largest and the least position along: no range meets the landmarks one by one.
    """
    r = ranges.join(n_chunks, "version_id").select("version_id", F.struct(*ranges.columns, "n").alias("of"))
    r = r.join(marks.select("version_id", F.lit(True).alias("marked")).distinct(), "version_id", "left")
    m = marks.where("idx is not null").select("version_id", F.col("idx").alias("at"), F.lit(1).alias("turn"), "position")
    both = m.unionByName(r.withColumns({"at": F.col("of.first"), "turn": F.lit(0)}), allowMissingColumns=True)
    way = Window.partitionBy("version_id").orderBy("at", "turn")
    # in front of the landmarks of its own place a range sees the earlier ones, behind them all that count
    earlier = F.max("position").over(way.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max("position").over(Window.partitionBy("version_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    r = both.withColumns({"earlier": earlier, "before": before}).where("turn = 0").select("version_id", "of", "marked", "earlier", "before")
    both = m.unionByName(r.withColumns({"at": F.col("of.last"), "turn": F.lit(0)}), allowMissingColumns=True)
    back = Window.partitionBy("version_id").orderBy(F.desc_nulls_first("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    r = both.withColumn("behind", F.min("position").over(back)).where("turn = 0")
    r = r.select("of.*", "marked", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("behind", "of.n").alias("behind"), F.coalesce("earlier", F.lit(0)).alias("earlier"))
    middle = F.when(F.col("earlier") > 0, F.floor((F.col("earlier") + F.col("before")) / 2)).otherwise(0)
    r = r.withColumns({"low": F.greatest(middle, F.col("before") - buffer), "high": F.least(F.col("n"), F.col("behind") + 2)})
    empty = F.col("low") >= F.col("high")
    low = F.when(F.col("marked").isNull(), 0).when(empty, F.greatest(F.lit(0), F.col("before") - buffer)).otherwise(F.col("low"))
    high = F.when(F.col("marked").isNull(), F.col("n")).when(empty, F.least(F.col("n"), F.col("before") + 4 * buffer)).otherwise(F.col("high"))
    return r.select(*ranges.columns, low.cast("int").alias("low"), high.cast("int").alias("high"))


# The share of a window that is its edge (5 positions at least), how often as wide it becomes, and its most positions.
EDGE, WIDER, WIDEST = 0.15, 2, 600


def expand_at_edges(found: DataFrame, hits: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """Windows (version_id, first, low, high) to look in again, as what was found in them lies at an edge: with new ``low`` and ``high``.

    hits: version_id, first, position; n_chunks: version_id, n. A window grows by its own size on the side, or sides, of the edge; one that would be
    over ``WIDEST`` lies around the middle of its hits instead. Windows without hits, or with none at an edge, or that cannot grow, are left out. Only
    the least and largest hit of a window move.
    """
    ends = hits.groupBy("version_id", "first").agg(F.min("position").alias("least"), F.max("position").alias("largest"))
    w = found.join(ends, ["version_id", "first"]).join(n_chunks, "version_id")
    size = F.greatest(F.lit(1), F.col("high") - F.col("low"))
    edge = F.greatest(F.lit(5), F.floor(size * EDGE))
    w = w.withColumn("left", F.when(F.col("least") < F.col("low") + edge, F.greatest(F.lit(0), F.col("low") - size * (WIDER - 1))).otherwise(F.col("low")))
    w = w.withColumn("right", F.when(F.col("largest") > F.col("high") - 1 - edge, F.least(F.col("n"), F.col("high") + size * (WIDER - 1))).otherwise(F.col("high")))
    w = w.where((F.col("left") != F.col("low")) | (F.col("right") != F.col("high")))
    middle = F.greatest(F.lit(0), F.floor((F.col("least") + F.col("largest")) / 2) - WIDEST // 2)
    end = F.least(F.col("n"), middle + WIDEST)
    wide = F.col("right") - F.col("left") > WIDEST
    low, high = F.when(wide, F.greatest(F.lit(0), end - WIDEST)).otherwise(F.col("left")), F.when(wide, end).otherwise(F.col("right"))
    return w.select(*(c for c in found.columns if c not in ("low", "high")), low.cast("int").alias("low"), high.cast("int").alias("high"))


def inherit_deep(nodes: DataFrame, from_level: int = DEEP + 1) -> DataFrame:
    """Nodes of level ``from_level`` and deeper without a chunk take that of the nearest node above that has one, if all between are as deep.

    A node sees the nodes of its own path, so one pass over the ways up does what level after level would.
    """
    steps = nodes.where(F.col("chunk_id").isNull() & (F.col("level") >= from_level)).select("version_id", "idx", "path", "level")
    up = steps.withColumn("k", F.explode(F.sequence(F.lit(from_level - 1), F.col("level") - 1)))
    up = up.withColumn("above", F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/"))
    have = nodes.where("chunk_id is not null").groupBy("version_id", F.col("path").alias("above")).agg(F.max_by("chunk_id", "idx").alias("from_above"))
    got = up.join(have, ["version_id", "above"]).groupBy("version_id", "idx").agg(F.max_by("from_above", "k").alias("inherited"))
    return nodes.join(got, ["version_id", "idx"], "left").withColumn("chunk_id", F.coalesce("chunk_id", "inherited")).select(*nodes.columns)


def from_predecessor(nodes: DataFrame) -> DataFrame:
    """Nodes without a chunk take that of the nearest node before them."""
    before = Window.partitionBy("version_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("chunk_id", F.last("chunk_id", ignorenulls=True).over(before))


def first_below(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(version_id, idx, chunk_id) of the first chunk, by position, among the nodes below each node that has none."""
    placed = nodes.where("chunk_id is not null").join(chunks, ["version_id", "chunk_id"])
    steps = F.split("path", "/")
    up = placed.where("level > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("level") - 1)))
    up = up.select("version_id", F.array_join(F.slice(steps, 1, F.col("k")), "/").alias("path"), "position", "chunk_id")
    best = up.groupBy("version_id", "path").agg(F.min(F.struct("position", "chunk_id")).alias("best"))
    return nodes.where("chunk_id is null").join(best, ["version_id", "path"]).select("version_id", "idx", F.col("best.chunk_id").alias("chunk_id"))


def from_below(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes without a chunk take the first chunk of the nodes below them."""
    got = first_below(nodes, chunks).withColumnRenamed("chunk_id", "below")
    return nodes.join(got, ["version_id", "idx"], "left").withColumn("chunk_id", F.coalesce("chunk_id", "below")).select(*nodes.columns)


def from_parent(nodes: DataFrame, chunks: DataFrame, reach: int = 15, distance: int = 4 * BUFFER) -> DataFrame:
    """Nodes without a chunk take their parent's, unless the nearest placed node of the ``reach`` - 1 before them lies over ``distance`` from it."""
    n = nodes.join(chunks, ["version_id", "chunk_id"], "left")
    order = Window.partitionBy("version_id").orderBy("idx")
    near = F.last("position", ignorenulls=True).over(order.rowsBetween(-(reach - 1), -1))
    parent = F.when(F.col("level") > 1, F.array_join(F.slice(F.split("path", "/"), 1, F.col("level") - 1), "/"))
    n = n.withColumns({"near": near, "parent": parent})
    above = n.where("position is not null").groupBy("version_id", F.col("path").alias("parent")).agg(F.min_by(F.struct("chunk_id", "position"), "idx").alias("above"))
    n = n.join(above, ["version_id", "parent"], "left")
    fits = F.col("near").isNull() | (F.abs(F.col("above.position") - F.col("near")) <= distance)
    return n.withColumn("chunk_id", F.coalesce("chunk_id", F.when(fits, F.col("above.chunk_id")))).select(*nodes.columns)


def fill_gaps(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rules for nodes without a chunk, in their order: deep ones inherit, then predecessor, first below, parent."""
    return from_parent(from_below(from_predecessor(inherit_deep(nodes)), chunks), chunks)


def settle(nodes: DataFrame, chunks: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Nodes with their last chunks: those that break the document's order lose theirs, then the gaps are filled.

    landmarks (version_id, idx) are sure: they neither lose their chunk nor judge others. Of the other nodes that have a known chunk, those outside a
    longest run of positions that do not fall lose it. A node whose chunk is not among ``chunks`` keeps it. Only places of nodes are gathered, a group for
    each table of contents.
    """
    sure = landmarks.select("version_id", "idx").distinct()
    placed = nodes.where("chunk_id is not null").join(chunks, ["version_id", "chunk_id"]).join(sure, ["version_id", "idx"], "left_anti").select("version_id", "idx", "position")
    wrong = placed.join(rising_anchors(placed), ["version_id", "idx"], "left_anti").select("version_id", "idx", F.lit(True).alias("wrong"))
    kept = nodes.join(wrong, ["version_id", "idx"], "left").withColumn("chunk_id", F.when(F.col("wrong").isNull(), F.col("chunk_id"))).select(*nodes.columns)
    # a table, as the rules for gaps read the nodes many times
    return fill_gaps(cut_table(kept), chunks)


def clear_contradictions(nodes: DataFrame, kept: DataFrame, landmark: Column) -> DataFrame:
    """Nodes whose chunk is not among those ``kept`` (version_id, idx) by a longest rising run lose it, but landmarks do not."""
    mark = kept.select("version_id", "idx", F.lit(True).alias("kept"))
    keep = F.coalesce("kept", F.lit(False)) | landmark
    return nodes.join(mark, ["version_id", "idx"], "left").withColumn("chunk_id", F.when(keep, F.col("chunk_id"))).select(*nodes.columns)


def _tree(rows: list[dict]) -> list[dict]:
    """Rows in pre-order as roots with ``below``."""
    roots, open_ = [], []
    for r in rows:
        node = {**r, "below": []}
        open_ = [x for x in open_ if x["level"] < r["level"]]
        (open_[-1]["below"] if open_ else roots).append(node)
        open_.append(node)
    return roots


def _names(nodes: Iterable[dict]) -> set[str]:
    return {n["name"] for n in nodes} | {x for n in nodes for x in _names(n["below"])}


def _without(nodes: list[dict], name: str) -> list[dict]:
    return [{**n, "below": _without(n["below"], name)} for n in nodes if n["name"] != name]


def _merge(base: list[dict], updated: list[dict], lock: int, depth: int = 1, above: frozenset = frozenset()) -> list[dict]:
    """Siblings of both trees at one depth: those of the base in their order, then new ones."""
    if not updated:
        return base
    new, known = {n["name"]: n for n in updated}, {n["name"] for n in base}
    for name in (n["name"] for n in updated if depth > lock and n["name"] not in known):
        # what stands deeper in the base moves up to where the update has it
        k = next((k for k, n in enumerate(base) if name in _names(n["below"])), None)
        if k is not None:
            base = [*base[:k], {**base[k], "below": _without(base[k]["below"], name)}, *base[k + 1 :]]
    keys = frozenset(n["key"] for n in base if n["key"])
    out = []
    for n in base:
        theirs = new[n["name"]]["below"] if n["name"] in new else []
        # a node without children takes all that are offered, whatever is locked, but none that is numbered like its siblings
        out.append({**n, "below": _merge(n["below"], theirs, lock, depth + 1, keys) if n["below"] else [c for c in theirs if c["key"] not in keys]})
    return out + [n for n in updated if depth > lock and n["name"] not in known and not (n["key"] and n["key"] in above)]


def merge(base: DataFrame, updated: DataFrame, lock_level: int = 1) -> DataFrame:
    """Two tables of contents of each version as one: nodes of ``base`` stay in their order, and nodes of ``updated`` that it lacks follow behind their siblings.

    Siblings are the same if their titles are, headings' marks aside; the tree is that of idx and level, so titles may hold anything. A node that the update has
    higher up moves there. Levels up to ``lock_level`` get no new nodes, but a node without children takes those of the update, and a node with the
    structural key (chapter 3) of a node of its parent's level is no child of that. One group is one document's table of contents.
    """
    columns = ["version_id", "idx", "path", "level", "title", "chunk_id"]
    keyed = lambda df, side: df.select(*columns, title_key(F.col("title")).alias("name"), F.concat_ws(" ", structural_key(F.col("title"))).alias("key"), F.lit(side).alias("side"))
    both = keyed(base, 0).union(keyed(updated, 1))

    def rows(nodes: list[dict], path: str = "", level: int = 1) -> Iterable[dict]:
        for n in nodes:
            own = f"{path}/{n['name']}" if path else n["name"]
            yield {**n, "path": own, "level": level}
            yield from rows(n["below"], own, level + 1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "idx"]).astype(object).where(lambda f: f.notna(), None)
        sides = [_tree([{**r, "key": r["key"] or None} for r in frame[frame["side"] == k].to_dict("records")]) for k in (0, 1)]
        return pd.DataFrame([{**r, "idx": i} for i, r in enumerate(rows(_merge(*sides, lock_level)))], columns=columns)

    kinds = dict(base.dtypes)
    return both.groupBy("version_id").applyInPandas(run, f"version_id {kinds['version_id']}, idx int, path string, level int, title string, chunk_id string")


def contiguous_toc(pages: DataFrame, is_toc: Column, goes_on: Column, scan: int = 20, most: int = 14) -> DataFrame:
    """(version_id, first, last): the first page of contents among the first ``scan`` pages, and the last of at most ``most`` that follow without a gap.

    pages: version_id, page (from 0).
    """
    first = pages.where(is_toc & (F.col("page") < scan)).groupBy("version_id").agg(F.min("page").alias("first"))
    after = pages.withColumn("goes_on", goes_on).join(first, "version_id").where((F.col("page") > F.col("first")) & (F.col("page") <= F.col("first") + most))
    stop = after.where(~F.coalesce("goes_on", F.lit(False))).groupBy("version_id").agg(F.min("page").alias("stop"))
    end = after.groupBy("version_id").agg(F.max("page").alias("seen"))
    j = first.join(stop, "version_id", "left").join(end, "version_id", "left")
    return j.select("version_id", "first", F.coalesce(F.col("stop") - 1, "seen", "first").alias("last"))


def last_toc_page(chunks: DataFrame, cutoffs: DataFrame, going_on: DataFrame) -> DataFrame:
    """(version_id, page): the last page with a chunk before the contents' end, and further while the next page still goes on with them.

    chunks: version_id, position (-1 without a place), page; cutoffs: version_id, cutoff, fallback; going_on: version_id, page, of such pages.
    """
    before = chunks.join(cutoffs, "version_id").where((F.col("position") >= 0) & (F.col("position") < F.col("cutoff")))
    last = before.groupBy("version_id").agg(F.max("page").alias("last"))
    # pages that go on without a gap share their distance from their rank
    run = going_on.select("version_id", "page").distinct().join(last, "version_id").where("page > last")
    rank = F.row_number().over(Window.partitionBy("version_id").orderBy("page"))
    run = run.withColumn("gap", F.col("page") - F.col("last") - rank).where("gap = 0").groupBy("version_id").agg(F.max("page").alias("further"))
    return cutoffs.join(last, "version_id", "left").join(run, "version_id", "left").select("version_id", F.coalesce("further", "last", "fallback").alias("page"))


def outline_summary(entries: DataFrame) -> DataFrame:
    """Entries of an outline (version_id, level, page or null), those that lead to a page, and the depth."""
    return entries.groupBy("version_id").agg(F.count("*").alias("entries"), F.count_if(F.coalesce(F.col("page") > 0, F.lit(False))).alias("actionable"), F.max("level").alias("depth"))


#: Programs whose documents have bookmarks but no structure, a title's mark of Vietnamese, and the least of a rich outline: entries, and entries a page (fixed values).
POOR_AUTHORS, VIETNAMESE_TITLE = ("coreldraw",), "việt"
RICH_ENTRIES, RICH_DENSITY = 8, 0.12
#: A weak outline's most levels, most entries, and pages to an entry (fixed values).
WEAK_DEPTH, WEAK_ENTRIES, WEAK_PAGES = 1, 6, 8


def _native() -> Column:
    """Whether the bookmarks are an outline that leads somewhere."""
    return F.col("outline_root") & (F.col("entries") >= 1) & (F.col("actionable") >= 0.7 * F.col("entries"))


def with_structure(metrics: DataFrame) -> DataFrame:
    """Adds ``rich`` and ``weak``, and the title's test to ``vietnamese``; for ``route``.

    metrics: page_count, outline_root, entries, actionable, depth, visible (contents are seen), struct_tree, vietnamese (by the text), title, creator,
    producer, format. Rich is an outline of 8 entries with two levels or 0.12 entries a page. Weak is a native outline of a program known for
    poor ones without visible contents; or one level of few entries where nothing else (visible contents, a tree of tags, a rich outline) speaks for it.
    Null names are empty, null depths 0, null tests false.
    """
    sure = lambda name: F.coalesce(F.col(name), F.lit(False))
    depth = F.coalesce("depth", F.lit(0))
    made_by = F.lower(F.concat_ws(" ", "creator", "producer", "format"))
    poor = F.exists(F.array(*map(F.lit, POOR_AUTHORS)), lambda w: made_by.contains(w))
    rich = (F.col("entries") >= RICH_ENTRIES) & ((depth >= 2) | (F.col("entries") >= RICH_DENSITY * F.greatest("page_count", F.lit(1))))
    few = F.col("entries") <= F.least(F.lit(WEAK_ENTRIES), F.greatest(F.lit(3), F.floor(F.col("page_count") / WEAK_PAGES)))
    weak = _native() & F.when(poor & ~sure("visible"), True).otherwise(~(sure("visible") | sure("struct_tree") | rich) & (depth <= WEAK_DEPTH) & few)
    titled = F.lower(F.coalesce("title", F.lit(""))).contains(VIETNAMESE_TITLE)
    return metrics.withColumns({"rich": rich, "weak": weak, "vietnamese": sure("vietnamese") | titled})


def route(metrics: DataFrame) -> DataFrame:
    """``mode`` and ``reason`` of each document by the first rule that holds, from its metrics.

    metrics: page_count, vietnamese, outline_root, entries, actionable, words (of the sampled pages), weak (see ``with_structure``).
    """
    native = _native()
    reason = (
        F.when(F.col("page_count") == 0, "empty_pdf")
        .when(F.col("vietnamese"), "detected_vietnamese_forced_ocr")
        .when(~native, "missing_native_outline_tree")
        .when(F.col("words") < 30, "native_outline_but_text_layer_unextractable")
        .when(F.col("weak"), "extractable_text_but_weak_document_structure")
        .otherwise("native_outline_tree_and_extractable_text")
    )
    out = metrics.withColumn("reason", reason)
    return out.withColumn("mode", F.when(F.col("reason") == "native_outline_tree_and_extractable_text", "spatial_pdf").otherwise("ocr_llm"))
