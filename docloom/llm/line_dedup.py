"""Line dedup: exact repeats, and lines within a few edits found by a segment-partition join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm._classes import across, classes, connected
from docloom.llm._counts import CorpusCounts, _texts
from docloom.llm._text import IS_WORD, family_hashes, mix, small_batches, span_hashes, steps, text_bytes, whole_row, with_rest
from docloom.session import clean_shuffles, cut, cut_table

#: A line may be changed by one edit for every so many of its characters, up to the edits asked for.
CHARS_PER_EDIT = 12
#: Lines that a task remembers to have sent, so that a line that is everywhere moves about once a task.
REMEMBERED = 1_000_000
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]")


def line_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts and their lines between line feeds: start, end, text, number in the text (from 0)."""
    data, offsets = text_bytes(texts)
    ends_at = np.flatnonzero(data == 10)
    doc_of_end = np.searchsorted(offsets, ends_at, side="right") - 1
    start = np.concatenate([offsets[:-1], ends_at + 1])
    doc = np.concatenate([np.arange(len(texts)), doc_of_end])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.ones(len(doc), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[last] = offsets[1:][doc[last]]
    number = np.arange(len(doc)) - np.repeat(np.flatnonzero(np.r_[True, last[:-1]]), np.diff(np.r_[np.flatnonzero(np.r_[True, last[:-1]]), len(doc)])) if len(doc) else doc
    return data, start, end, doc, number


def _with_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines hold a word; only they can repeat."""
    seen = np.append(0, np.cumsum(IS_WORD[data]))
    return seen[end] > seen[start]


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` (from 0) of ``edits`` + 1 even segments; the last ones are longer by one."""
    parts = edits + 1
    short = length // parts
    longer = length - short * parts
    first_long = parts - longer
    return i * short + np.maximum(0, i - first_long), short + (i >= first_long)


def allowed(length, edits: int):
    """Edits by which a line of ``length`` characters, and one that is no shorter, may differ."""
    return np.minimum(length // CHARS_PER_EDIT, edits)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of a string column (its UTF-8 bytes as one integer), and the characters before each text."""
    raw, offsets = text_bytes(texts)
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return raw, offsets
    first = raw.view(np.int8) >= -64  # all but the bytes 80 to BF, which go on with a character
    before = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(first, out=before[1:])
    out = raw[first].astype(np.uint32)
    wide, value, more = np.append(raw, [0, 0, 0]), raw[lead].astype(np.uint32), np.ones(len(lead), dtype=bool)
    for k in range(1, 4):
        more &= (wide[lead + k] & 0xC0) == 0x80
        value = np.where(more, (value << np.uint32(8)) | wide[lead + k], value)
    out[before[lead]] = value
    return out, before[offsets]


def segment_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which lines may meet: key, line, and whether it is a segment of the line itself.

    A line of n characters that may be changed by t edits has its own t + 1 segments, and for each shorter length with as
    many edits, the substrings where, in a line of that length within t edits, some segment must stand. Two lines within
    their edits share a key that is a segment of the shorter one. A key is a hash of the substring, the shorter length and
    the segment's number.
    """
    n = end - start
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for t in range(1, edits + 1):
        lines = np.flatnonzero((allowed(n, edits) >= t) & (allowed(n - t, edits) <= t))
        if len(lines):
            key, line, own = _keys_of(data, start[lines], n[lines], t, edits)
            found.append((key, lines[line], own))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keys_of(data: np.ndarray, start: np.ndarray, n: np.ndarray, t: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of ``segment_keys`` by shorter lengths that allow ``t`` edits."""
    spans, tags, family, used, own = [], [], [], [], []
    for delta in range(t + 1):
        shorter = n - delta
        ok = allowed(shorter, edits) == t
        for i in range(t + 1):
            at, size = segment(shorter, i, t)
            tag = mix(shorter.astype(np.uint64) * np.uint64(edits + 1) + np.uint64(i))
            # multi-match-aware: left and right of the segment there is room for the edits that are left
            low = np.maximum(np.maximum(at - i, at + delta - (t - i)), 0)
            high = np.minimum(np.minimum(at + i, at + delta + (t - i)), n - size)
            for shift in range(2 * t + 1):
                use = ok & (low + shift <= high)
                if not use.any():
                    continue
                begin = np.where(use, start + low + shift, start)
                spans.append((begin, np.where(use, begin + size, start)))
                tags.append(tag)
                family.append((delta, i))
                used.append(use)
                own.append(use & (delta == 0) & (low + shift == at))
    if not spans:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    key = family_hashes(data, start, np.stack([s for s, _ in spans]), np.stack([e for _, e in spans]))
    # a line has a key once: only substrings for one segment of one length can be equal
    for k, (mine, tag) in enumerate(zip(family, tags, strict=True)):
        key[k] = np.maximum(mix(key[k] ^ tag), np.uint64(1))
        for j in range(k - 1, -1, -1):
            if family[j] != mine:
                break
            again = used[j] & used[k] & (key[j] == key[k])
            own[j] |= own[k] & again
            used[k] &= ~again
    used, line = np.stack(used), np.broadcast_to(np.arange(len(n)), key.shape)
    return key[used], line[used], np.stack(own)[used]


def within(x: str, y: str, edits: int) -> bool:
    """Whether the edit distance of two strings (or byte strings) is ``edits`` or less, by bit-parallel columns of a band of 2 * edits + 1."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > edits:
        return False
    a = 0
    while a < len(x) and x[a] == y[a]:
        a += 1
    b = 0
    while b < len(x) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    m, n = len(x), len(y)
    if m == 0:
        return n <= edits
    # Bit k of column j stands for row j + k - edits of the distance matrix; near[e] has the cells of at most e edits.
    width = 2 * edits + 1
    full = (1 << width) - 1
    rows: dict = {}
    for i, c in enumerate(x):
        rows[c] = rows.get(c, 0) | 1 << i
    near = [((1 << (e + 1)) - 1) << edits & full for e in range(edits + 1)]
    for j in range(1, n + 1):
        at = j - 1 - edits
        eq = rows.get(y[j - 1], 0)
        eq = (eq >> at if at >= 0 else eq << -at) & full
        valid = full & (full << max(0, edits - j))
        if m - j + edits + 1 < width:
            valid &= (1 << max(0, m - j + edits + 1)) - 1
        before, lower = near, 0
        near = []
        for e in range(edits + 1):
            cells = before[e] & eq
            if e:
                cells |= before[e - 1] | before[e - 1] >> 1 | lower << 1
            lower = cells & valid
            near.append(lower)
        if not lower:
            return False
    return bool(near[edits] >> (m - n + edits) & 1)


def _verify(lines: DataFrame, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x, y, int(allowed(min(len(x), len(y)), edits))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = lines.select(F.col("line").alias("a"), F.col("text").alias("x")), lines.select(F.col("line").alias("b"), F.col("text").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    return verify


_KINDS = 64


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many characters of each of ``_KINDS`` kinds a line has."""
    for batch in batches:
        counts = [np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % _KINDS, minlength=_KINDS).astype("<i4").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.binary())], names=["id", "counts"])


def _few_edits(edits: int):
    """For ``across``: pairs whose histograms differ by twice their edits or less, as an edit changes two counts by one at most."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4").reshape(-1, _KINDS)
        ids, labels, size = table.column("id").to_numpy(), table.column("label").to_numpy(), counts.sum(axis=1)
        most, few = allowed(size, edits), np.minimum(counts, 255).astype(np.int16)  # a smaller count differs by no more
        a, b = [], []
        for i in np.flatnonzero(table.column("asks").to_numpy()):
            near = np.flatnonzero((np.abs(size - size[i]) <= most[i]) & (labels != labels[i]))
            near = near[np.abs(few[near] - few[i]).sum(axis=1) <= 2 * np.minimum(most[near], most[i])]
            a += [int(ids[i])] * len(near)
            b += ids[near].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _local_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct lines with words of a task's documents, with where each stands first.

    A line comes again only if it stands at an earlier place than when it was sent, or if ``REMEMBERED`` others came between.
    """
    seen, place = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    for batch in batches:
        for step in steps(batch, "text"):
            data, start, end, doc, number = line_spans(step.column(1))
            has = _with_words(data, start, end)
            start, end, doc, number = start[has], end[has], doc[has], number[has]
            h = span_hashes(data, start, end)
            ids = step.column(0).to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((number, ids, h))
            first = order[np.r_[True, h[order][1:] != h[order][:-1]]] if len(order) else order
            here = np.stack([ids[first], number[first]], axis=1).astype(np.int64)
            at = np.minimum(np.searchsorted(seen, h[first]), max(len(seen) - 1, 0))
            known = seen[at] == h[first] if len(seen) else np.zeros(len(first), bool)
            later = known.copy()
            later[known] = (place[at[known], 0] < here[known, 0]) | ((place[at[known], 0] == here[known, 0]) & (place[at[known], 1] <= here[known, 1]))
            place[at[known & ~later]] = here[known & ~later]
            if len(seen) > REMEMBERED:
                seen, place = h[first[~known]], here[~known]
            else:
                seen, place = np.concatenate([seen, h[first[~known]]]), np.concatenate([place, here[~known]])
                both = np.argsort(seen)
                seen, place = seen[both], place[both]
            first = np.sort(first[~later])
            size = end[first] - start[first]
            offsets = np.append(0, np.cumsum(size)).astype(np.int64)
            at = np.arange(offsets[-1]) + np.repeat(start[first] - offsets[:-1], size)
            text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(ids[first], pa.int64()), pa.array(number[first], pa.int32()), text.cast(pa.string())], names=["line", "doc", "number", "text"])


def kept_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """``doc`` and ``number`` of the lines that stay, of documents (id, text); see ``dedup_lines``."""
    local = docs.where("id is not null").mapInArrow(_local_lines, "line long, doc long, number int, text string")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # no less than what the lines have
    corpus = CorpusCounts.of_blocks(local.withColumnRenamed("line", "id"), total, keys_per_byte=0.02 * (edits + 2))

    def distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """A block's distinct lines where they stand first; characters, and which lines are long enough for edits."""
        table = table.sort_by([("id", "ascending"), ("doc", "ascending"), ("number", "ascending")]).combine_chunks()
        line = table.column("id").to_numpy()
        table = table.take(pa.array(np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)))
        data, offsets = code_points(_texts(table))
        long = np.flatnonzero(allowed(np.diff(offsets), edits) > 0)
        return table, data, offsets, long

    def count(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, data, offsets, long = distinct(table)
        key, _, _ = segment_keys(data, offsets[:-1][long], offsets[1:][long], edits)
        keys, counts = np.unique(key, return_counts=True)
        return keys, counts.astype(np.uint64)

    def run(table: pa.Table, totals) -> pa.Table:
        table, data, offsets, long = distinct(table)
        key, line, own = segment_keys(data, offsets[:-1][long], offsets[1:][long], edits)
        keys, counts = np.unique(key, return_counts=True)
        often = keys[totals(keys, counts.astype(np.uint64)) > 1]
        at = np.minimum(np.searchsorted(often, key), max(len(often) - 1, 0))
        shared = often[at] == key if len(often) else np.zeros(len(key), bool)
        meets = np.zeros(len(long), dtype=bool)
        meets[line[shared]] = True
        fuzzy = np.zeros(table.num_rows, dtype=bool)
        fuzzy[long[meets]] = True
        order = np.argsort(line[shared], kind="stable")
        per = np.zeros(table.num_rows, dtype=np.int64)
        per[long] = np.bincount(line[shared], minlength=len(long))
        bounds = pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
        text = table.column("text").combine_chunks()
        return pa.table({
            "line": table.column("id"), "doc": table.column("doc"), "number": table.column("number"),
            "text": pc.if_else(pa.array(fuzzy), text.cast(pa.string()), pa.scalar(None, pa.string())),
            "keys": pa.ListArray.from_arrays(bounds, pa.array(key[shared][order].view(np.int64))),
            "own": pa.ListArray.from_arrays(bounds, pa.array(own[shared][order])),
        })

    lines = cut_table(corpus.with_totals(corpus.replies(count), run, "line long, doc long, number int, text string, keys array<long>, own array<boolean>"))
    near = lines.where("text is not null")
    met = near.select("line", F.explode(F.arrays_zip("keys", "own")).alias("k")).groupBy(F.col("k.keys").alias("bucket"), F.col("line").alias("id")).agg(F.max("k.own").alias("own"))
    # only a key that is some line's own segment can be shared by lines within the edits
    rows = met.join(met.groupBy("bucket").agg(F.max("own").alias("any"), F.count("*").alias("n")).where("any and n > 1").select("bucket"), "bucket").select("bucket", "id")
    rows, texts = cut(rows), cut(near.select("line", "text"))
    # first a few leaders of each bucket, which settles lines of one pattern; then all that are not in one class yet
    labels, links = classes(rows, _verify(texts, edits), rounds=1)
    pairs = across(rows, labels, texts.mapInArrow(_histograms, "id long, counts binary"), _few_edits(edits))
    more = cut(_verify(texts, edits)(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    if not more.isEmpty():
        labels = connected(links.union(more))
    placed = near.select("line", "doc", "number").join(labels.withColumnRenamed("id", "line"), "line")
    best = placed.groupBy("label").agg(F.min(F.struct("doc", "number", "line")).alias("best")).select("label", F.col("best.line").alias("best"))
    gone = placed.join(best, "label").where("line <> best").select("line")
    return lines.select("line", "doc", "number").join(gone, "line", "left_anti").select("doc", "number")


def dedup_lines(docs: DataFrame, edits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes repeated lines from all documents; each line stays where it stands first, by document id and line number.

    Lines stand between line feeds. Lines are repeats if they are equal, or if links connect them of at most as many edits
    of characters as the shorter line allows: one for every ``CHARS_PER_EDIT`` characters, up to ``edits``. Such lines are
    one class, of which the first stays. Lines without a word (blank ones too) are no repeats of anything.

    Returns ``row`` (a struct of all columns of ``docs`` with the new text, so that no name can clash), ``n_lines`` (with
    words) and ``n_kept`` of each row, and ``chars`` and ``kept_chars`` of such lines. Null texts stay null and have no
    lines. Ids are integers; rows of one id count as one document: each keeps the lines that the id keeps, by number. Rows
    with a null id stay as they are. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    clean_shuffles(docs.sparkSession)
    keep = kept_lines(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), edits)
    keep = keep.groupBy("doc").agg(F.sort_array(F.collect_set("number")).alias("keep"))
    whole = with_rest(docs, id_col, text_col, carry=True)
    joined = whole.join(keep, F.col("id").cast("long") == F.col("doc"), "left").drop("doc")
    counts = ("n_lines", "n_kept", "chars", "kept_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (step for full in batches for step in steps(full, "text")):
            texts, keeps, ids = batch.column(1), batch.column(batch.num_columns - 1).to_pylist(), batch.column(0)
            out, numbers = [], np.zeros((4, batch.num_rows), dtype=np.int64)
            for i, text in enumerate(texts.to_pylist()):
                if text is None:
                    out.append(None)
                    continue
                lines = text.split("\n")
                has = [_WORD.search(x) is not None for x in lines]
                stay = set(keeps[i] or ()) if ids[i].is_valid else set(range(len(lines)))
                good = [not h or k in stay for k, h in enumerate(has)]
                out.append("\n".join(x for x, g in zip(lines, good, strict=True) if g))
                size = [len(x) if h else 0 for x, h in zip(lines, has, strict=True)]
                numbers[:, i] = sum(has), sum(h and g for h, g in zip(has, good, strict=True)), sum(size), sum(n for n, g in zip(size, good, strict=True) if g)
            columns = [ids, pa.array(out, texts.type), *batch.columns[2:-1], *(pa.array(n) for n in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *counts])

    found = joined.mapInArrow(run, StructType([*whole.schema.fields, *(StructField(c, LongType()) for c in counts)]))
    return found.select(whole_row(docs, id_col, text_col).alias("row"), *counts)


def line_report(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lines with words, lines that stay, and the SHA-256 of the text that stays (of nothing for null)."""
    kept = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    return deduped.select(F.col("row").getField(id_col).alias(id_col), "n_lines", "n_kept", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
