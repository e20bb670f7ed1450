"""SimHash near-duplicates: fingerprints of word shingles, and covering locality-sensitive hashing of all that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._classes import connected
from docloom.llm._text import LOWER, free_memory, small_batches, steps, text_bytes
from docloom.session import clean_shuffles, cut, cut_table

BITS, SHINGLE, SEED = 64, 3, 42
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 15
#: Members of a bucket that one task compares with each other; larger buckets are parted by more masks.
MEMBERS = 512
#: Pairs that a task compares at once.
_PAIRS = 1 << 20


_WHITE = np.zeros(256, dtype=bool)
_WHITE[9:14] = _WHITE[32] = True


def fingerprint(text: np.ndarray, shingle: int = SHINGLE) -> int:
    """The SimHash of the bytes of a text: bit b is set if it is set in over half the hashes of the shingles, repeats included."""
    white = _WHITE[text]
    last = white.copy()  # white bytes behind a word
    last[1:] &= ~white[:-1]
    last[:1] = False
    words = np.where(white, np.uint8(32), text)[~white | last]
    if len(words) and words[-1] == 32:
        words = words[:-1]
    if not len(words):
        return 0
    spaces = np.flatnonzero(words == 32)
    width = min(shingle, len(spaces) + 1)
    begins, ends = np.append(0, spaces + 1)[: len(spaces) + 2 - width], np.append(spaces, len(words))[width - 1 :]
    digest, ones, data = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), words.tobytes()
    for at in range(0, len(ends), _CHUNK):
        h = np.array([digest(data[a:b], SEED) for a, b in zip(begins[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row; words are what white space parts, in ASCII lower case."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                raw, offsets = text_bytes(step.column(1))
                low = LOWER[raw]
                found = [fingerprint(low[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


def covering_masks(free: list[int], radius: int) -> list[int]:
    """Masks over the bits ``free`` such that any two values that differ in at most ``radius`` of them agree under some mask.

    Bit i gets a nonzero vector of ``radius`` + 1 binary digits, all vectors in turn; mask v holds the bits whose vector has an odd
    product with v. At most ``radius`` differing bits are as many linear equations in v, which a nonzero v solves.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(free) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _groups_in(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(column.value_lengths().to_numpy().astype(np.int64)))


def _link_members(radius: int):
    """Links between members of each bucket: a row has all (few) members of one; links of one bucket make trees, not all pairs."""

    def small(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members of buckets of a few."""
        size = np.diff(bounds)
        after = np.repeat(bounds[1:], size) - np.arange(len(values)) - 1
        left = np.repeat(np.arange(len(values)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        near = np.bitwise_count(values[left] ^ values[right]) <= radius
        return values[left[near]], values[right[near]]

    def large(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A star for each connected part of one bucket, found by walking it breadth first."""
        near = np.bitwise_count(values[:, None] ^ values) <= radius
        left, right, fresh = [], [], np.ones(len(values), dtype=bool)
        while fresh.any():
            seen = np.zeros(len(values), dtype=bool)
            root = int(fresh.argmax())
            seen[root], front = True, np.array([root])
            while len(front):
                reached = near[front].any(axis=0) & ~seen
                seen |= reached
                front = np.flatnonzero(reached)
            fresh &= ~seen
            others = np.flatnonzero(seen)[1:]
            left.append(np.full(len(others), values[root]))
            right.append(values[others])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = _groups_in(batch.column(0))
            size, found = np.diff(bounds), []
            few = np.flatnonzero(size <= 16)
            for part in np.array_split(few, max(1, -(-int((size[few] ** 2).sum()) // _PAIRS))):
                own = np.repeat(bounds[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                found.append(small(values[own], np.append(0, np.cumsum(size[part]))))
            found += [large(values[bounds[k] : bounds[k + 1]]) for k in np.flatnonzero(size > 16)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            ends = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], names=["a", "b"])
            free_memory()

    return run


def near_links(values: DataFrame, radius: int = 2, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) that connect all distinct values ``fp`` of 64 bits that differ in ``radius`` bits or fewer.

    Each value goes to one bucket of each of 2 ** (radius + 1) - 1 tables, known by its bits under the table's covering mask; a pair
    in reach meets in one bucket at least. Buckets are counted before they are gathered. One of more than ``members`` values is
    not gathered: its values go on to tables of masks over the bits that its own mask left free, so every level
    leaves fewer bits that can differ, until no bucket can hold more than ``members`` values. So values move a bounded number of
    times, no bucket is cut short, and no pair in reach is lost.
    """
    spark = values.sparkSession
    live = values.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("fixed"), F.col("fp"))
    paths = {"": list(range(BITS))}
    found = None
    while paths:
        # masks by path, which names the masks taken so far: n ** level rows at most
        table = {f"{p}{v:02d}": mask for p, free in paths.items() for v, mask in enumerate(covering_masks(free, radius))}
        masks = spark.createDataFrame([(k[:-2], k, _signed(mask)) for k, mask in table.items()], "path string, next string, mask long")
        dealt = live.join(F.broadcast(masks), "path").select(F.col("next").alias("path"), F.col("fixed").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("fixed"), "fp")
        sizes = dealt.groupBy("path", "fixed").agg(F.count("*").alias("size")).where("size > 1")
        shared = cut_table(dealt.join(sizes, ["path", "fixed"]))
        groups = shared.where(F.col("size") <= members).groupBy("path", "fixed").agg(F.collect_list("fp").alias("fps")).select("fps")
        links = cut(groups.mapInArrow(_link_members(radius), "a long, b long").distinct())
        found = links if found is None else found.union(links)
        live = shared.where(F.col("size") > members).select("path", "fixed", "fp")
        open_ = [r[0] for r in live.select("path").distinct().collect()]
        paths = {p: [b for b in paths[p[:-2]] if not table[p] >> b & 1] for p in open_}
    return found


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint (16 hex digits) and component of every row: id, fingerprint, component_id.

    Fingerprints link at ``radius`` or fewer differing bits; a component's id is its least document id. Texts of equal fingerprints are one
    value from the start, so groups of copies cost one row each. Null, empty and white texts have fingerprint 0 and are linked like any other; repeated
    rows get a row each; null ids name no component: a component of null ids alone has a null id. An empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    clean_shuffles(docs.sparkSession)
    found = cut_table(fingerprints(docs, id_col, text_col, shingle))
    values = cut_table(found.groupBy("fp").agg(F.min("id").alias("least")))
    labels = connected(near_links(values, radius)).withColumnRenamed("id", "fp")
    of = values.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = of.join(least, "label").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.join(of, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")
