"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from docloom.llm._text import Words, small_batches, steps, whole_row, with_rest
from docloom.session import cut_table

#: ASCII letters in lower case; other ASCII characters that are in no word become spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def _key(words: list[bytes]) -> str:
    """Words between single spaces, a character for a byte: one key can only match whole words."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


#: Bytes of items that one automaton holds; more are looked for part by part, one scan of the texts for each.
PART_BYTES = 8 << 20


class Index:
    """One automaton over all items, and their windows.

    Its patterns are the blocks of ``width`` // 2 words that an item is made of from its first word on, and all words of
    an item shorter than ``width``. Every window of an item holds a whole block in its first words; so where a text has a block,
    the few windows that can hold it there are looked up by their words. A place of a text is looked up once, and
    a window that a text has shown before adds nothing, so texts and items of any repetition take steps in proportion to the text.
    """

    def __init__(self, items: list[tuple], width: int):
        import ahocorasick

        self.width, self.size = width, max(1, width // 2)
        #: items by the words of each window, a number or a list of them
        self.windows: dict[bytes, int | list[int]] = {}
        self.ids, patterns = [i for i, _ in items], {}
        for k, (_, text) in enumerate(items):
            words = normal_words(text)
            if 0 < len(words) < width:
                patterns[_key(words)] = True
                self._add(b" ".join(words), k)
            for at in range(0, len(words) - self.size + 1, self.size) if len(words) >= width else ():
                patterns.setdefault(_key(words[at : at + self.size]), False)
            for at in range(len(words) - width + 1):
                self._add(b" ".join(words[at : at + width]), k)
        self.automaton = ahocorasick.Automaton()
        for key, whole in patterns.items():
            self.automaton.add_word(key, (len(key), whole))
        if patterns:
            self.automaton.make_automaton()

    def _add(self, window: bytes, k: int) -> None:
        known = self.windows.setdefault(window, k)
        if isinstance(known, list):
            if known[-1] != k:
                known.append(k)
        elif known != k:
            self.windows[window] = [known, k]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list]:
        """Merged ranges of words (first, and the one behind the last) inside windows, and the ids of their items."""
        if not words or not len(self.automaton):
            return [], []
        key = _key(words)
        hits = [(end - n + 1, end, whole) for end, (n, whole) in self.automaton.iter(key)]
        if not hits:
            return [], []
        raw = key.encode("latin-1")
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        firsts, lasts = (np.searchsorted(spaces, np.array([h[j] for h in hits])).tolist() for j in (0, 1))
        spaces = spaces.tolist()
        tried, seen = bytearray(len(words)), set()
        ranges: list[tuple[int, int]] = []

        def look(first: int, last: int) -> None:
            window = raw[spaces[first] + 1 : spaces[last]]
            if window in self.windows:
                seen.add(window)
                ranges.append((first, last))

        for first, last, (_, _, whole) in zip(firsts, lasts, hits, strict=True):
            if whole:
                look(first, last)
            for at in range(max(0, first - self.size + 1), min(first, len(words) - self.width) + 1):
                if not tried[at]:
                    tried[at] = 1
                    look(at, at + self.width)
        found = set()
        for window in seen:
            k = self.windows[window]
            found.update(self.ids[x] for x in (k if isinstance(k, list) else (k,)))
        return _merge(ranges), sorted(found - {None})


_BUILT: dict[int, Index] = {}


def _index(sent) -> Index:
    """The index of broadcast items, built once in each Python worker."""
    if sent.id not in _BUILT:
        _BUILT.clear()
        _BUILT[sent.id] = Index(*sent.value)
    return _BUILT[sent.id]


class _Sent:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False) -> DataFrame:
    """Words of every document that lie in occurrences of benchmark windows.

    Words are ASCII letters and digits and non-ASCII characters, in ASCII lower case. A window is ``width``
    consecutive words of an item, or all words of a shorter one. Texts are scanned once, by one automaton, without a
    shuffle. Items of over ``PART_BYTES`` are dealt into parts by a hash, each with an automaton that is sent to every
    executor; each part's scan adds to the ranges and items of those before, which are kept in a table.

    Returns id, text, row (with ``carry``: all columns as one struct), n_words, ranges (merged ranges of words: first, and the one behind the last) and items
    (ids of items with occurring windows, ascending; an item with a null id counts only for the ranges). Null and empty
    texts have no words. Repeated rows get a row each, empty tables give no rows or no hits; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    if parts > 1:
        chosen = cut_table(chosen.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))))
    item_kind, item_type = items.schema[item_col].dataType.simpleString(), to_arrow_type(items.schema[item_col].dataType)
    kept = with_rest(docs, id_col, text_col, carry)
    n_back = len(kept.columns)
    added = spark.createDataFrame([], f"n_words long, ranges array<struct<first:int,last:int>>, items array<{item_kind}>").schema
    schema, span_type = StructType([*kept.schema.fields, *added.fields]), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def scan(sent: _Sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(sent)
            for batch in batches:
                for step in steps(batch, "text"):
                    n_words, ranges, found = [], [], []
                    before = (step.column(k).to_pylist() if step.num_columns > n_back else [None] * step.num_rows for k in (n_back + 1, n_back + 2))
                    for text, old_ranges, old_items in zip(step.column(1).to_pylist(), *before, strict=True):
                        words = normal_words(text)
                        spans, ids = index.find(words)
                        if old_items or old_ranges:
                            spans, ids = _merge([*spans, *((r["first"], r["last"]) for r in old_ranges)]), sorted({*ids, *old_items})
                        n_words.append(len(words))
                        ranges.append([{"first": a, "last": b} for a, b in spans])
                        found.append(ids)
                    yield pa.RecordBatch.from_arrays([*step.columns[:n_back], pa.array(n_words, pa.int64()), pa.array(ranges, span_type), pa.array(found, pa.list_(item_type))], names=schema.names)

        return run

    out = kept
    for k in range(parts):
        own = chosen if parts == 1 else chosen.where(F.col("part") == k)
        sent = _Sent(spark.sparkContext.broadcast(([(r["item"], r["text"]) for r in own.select("item", "text").collect()], width)))
        out = (cut_table(out) if k else out).mapInArrow(scan(sent), schema)
    row = [whole_row(docs, id_col, text_col).alias("row")] if carry else []
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *row, "n_words", "ranges", "items")


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated, from ``find_contamination``."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"))


def hit_spans(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Character spans (start, end) of the hit words in the original texts of contaminated documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i in range(batch.num_rows):
                w = Words(batch.column(1).slice(i, 1))
                chars = np.append(0, np.cumsum((w.raw & 0xC0) != 0x80))
                for r in batch.column(2)[i].as_py():
                    rows.append(i)
                    starts.append(int(chars[w.start[r["first"]]]))
                    ends.append(int(chars[w.end[r["last"] - 1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "start", "end"])

    kept = found.where(F.size("ranges") > 0).select(id_col, text_col, "ranges")
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, start int, end int")
