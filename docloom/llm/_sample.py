"""Bounded samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._text import Words


def id_remainder(column: str, n: int):
    """crc32 of an id as text, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def by_class(labels: DataFrame, id_col: str, class_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class, the same ones at each run, and the number of rows of each class.

    A row stays if a hash of its id falls below the share that its class may keep, so the sample is bounded
    by classes times ``per_class`` in expectation and drawn from all rows.
    """
    counts = {r[0]: r[1] for r in labels.groupBy(class_col).count().collect()}
    u = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts.items():
        if value is not None:
            share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    return labels.where(u < share), counts


#: Bytes of the longest text that a sample may hold, so that its rows bound its bytes too.
LONGEST = 1 << 20


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> tuple[pa.Array, np.ndarray, dict]:
    """Texts and 0/1 labels of a bounded sample of the rows of ``labels``, in the order of a hash.

    Only rows whose label is 0 or 1 and whose document is there count; ``labels`` should hold training rows alone. Texts over
    ``longest`` bytes teach nothing.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sample, counts = by_class(labels, "id", "y", per_class)
    # the sample is bounded by its parameter, so it may be sent to every executor
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    found = texts.join(F.broadcast(sample), "id").select(F.xxhash64("id", "text").alias("h"), "text", "y").toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
    text = found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string())
    return text, found.column("y").to_numpy().astype(np.int64), counts


def distinct_texts(texts: pa.Array) -> np.ndarray:
    """Rows of which none is a near copy of an earlier one: no two share the least hash of their 5-word runs, under either of two orders."""
    w = Words(texts)
    grams, at = w.grams(5)
    doc = w.doc[at]
    keep = np.ones(len(texts), dtype=bool)
    for turn in (np.uint64(0), np.uint64(0x5DEECE66D1234567)):
        order = np.lexsort((grams ^ turn, doc))
        first = order[np.r_[True, doc[order][1:] != doc[order][:-1]]] if len(order) else order
        least = np.zeros(len(texts), dtype=np.uint64)
        least[doc[first]] = grams[first]
        has = np.zeros(len(texts), dtype=bool)
        has[doc[first]] = True
        _, one = np.unique(least, return_index=True)
        unique = np.zeros(len(texts), dtype=bool)
        unique[one] = True
        keep &= unique | ~has
    return np.flatnonzero(keep)
