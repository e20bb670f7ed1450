"""Language-model scores by stupid backoff over the corpus itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm._counts import CorpusCounts, _texts
from docloom.llm._text import Words

#: The key whose count is the number of words of the corpus.
_ALL = np.uint64(0)


def _grams(texts: pa.Array, order: int) -> tuple[Words, list[np.ndarray], list[np.ndarray]]:
    """Words, and for each length up to ``order`` the hashes of n-grams and the words that they end at."""
    w = Words(texts)
    hashes, ends = [], []
    for n in range(1, order + 1):
        h, at = w.grams(n)
        hashes.append(np.maximum(h, np.uint64(1)))
        ends.append(at + n - 1)
    return w, hashes, ends


def _counted(w: Words, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their counts; counted length by length, as all hashes at once take more memory."""
    each = [np.unique(h, return_counts=True) for h in hashes]
    keys = np.concatenate([[_ALL], *(k for k, _ in each)])
    counts = np.concatenate([[len(w.start)], *(c for _, c in each)]).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def ngram_counts(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    w, hashes, _ = _grams(texts, order)
    return _counted(w, hashes)


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the n-gram at each place stands in the same document."""
    order = np.lexsort((doc, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.bincount(run)[run] if len(h) else 0
    return out


def score_documents(docs: DataFrame, order: int = 3, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's log score under n-gram counts of all other documents.

    Words are as in ``_text``. Counts of all n-grams up to ``order`` are taken over the whole corpus, in a table
    partitioned by hash and joined to the n-grams of each block of documents; what a document holds itself is taken off its counts. A word's score is the count of the
    longest n-gram that ends at it and occurs elsewhere, over the count of that n-gram without the word, times
    ``backoff`` for each word by which the context was shortened. For one word alone it is its count over the number
    of words elsewhere, where a word that occurs nowhere else counts as one, and so does an empty corpus.

    Returns id, n_words, log_score (the sum of natural logs, rounded to 4 digits) and mean_log_score (per word,
    rounded to 6; null without words, as for null and empty texts). Repeated rows are documents of their own, whose
    counts remain with each other. An empty table gives an empty result; other columns are not read.
    """
    corpus = CorpusCounts(docs, id_col, text_col, keys_per_byte=0.15 * order)

    def run(table: pa.Table, totals) -> pa.Table:
        texts = _texts(table)
        w, hashes, ends = _grams(texts, order)
        keys, counts = _counted(w, hashes)
        total = totals(keys, counts)
        elsewhere = np.maximum(total[0] - w.counts, 1)[w.doc]
        score = np.zeros(len(w.start))
        context = None
        for n, (h, end) in enumerate(zip(hashes, ends, strict=True)):
            count = np.zeros(len(w.start), dtype=np.int64)
            count[end] = total[np.searchsorted(keys, h)] - _own(h, w.doc[end])
            if n == 0:
                score = np.log(np.maximum(count, 1) / elsewhere)
            else:
                before = np.ones(len(w.start), dtype=np.int64)
                before[1:] = context[:-1]
                seen = np.zeros(len(w.start), dtype=bool)
                seen[end] = count[end] > 0
                full = np.zeros(len(w.start), dtype=bool)
                full[end] = True
                # a text's first words have no longer context that could be shortened
                score = np.where(seen, np.log(np.maximum(count, 1) / np.maximum(before, 1)), score + np.where(full, np.log(backoff), 0.0))
            context = count
        total_score = np.bincount(w.doc, weights=score, minlength=len(texts)).astype(float)  # of no words, numpy counts in integers
        n = w.counts
        mean = pa.array(np.round(total_score / np.maximum(n, 1), 6), mask=n == 0)
        ids = table.column("id")
        return pa.table({id_col: ids, "n_words": n.astype(np.int64), "log_score": np.round(total_score, 4), "mean_log_score": mean})

    kind = docs.schema[id_col].dataType.simpleString()
    return corpus.with_totals(corpus.replies(lambda t: ngram_counts(t, order)), run, f"`{id_col}` {kind}, n_words long, log_score double, mean_log_score double")
