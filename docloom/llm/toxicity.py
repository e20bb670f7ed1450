"""Toxicity: a linear-chain conditional random field over words, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._sample import distinct_texts, labelled_texts
from docloom.llm._text import Words, free_memory, mix, small_batches, span_hashes, steps

#: Words of a block. A text is one chain whatever its length; its blocks are walked side by side.
BLOCK = 64
#: A word or shape has weights of its own from so many texts of the sample on.
KNOWN_FROM = 3


def shapes(w: Words) -> np.ndarray:
    """A hash of the first six bytes and the length of each word."""
    return mix(span_hashes(w.data, w.start, np.minimum(w.start + 6, w.end)) + (w.end - w.start).astype(np.uint64))


def _known(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ascending hashes that stand in ``KNOWN_FROM`` texts at least."""
    pair = np.unique(np.stack([hashes, doc.astype(np.uint64)], axis=1), axis=0)
    value, n = np.unique(pair[:, 0], return_counts=True)
    return value[n >= KNOWN_FROM]


def _number(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """1 and more for what is in the vocabulary, else 0."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


class Crf:
    """Two tags, toxic and not. The field's log odds of a word come from the word, its shape and both its neighbours."""

    def __init__(self, words: np.ndarray | None = None, shapes: np.ndarray | None = None):
        none = np.zeros(0, np.uint64)
        self.words, self.shapes = none if words is None else words, none if shapes is None else shapes
        n = len(self.words) + 1
        self.tables = [np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(len(self.shapes) + 1)]
        self.bias, self.move = -3.0, np.zeros((2, 2))

    def features(self, w: Words) -> np.ndarray:
        """Numbers of a word, of the word before, of the word behind and of its shape; 0 if unknown, or beyond a text's edge."""
        own = _number(self.words, w.hash)
        before, after = np.zeros_like(own), np.zeros_like(own)
        same = w.doc[1:] == w.doc[:-1]
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
        return np.stack([own, before, after, _number(self.shapes, shapes(w))], axis=1)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.bias + sum(t[features[..., k]] for k, t in enumerate(self.tables))

    def forward_backward(self, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of the toxic to the other tag, of the forward and of the backward sums at each word; texts have ``counts`` words.

        A step along a chain is a matrix of two by two. So the matrices of all blocks are multiplied side by side, then
        the sums at the blocks' edges follow block by block, and then those inside all blocks side by side.
        """
        a = np.exp(self.move)
        x = np.exp(np.clip(e, -40, 40))
        n = -(-counts // BLOCK)
        first = np.append(0, np.cumsum(n))
        doc = np.repeat(np.arange(len(counts)), n)
        number = np.arange(first[-1]) - first[:-1][doc]
        begin = (np.append(0, np.cumsum(counts))[:-1])[doc] + number * BLOCK
        size = np.minimum(BLOCK, counts[doc] - number * BLOCK)
        r, s = np.empty_like(x), np.empty_like(x)
        if not len(doc):
            return r, s
        # products of diag(1, x) a' over each block, scaled to a largest entry of one
        step = np.zeros((len(doc), 2, 2))
        step[:, 0, 0] = step[:, 1, 1] = 1
        later = number > 0
        for t in range(BLOCK if later.any() else 0):
            live = np.flatnonzero(later & (size > t))
            if not len(live):
                break
            p = a.T @ step[live]
            p[:, 1] *= x[begin[live] + t][:, None]
            step[live] = p / p.max(axis=(1, 2), keepdims=True)
        # the forward ratio before each block but the first ones, and the backward ratio at each block's last word
        enters, leaves = np.zeros(len(doc)), np.ones(len(doc))
        self._inside(x, r, begin, size, enters, np.flatnonzero(number == 0))
        for k in range(1, int(n.max())):
            now = first[:-1][n > k] + k
            before = now - 1
            if k == 1:
                enters[now] = r[begin[before] + size[before] - 1]
            else:
                m = step[before]
                enters[now] = (m[:, 1, 0] + m[:, 1, 1] * enters[before]) / (m[:, 0, 0] + m[:, 0, 1] * enters[before])
        self._inside(x, r, begin, size, enters, np.flatnonzero(later))
        for k in range(int(n.max()) - 2, -1, -1):
            now = first[:-1][n > k + 1] + k
            m = step[now + 1]
            leaves[now] = (m[:, 0, 1] + m[:, 1, 1] * leaves[now + 1]) / (m[:, 0, 0] + m[:, 1, 0] * leaves[now + 1])
        s[begin + size - 1] = leaves
        for t in range(BLOCK - 2, -1, -1):
            at = begin[size > t + 1] + t
            y = x[at + 1] * s[at + 1]
            s[at] = (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y)
        return r, s

    def _inside(self, x: np.ndarray, r: np.ndarray, begin: np.ndarray, size: np.ndarray, enters: np.ndarray, blocks: np.ndarray) -> None:
        """Forward ratios inside blocks, those of a text's first words or those entered with a ratio."""
        if not len(blocks):
            return
        a = np.exp(self.move)
        begin, size, before = begin[blocks], size[blocks], enters[blocks]
        for t in range(int(size.max())):
            live = size > t
            at = begin[live] + t
            if t == 0 and not before.any():
                r[at] = x[at]
            else:
                was = before[live] if t == 0 else r[at - 1]
                r[at] = x[at] * (a[0, 1] + a[1, 1] * was) / (a[0, 0] + a[1, 0] * was)

    def marginals(self, w: Words) -> np.ndarray:
        """Each word's probability of being toxic, in the chain of its whole text."""
        r, s = self.forward_backward(self.emissions(self.features(w)), w.counts)
        odds = r * s
        return odds / (1 + odds)

    def fit(self, w: Words, tags: np.ndarray, rounds: int = 8, batch_words: int = 16_384, rate: float = 0.3, decay: float = 1e-5, seed: int = 11) -> Crf:
        """Maximises the likelihood of the tags by AdaGrad over batches of whole texts of about ``batch_words`` words."""
        rng = np.random.default_rng(seed)
        features = self.features(w)
        chosen = np.flatnonzero(w.counts > 0)
        seen = [np.full(len(t), 1e-3) for t in self.tables]
        seen_bias, seen_move = 1e-3, np.full((2, 2), 1e-3)
        for _ in range(rounds):
            order = rng.permutation(chosen)
            cuts = np.flatnonzero(np.diff(np.cumsum(w.counts[order]) // batch_words)) + 1
            for part in np.split(order, cuts) if len(order) else []:
                counts = w.counts[part]
                at = np.arange(counts.sum()) + np.repeat(w.bounds[:-1][part] - np.append(0, np.cumsum(counts))[:-1], counts)
                f, y, doc = features[at], tags[at], np.repeat(np.arange(len(part)), counts)
                e = self.emissions(f)
                r, s = self.forward_backward(e, counts)
                error = r * s / (1 + r * s) - y
                for k, (table, had) in enumerate(zip(self.tables, seen, strict=True)):
                    where, which = np.unique(f[:, k], return_inverse=True)
                    g = np.bincount(which, weights=error, minlength=len(where)) + decay * table[where]
                    had[where] += g * g
                    table[where] -= rate * g / np.sqrt(had[where])
                g = error.sum()
                seen_bias += g * g
                self.bias -= rate * g / np.sqrt(seen_bias)
                pair = np.flatnonzero(doc[1:] == doc[:-1])
                x, a = np.exp(np.clip(e[pair + 1], -40, 40)), np.exp(self.move)
                before, after = r[pair], x * s[pair + 1]
                joint = np.stack([np.full(len(pair), a[0, 0]), a[0, 1] * after, a[1, 0] * before, a[1, 1] * before * after])
                joint /= joint.sum(axis=0)
                g = (joint.sum(axis=1) - np.bincount(y[pair] * 2 + y[pair + 1], minlength=4)).reshape(2, 2)
                seen_move += g * g
                self.move -= rate * g / np.sqrt(seen_move)
        return self


def toxic_words(w: Words, labels: np.ndarray, evidence: float = 11.0, share: float = 0.8) -> np.ndarray:
    """Hashes of words that mark toxic texts: ``share`` of the texts that hold one are toxic, and the log likelihood ratio against no relation is at least ``evidence``."""
    pair = np.unique(np.stack([w.hash, w.doc.astype(np.uint64)], axis=1), axis=0)
    word, which = np.unique(pair[:, 0], return_inverse=True)
    toxic = labels[pair[:, 1].astype(np.int64)] == 1
    a = np.bincount(which, weights=toxic, minlength=len(word))
    b = np.bincount(which, weights=~toxic, minlength=len(word))
    q = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    p = (a + 0.5) / (a + b + 1)
    ratio = a * np.log(p / q) + b * np.log((1 - p) / (1 - q))
    return word[(ratio >= evidence) & (a >= share * (a + b)) & (p > q)]


def _summaries(marginal: np.ndarray, w: Words) -> np.ndarray:
    """Of each text: the largest marginal, the log of one more than their sum, and their mean."""
    total = np.bincount(w.doc, weights=marginal, minlength=w.n_docs)
    most = np.zeros(w.n_docs)
    has = w.counts > 0
    if has.any():
        most[has] = np.maximum.reduceat(marginal, w.bounds[:-1][has])
    return np.stack([most, np.log1p(total), total / np.maximum(w.counts, 1)], axis=1)


class ToxicityModel:
    """A field, and the logistic regression from marginals to the odds of a toxic document."""

    def __init__(self, crf: Crf, weights: np.ndarray):
        self.crf, self.weights = crf, weights

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
        w = Words(texts)
        marginal = self.crf.marginals(w)
        x = _summaries(marginal, w)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40))), marginal, w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        beta -= np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * beta)
    return beta


def fit(texts: pa.Array, labels: np.ndarray, counts: dict | None = None) -> ToxicityModel:
    """Tags the words that mark toxic documents, fits the field to these tags and then the document score to the labels.

    Near copies within the sample count once when words are chosen. ``counts`` are the numbers of labelled rows of
    each class, to which the sampled classes are weighted back.
    """
    n = np.array([(labels == k).sum() for k in (0, 1)])
    if not n.all():  # one class or no rows: the share of toxic rows, for every text
        p = np.clip((n[1] + 0.5) / (n.sum() + 1), 1e-3, 1 - 1e-3)
        return ToxicityModel(Crf(), np.array([0.0, 0.0, 0.0, np.log(p / (1 - p)) if n.sum() else -5.0]))
    apart = distinct_texts(texts)
    single = Words(texts.take(pa.array(apart)))
    words = toxic_words(single, labels[apart])
    crf = Crf(np.union1d(_known(single.hash, single.doc), words), _known(shapes(single), single.doc)).fit(single, (np.isin(single.hash, words) & (labels[apart][single.doc] == 1)).astype(np.int64))
    every = Words(texts)
    whole = np.array([(counts or {}).get(k, n[k]) for k in (0, 1)], dtype=float)
    weight = (whole / n)[labels]
    return ToxicityModel(crf, _logistic(_summaries(crf.marginals(every), every), labels, weight / weight.mean()))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits a model on about ``per_class`` labelled documents of each class, chosen by a hash from all rows of ``labels``."""
    model = fit(*labelled_texts(docs, labels, label_col, per_class, id_col, text_col))
    free_memory()  # the driver lives on
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, span_threshold: float = 0.5) -> DataFrame:
    """Toxicity of every whole text: ``score``; with ``spans`` also the offending spans (start, end in characters, p).

    Null and empty texts have no words and get the score of a text without toxic words. Repeated rows get a row
    each, an empty table an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary of its bounded sample
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                score, marginal, w = sent.value.score(step.column(1))
                columns, names = [step.column(0), pa.array(score)], [id_col, "score"]
                if spans:
                    chars = np.append(0, np.cumsum((w.raw & 0xC0) != 0x80))
                    found: list[list] = [[] for _ in range(step.num_rows)]
                    for k in np.flatnonzero(marginal >= span_threshold):
                        d = w.doc[k]
                        base = chars[w.offsets[d]]
                        found[d].append({"start": int(chars[w.start[k]] - base), "end": int(chars[w.end[k]] - base), "p": float(marginal[k])})
                    columns.append(pa.array(found, span_type))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kept.schema['id'].dataType.simpleString()}, score double" + ", spans array<struct<start:int,end:int,p:double>>" * spans
    return kept.mapInArrow(run, schema)
