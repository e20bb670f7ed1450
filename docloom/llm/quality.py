"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._sample import labelled_texts
from docloom.llm._text import Words, free_memory, mix, small_batches, steps

#: Words of a passage.
PASSAGE = 64
#: Classes of bytes: space, line end, a-z, A-Z, digit, sentence marks, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[[9, 32]] = 0
_CLASS[[10, 13]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
N_FEATURES = 64 + 7


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the passages before each text.

    A passage is ``PASSAGE`` words with all that stands between them and up to the next passage; the first also
    holds what stands before its words. A text without words is one passage. Features: square roots of the shares
    of pairs of adjacent byte classes, and statistics of the words.
    """
    w = Words(texts)
    n_passages = np.maximum(1, -(-w.counts // PASSAGE))
    begin = np.append(0, np.cumsum(n_passages))
    total = int(begin[-1])
    doc = np.repeat(np.arange(w.n_docs), n_passages)
    k = np.arange(total) - begin[:-1][doc]
    start = w.offsets[:-1][doc].copy()
    later = k > 0
    start[later] = w.start[(w.bounds[:-1][doc] + k * PASSAGE)[later]]
    size = np.diff(np.append(start, len(w.raw)))
    of_byte = np.repeat(np.arange(total), size)
    kind = _CLASS[w.raw]
    x = np.zeros((total, N_FEATURES))
    if len(kind) > 1:
        same = of_byte[1:] == of_byte[:-1]
        pairs = np.bincount((of_byte[:-1] * 64 + kind[:-1] * 8 + kind[1:])[same], minlength=total * 64).reshape(total, 64)
        x[:, :64] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    of_word = begin[:-1][w.doc] + (np.arange(len(w.start)) - w.bounds[:-1][w.doc]) // PASSAGE
    words = np.bincount(of_word, minlength=total)
    some = np.maximum(words, 1)
    length = w.end - w.start
    # distinct words: of equal keys of passage and word, the first counts
    order = np.argsort(mix(w.hash ^ mix(of_word.astype(np.uint64) + np.uint64(1))))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order][fresh], minlength=total)
    again = np.zeros(len(w.start), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
    x[:, 64] = words / PASSAGE
    x[:, 65] = np.bincount(of_word, weights=length, minlength=total) / some / 10
    x[:, 66] = distinct / some
    x[:, 67] = np.bincount(of_word, weights=again, minlength=total) / some
    x[:, 68] = np.bincount(of_word, weights=length >= 15, minlength=total) / some
    x[:, 69] = np.bincount(of_word, weights=length <= 3, minlength=total) / some
    x[:, 70] = np.log1p(size) / 8
    return x, begin


class QualityModel:
    """Passage encoder, gated attention, and the score of the weighted passage representation."""

    def __init__(self, parameters: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = parameters, mean, scale

    @classmethod
    def new(cls, x: np.ndarray, width: int = 24, gate: int = 12, seed: int = 5) -> QualityModel:
        rng = np.random.default_rng(seed)
        shape = {"enc": (x.shape[1], width), "enc_b": (width,), "v": (width, gate), "u": (width, gate), "w": (gate,), "out": (width,), "out_b": (1,)}
        p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in ("w", "out") else np.zeros(s) for k, s in shape.items()}
        return cls(p, x.mean(axis=0), x.std(axis=0) + 0.05)

    def run(self, x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """Encodings, attention weights and log odds of bags of passages; no bag is empty."""
        p, first = self.p, begin[:-1]
        n = np.diff(begin)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["enc"] + p["enc_b"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-h @ p["u"]))
        s = (tv * su) @ p["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        bag = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"z": z, "h": h, "tv": tv, "su": su, "a": a, "bag": bag, "logit": bag @ p["out"] + p["out_b"][0]}

    def gradient(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, r, n = self.p, self.run(x, begin), np.diff(begin)
        d_logit = weight * (1 / (1 + np.exp(-np.clip(r["logit"], -40, 40))) - y) / weight.sum()
        d_bag = np.repeat(d_logit[:, None] * p["out"], n, axis=0)
        along = (d_bag * r["h"]).sum(axis=1)
        d_s = r["a"] * (along - np.repeat(np.add.reduceat(r["a"] * along, begin[:-1]), n))
        d_tv, d_su = d_s[:, None] * p["w"] * r["su"] * (1 - r["tv"] ** 2), d_s[:, None] * p["w"] * r["tv"] * r["su"] * (1 - r["su"])
        d_h = (r["a"][:, None] * d_bag + d_tv @ p["v"].T + d_su @ p["u"].T) * (1 - r["h"] ** 2)
        return {"out": r["bag"].T @ d_logit, "out_b": np.array([d_logit.sum()]), "w": (r["tv"] * r["su"]).T @ d_s, "v": r["h"].T @ d_tv, "u": r["h"].T @ d_su, "enc": r["z"].T @ d_h, "enc_b": d_h.sum(axis=0)}

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts, attention weights of their passages, and the passages before each text."""
        x, begin = passages(texts)
        if not len(texts):
            return np.zeros(0), np.zeros(0), begin
        r = self.run(x, begin)
        return 1 / (1 + np.exp(-np.clip(r["logit"], -40, 40))), r["a"], begin


def fit(texts: pa.Array, labels: np.ndarray, counts: dict | None = None, rounds: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> QualityModel:
    """Adam over batches of documents on the log loss of the document labels; sampled classes weigh as in ``counts``."""
    n = np.array([(labels == k).sum() for k in (0, 1)])
    if not n.all():
        model = QualityModel.new(np.zeros((1, N_FEATURES)))
        p = np.clip((n[1] + 0.5) / (n.sum() + 1), 1e-3, 1 - 1e-3)
        model.p = {k: np.zeros_like(v) for k, v in model.p.items()} | {"out_b": np.array([np.log(p / (1 - p))])}
        return model
    x, begin = passages(texts)
    whole = np.array([(counts or {}).get(k, n[k]) for k in (0, 1)], dtype=float)
    weight = (whole / n)[labels]
    model, rng = QualityModel.new(x, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for turn in range(rounds):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            size = np.diff(begin)[part]
            to = np.append(0, np.cumsum(size))
            rows = np.arange(to[-1]) + np.repeat(begin[:-1][part] - to[:-1], size)
            t += 1
            for k, g in model.gradient(x[rows], to, labels[part], weight[part]).items():
                g = g + decay * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.p[k] -= rate * (1 - turn / rounds) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits a model on about ``per_class`` labelled documents of each class, chosen by a hash from all rows of ``labels``."""
    model = fit(*labelled_texts(docs, labels, label_col, per_class, id_col, text_col))
    free_memory()  # the driver lives on
    return model


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", attention: bool = False) -> DataFrame:
    """Quality of every whole text: ``score``; with ``attention`` also the weight of each passage, in order.

    Null and empty texts are one passage without words. Repeated rows get a row each, an empty table an empty
    result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                score, a, begin = sent.value.score(step.column(1))
                columns, names = [step.column(0), pa.array(score)], [id_col, "score"]
                if attention:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(a)))
                    names.append("attention")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kept.schema['id'].dataType.simpleString()}, score double" + ", attention array<double>" * attention
    return kept.mapInArrow(run, schema)
