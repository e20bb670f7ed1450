"""Language identification: unigram piece models whose texts are scored over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docloom.llm._sample import LONGEST, by_class
from docloom.llm._text import Words, free_memory, small_batches, steps, whole_row, with_rest

#: Words up to so many bytes are segmented together with others of equal length; longer ones place by place, in logs.
SHORT = 32
#: Places of long words whose pieces are looked up at once.
PLACES = 200_000
#: Sums of short words below this are taken again in logs, before any product can underflow.
TINY = 1e-200
UNKNOWN = "und"


def public_pieces(path: str | None = None) -> list[bytes]:
    """The pieces of a public sentencepiece vocabulary as bytes, a space for its word mark, and every single byte."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({bytes([b]) for b in range(256)} | {t for t in texts if t})


class Pieces:
    """Finds the pieces that begin at a place of many byte strings at once, by hashes of their prefixes."""

    BASE = np.uint64(0x100000001B3)

    def __init__(self, pieces: list[bytes]):
        number = {p: i for i, p in enumerate(pieces)}
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        self.n, self.longest = len(pieces), max(map(len, pieces))
        keys = np.array([self._hash(p) for p in prefixes], dtype=np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two prefixes of the vocabulary have one hash")
        self.bits = max(12, int(len(keys) * 8).bit_length())
        size = (1 << self.bits) + 64
        self.key, self.value = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.reach = 1
        for k, p in zip(keys.tolist(), prefixes, strict=True):
            at = self._slot(np.uint64(k))
            step = 0
            while self.key[at + step]:
                step += 1
            self.key[at + step], self.value[at + step] = k, number.get(p, -1)
            self.reach = max(self.reach, step + 1)

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * int(Pieces.BASE) + b + 1) % (1 << 64)
        return h

    def match(self, data: np.ndarray, at: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that begin at places of ``data`` with so many bytes of room: length, which places, and numbers of pieces."""
        active, h = np.arange(len(at)), np.zeros(len(at), dtype=np.uint64)
        for n in range(1, self.longest + 1):
            fits = room[active] >= n
            active, h = active[fits], h[fits]
            if not len(active):
                return
            h = h * self.BASE + data[at[active] + n - 1].astype(np.uint64) + np.uint64(1)
            slot = self._slot(h)
            found = np.full(len(h), -1, dtype=np.int64)
            for step in range(self.reach):
                hit = self.key[slot + step] == h
                found[hit] = slot[hit] + step
            known = found >= 0
            active, h, found = active[known], h[known], found[known]
            piece = self.value[found]
            is_piece = piece >= 0
            if is_piece.any():
                yield n, active[is_piece], piece[is_piece]

    def edges(self, runs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of equal length (rows of bytes): start, length, rows and piece numbers of each piece that occurs."""
        rows, length = runs.shape
        flat, first = runs.ravel(), np.arange(rows) * length
        for i in range(length):
            for n, at, piece in self.match(flat, first + i, np.full(rows, length - i)):
                yield i, n, at, piece


def distinct_words(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the distinct words of ``w``, and which of them each word is."""
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    return w.start[first], w.end[first], which


def equal_lengths(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and bytes (a space first) of words of one length up to ``SHORT``, ``most`` at a time."""
    length = end - begin
    for n in np.unique(length[length <= SHORT]):
        rows = np.flatnonzero(length == n)
        for part in np.split(rows, range(most, len(rows), most)):
            runs = np.full((len(part), n + 1), 32, dtype=np.uint8)
            runs[:, 1:] = data[begin[part][:, None] + np.arange(n)]
            yield part, runs


def forward(pieces: Pieces, runs: np.ndarray, p: np.ndarray, edges: list | None = None) -> np.ndarray:
    """Sums over all segmentations of the first bytes of each run: rows, places, languages."""
    alpha = np.zeros((len(runs), runs.shape[1] + 1, p.shape[1]))
    alpha[:, 0] = 1
    for i, n, rows, piece in pieces.edges(runs) if edges is None else edges:
        alpha[rows, i + n] += alpha[rows, i] * p[piece]
    return alpha


class LongWords:
    """Words of more than ``SHORT`` bytes, a space before each, longest first; ``rows`` are their numbers."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: np.ndarray):
        self.rows = rows[np.argsort(begin[rows] - end[rows], kind="stable")]
        begin, end = begin[self.rows], end[self.rows]
        self.length = end - begin + 1
        self.first = np.append(0, np.cumsum(self.length))[:-1]
        self.data = np.full(int(self.length.sum()), 32, dtype=np.uint8)
        inside = np.ones(len(self.data), dtype=bool)
        inside[self.first] = False
        at = np.arange(len(self.data))
        self.data[inside] = data[(at - np.repeat(self.first + 1 - begin, self.length))[inside]]

    def columns(self, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place from the first: place, words that have it (the first so many), and word, length and number of each piece that begins there."""
        place = 0
        while place < self.length[0]:
            live = int(np.searchsorted(-self.length, -place))
            to = min(int(self.length[0]), place + max(1, PLACES // live))
            word, col = (x.ravel() for x in np.meshgrid(np.arange(live), np.arange(place, to), indexing="ij"))
            ok = col < self.length[word]
            word, col = word[ok], col[ok]
            found = [(np.full(len(at), n), at, piece) for n, at, piece in pieces.match(self.data, self.first[word] + col, self.length[word] - col)]
            n, at, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(col[at], kind="stable")
            n, at, piece = n[order], at[order], piece[order]
            edge = np.searchsorted(col[at], np.arange(place, to + 1))
            for k in range(to - place):
                part = slice(edge[k], edge[k + 1])
                yield place + k, int(np.searchsorted(-self.length, -(place + k))), word[at[part]], n[part], piece[part]
            place = to

    def forward(self, pieces: Pieces, log_p: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the sums over all segmentations: of whole words; and of their beginnings (all with ``whole``, else only the last places that a piece can span)."""
        width = int(self.length[0]) + 1 if whole else pieces.longest + 1
        alpha = np.full((len(self.rows), width, log_p.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for place, live, word, n, piece in self.columns(pieces):
            to = (place + n) % width
            alpha[word, to] = np.logaddexp(alpha[word, to], alpha[word, place % width] + log_p[piece])
            if not whole:
                alpha[:live, place % width] = -np.inf  # the next place that has this column is ``width`` later
        return alpha[np.arange(len(self.rows)), self.length % width], alpha

    def uses(self, pieces: Pieces, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations; words count as ``weight`` says in each language."""
        out, (total, alpha) = np.zeros_like(log_p), self.forward(pieces, log_p, whole=True)
        edges = [(np.full(len(word), place), word, n, piece) for place, _, word, n, piece in self.columns(pieces)]
        start, word, n, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        end = start + n
        order = np.argsort(-end, kind="stable")
        start, word, end, piece = start[order], word[order], end[order], piece[order]
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(self.rows)), self.length] = 0
        for part in np.split(np.arange(len(end)), np.flatnonzero(np.diff(end)) + 1):
            w, s = word[part], start[part]
            beta[w, s] = np.logaddexp(beta[w, s], beta[w, end[part]] + log_p[piece[part]])
        use = np.exp(alpha[word, start] + log_p[piece] + beta[word, end] - total[word]) * weight[self.rows][word]
        for k in range(log_p.shape[1]):
            out[:, k] = np.bincount(piece, weights=use[:, k], minlength=len(log_p))
        return out


def long_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int | None = None, more: list[np.ndarray] = ()) -> Iterator[LongWords]:
    """All words of more than ``SHORT`` bytes, and the rows ``more``; with ``most``, a few at a time of about that many bytes when all are as long as the longest."""
    rows = np.concatenate([np.flatnonzero(end - begin > SHORT), *more])
    rows = rows[np.argsort(begin[rows] - end[rows], kind="stable")]
    while len(rows):
        take = len(rows) if most is None else max(1, most // int(end[rows[0]] - begin[rows[0]]))
        yield LongWords(data, begin, end, rows[:take])
        rows = rows[take:]


class LanguageModel:
    """Piece probabilities of each language over one fixed vocabulary."""

    def __init__(self, languages: list[str], p: np.ndarray, prior: np.ndarray, pieces: list[bytes]):
        self.languages, self.p, self.prior, self.pieces = languages, p, prior, pieces

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "finder"}

    def log_likelihoods(self, texts: pa.Array) -> np.ndarray:
        """Natural logs of the probability of each text in each language; the place of a text's row."""
        if not hasattr(self, "finder"):
            self.finder = Pieces(self.pieces)
        w = Words(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(w.start):
            begin, end, which = distinct_words(w)
            logs = np.zeros((len(begin), len(self.languages)))
            rare = []
            for rows, runs in equal_lengths(w.data, begin, end):
                sums = forward(self.finder, runs, self.p)[:, -1]
                logs[rows] = np.log(np.maximum(sums, TINY))
                rare.append(rows[(sums < TINY).any(axis=1)])
            for words in long_words(w.data, begin, end, more=rare):
                logs[words.rows] = words.forward(self.finder, np.log(self.p))[0]
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(w.doc, weights=logs[which, k], minlength=len(texts))
        return out


def fit(texts: pa.Array, langs: list[str], pieces: list[bytes], prior: dict[str, int], rounds: int = 4, smooth: float = 0.02) -> LanguageModel:
    """Expectation maximisation of the piece probabilities of each language on its words and their counts.

    Every round sums, over all segmentations of every distinct word, the expected uses of each piece; ``smooth``
    uses are added to each piece.
    """
    names = sorted(set(langs))
    finder, w = Pieces(pieces), Words(texts)
    p = np.full((finder.n, len(names)), 1.0 / finder.n)
    if names and len(w.start):
        begin, end, which = distinct_words(w)
        lang = np.array([names.index(x) for x in langs])[w.doc]
        weight = np.stack([np.bincount(which, weights=lang == k, minlength=len(begin)) for k in range(len(names))], axis=1)
        for _ in range(rounds):
            uses, rare = np.zeros_like(p), []
            for rows, runs in equal_lengths(w.data, begin, end):
                edges = list(finder.edges(runs))
                alpha = forward(finder, runs, p, edges)
                low = (alpha[:, -1] < TINY).any(axis=1)
                rare.append(rows[low])
                beta = np.zeros_like(alpha)
                beta[:, -1] = np.where(low[:, None], 0, weight[rows] / np.maximum(alpha[:, -1], TINY))
                for i, n, at, piece in sorted(edges, key=lambda e: -e[0]):  # by where they begin, last first
                    use = p[piece] * beta[at, i + n]
                    beta[at, i] += use
                    use *= alpha[at, i]
                    for k in range(len(names)):
                        uses[:, k] += np.bincount(piece, weights=use[:, k], minlength=finder.n)
            for words in long_words(w.data, begin, end, most=1 << 18, more=rare):
                uses += words.uses(finder, np.log(p), weight)
            p = (uses + smooth) / (uses.sum(axis=0) + smooth * finder.n)
    total = sum(prior.get(n, 1) for n in names) or 1
    return LanguageModel(names, p, np.array([np.log(prior.get(n, 1) / total) for n in names]), pieces)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, vocabulary_path: str | None = None, longest: int = LONGEST) -> LanguageModel:
    """Fits a model on about ``per_language`` documents of each language of ``docs``, chosen by a hash of their ids from all of them.

    ``docs`` should hold training rows only. Rows with null language or text, or a text over ``longest`` bytes, teach nothing. Priors are the
    numbers of documents of each language among all rows. The sample, which its parameters bound, is fitted in one task; the driver
    gets the probabilities alone.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and id is not null")
    sample, counts = by_class(known, "id", "lang", per_language)
    pieces = public_pieces(vocabulary_path)
    small_batches(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("h", "ascending"), ("lang", "ascending")]).combine_chunks()
        model = fit(rows.column("text").combine_chunks(), rows.column("lang").to_pylist(), public_pieces(vocabulary_path), counts)
        free_memory()
        return pa.table({"languages": pa.array([model.languages], pa.list_(pa.string())), "p": pa.array([model.p.tobytes()], pa.binary())})

    rows = sample.where(F.octet_length("text") <= longest).select(F.lit(0).alias("all"), F.xxhash64("id", "text").alias("h"), "text", "lang")
    found = rows.groupBy("all").applyInArrow(run, "languages array<string>, p binary").collect()
    if not found:
        return fit(pa.array([], pa.string()), [], pieces, counts)
    names, total = found[0]["languages"], sum(counts.get(n, 1) for n in found[0]["languages"])
    p = np.frombuffer(bytes(found[0]["p"])).reshape(len(pieces), len(names))
    return LanguageModel(names, p, np.array([np.log(counts.get(n, 1) / total) for n in names]), pieces)


def _has_letter(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts.to_pylist()):
        out[i] = t is not None and any(map(str.isalpha, t))
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The likeliest language of every text and its posterior probability.

    Words are those of ``_text``: in ASCII lower case, each with a space before it and segmented in all ways, whatever its
    length; so pieces with ASCII capitals are never used, and what lies between words counts for nothing.
    Null texts, texts without a letter, and all texts of a model without languages are ``und`` with score 0.
    Equal languages go to the first by name. Repeated rows get a row each, an empty table an empty result.
    Columns other than id and text are not read, or all columns come back as one struct, ``row`` (``carry``).
    """
    small_batches(docs.sparkSession)
    kept = with_rest(docs, id_col, text_col, carry)
    n_back = len(kept.columns) if carry else 1
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed vocabulary times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for step in steps(batch, "text"):
                texts = step.column(1)
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m.languages:
                    logs = m.log_likelihoods(texts) + m.prior
                    best = logs.argmax(axis=1)
                    top = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    has = _has_letter(texts)
                    lang = [m.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                    score = np.where(has, top, 0.0)
                names = [*step.schema.names[:n_back], "lang_pred", "score"]
                yield pa.RecordBatch.from_arrays([*step.columns[:n_back], pa.array(lang, pa.string()), pa.array(score)], names=names)

    schema = StructType([*kept.schema.fields[:n_back], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = kept.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), *([whole_row(docs, id_col, text_col).alias("row")] if carry else []), "lang_pred", "score")
