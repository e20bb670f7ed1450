"""Near-duplicate documents: consistent weighted sampling of TF-IDF shingles, bands, and verified weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._classes import Forest, across, classes, connected
from docloom.llm._counts import CorpusCounts, _texts, expand, pack_sorted, squeeze, unpack_sorted
from docloom.llm._text import Words, gram_hash, mix, small_batches, steps
from docloom.session import clean_shuffles, cut, cut_table

SHINGLE = 5
#: Documents that share a band are compared; two of similarity 0.8 share one with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.9998.
BANDS, ROWS = 16, 4
#: Share of all documents that is added to the share of documents with a shingle, before its inverse is taken.
SMOOTH = 0.01
_TABLE = 1 << 16
#: Document frequencies are kept by the upper 48 bits of a shingle's hash. Two shingles that share them can only seem
#: more frequent, by as much as both are, and keep a document that could have been left out.
_DF_SHIFT = np.uint64(16)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text, count in the text; and a hash of each text's words (0 without words).

    A text of fewer than ``SHINGLE`` words, but not none, has one shingle, all its words. Texts are taken a few at a time, for the memory.
    """
    parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    for step in steps(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20):
        h, doc, tf, whole = _shingles(step.column(0))
        parts.append((h, doc + at, tf, whole))
        at += step.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w = Words(texts)
    h, at = w.grams(SHINGLE)
    doc = w.doc[at]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            h = np.append(h, gram_hash([w.hash[w.bounds[short] + k] for k in range(n)]))
            doc = np.append(doc, short)
    place = mix(np.arange(len(w.start), dtype=np.uint64) - w.bounds[:-1][w.doc].astype(np.uint64))
    whole = np.zeros(w.n_docs, dtype=np.uint64)
    has = w.counts > 0
    if has.any():
        whole[has] = np.add.reduceat(mix(w.hash ^ place), w.bounds[:-1][has])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], doc[first], np.diff(np.append(first, len(h))), whole


def _df_key(h: np.ndarray) -> np.ndarray:
    return np.maximum(h >> _DF_SHIFT, np.uint64(1))


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """TF-IDF: (1 + ln tf) times ln(1 + 1 / (df / n + SMOOTH)), as 32-bit values.

    The smoothing keeps what many copies share from weighing little beside what an edit makes unique: with a plain
    ln(n / df), two texts of one large group of near copies grow less similar the larger the group is.
    """
    idf = np.log1p(1 / (np.maximum(df, 1) / max(n_docs, 1) + SMOOTH))
    return ((1 + np.log(tf)) * idf).astype(np.float32).astype(np.float64)


_TABLES: list = []


def _tables() -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) variates r and logs of such variates c, uniform beta, and a multiplier for each sample; the same everywhere."""
    if not _TABLES:
        rng = np.random.Generator(np.random.PCG64(20240229))
        r, c, beta = rng.gamma(2, 1, _TABLE), np.log(rng.gamma(2, 1, _TABLE)), rng.random(_TABLE)
        _TABLES.append((r.astype(np.float32), c.astype(np.float32), beta.astype(np.float32), rng.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * 2 + 1))
    return _TABLES[0]


def band_keys(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Improved consistent weighted sampling: a row of band keys for each text; text k has shingles bounds[k]:bounds[k+1], one at least."""
    r_table, c_table, beta_table, odd = _tables()
    n = len(bounds) - 1
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    log_w = np.log(weight).astype(np.float32)
    at = 0
    while at < n:  # as many texts at once as keep their shingles in the processor's cache
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 60_000, side="right")) - 1)
        lo, hi = bounds[at], bounds[to]
        x, lw, first, size = h[lo:hi], log_w[lo:hi], bounds[at:to] - lo, np.diff(bounds[at : to + 1])
        for band in range(BANDS):
            key = np.full(to - at, band, dtype=np.uint64)
            for j in range(band * ROWS, band * ROWS + ROWS):
                y = (x ^ (x >> np.uint64(29))) * odd[j]
                i, k = (y >> np.uint64(48)).astype(np.int64), ((y >> np.uint64(32)) & np.uint64(_TABLE - 1)).astype(np.int64)
                r, beta = r_table[i], beta_table[k]
                t = np.floor(lw / r + beta)
                a = c_table[k ^ (i & 255)] - r * (t - beta + 1)
                least = np.repeat(np.minimum.reduceat(a, first), size)
                hit = np.flatnonzero(a == least)
                hit = hit[np.searchsorted(hit, first)]  # the first of equal ones; shingles ascend
                key = mix(key ^ mix(x[hit] + t[hit].astype(np.int64).astype(np.uint64)))
            keys[at:to, band] = key
        at = to
    return keys


def signatures(docs: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that can have a near copy: id, words (hash of the word sequence), bands, shared (packed shingles), weight (of each) and total.

    Two texts of similarity ``threshold`` share that part of the weight of each; so a text whose shingles that occur
    in other documents weigh less than that has no near copy and is left out.
    """
    corpus = CorpusCounts(docs, id_col, text_col, keys_per_byte=0.16, key_bits=64 - int(_DF_SHIFT))

    def counted(h: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.unique(_df_key(h), return_counts=True)
        return np.append(np.uint64(0), keys), np.append((whole != 0).sum(), counts).astype(np.uint64)

    def count(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h, _, _, whole = shingles(texts)
        return counted(h, whole)

    def run(table: pa.Table, totals) -> pa.Table:
        texts = _texts(table)
        h, doc, tf, whole = shingles(texts)
        keys, counts = counted(h, whole)
        total = totals(keys, counts)
        df = total[np.searchsorted(keys, _df_key(h))]
        weight = weights(tf, df, int(total[0]))
        n = len(texts)
        sums, common = (np.bincount(doc, weights=x, minlength=n).astype(float) for x in (weight, weight * (df > 1)))
        rows = np.flatnonzero((whole != 0) & (common >= threshold * sums * (1 - 1e-9)))
        begin = np.searchsorted(doc, np.arange(n + 1))
        take = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in rows]) if len(rows) else np.zeros(0, np.int64)
        bounds = np.append(0, np.cumsum(np.diff(begin)[rows]))
        bands = band_keys(h[take], weight[take], bounds)
        shared, packed = [], []
        for k in rows:
            span = slice(begin[k], begin[k + 1])
            both = df[span] > 1
            shared.append(pack_sorted(h[span][both]))
            packed.append(squeeze(weight[span][both].astype("<f4").tobytes()))
        ids = table.column("id").combine_chunks().take(pa.array(rows))
        band_list = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
        return pa.table({"id": ids, "words": whole[rows].view(np.int64), "bands": band_list, "shared": pa.array(shared, pa.binary()), "weight": pa.array(packed, pa.binary()), "total": sums[rows]})

    return corpus.with_totals(corpus.replies(count), run, "id long, words long, bands array<long>, shared binary, weight binary, total double")


def similar(vectors: DataFrame, threshold: float):
    """A check of pairs (a, b) by the weighted Jaccard similarity of ``vectors`` (id, shared, weight, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            keep = []
            for i in range(batch.num_rows):
                x, y = unpack_sorted(cols["shared"][i]), unpack_sorted(cols["shared2"][i])
                wx, wy = (np.frombuffer(expand(cols[c][i]), "<f4") for c in ("weight", "weight2"))
                _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = float(np.minimum(wx[p], wy[q]).sum(dtype=np.float64))
                keep.append(both >= threshold * (cols["total"][i] + cols["total2"][i] - both) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        left = vectors.select(F.col("id").alias("a"), "shared", "weight", "total")
        right = vectors.select(F.col("id").alias("b"), F.col("shared").alias("shared2"), F.col("weight").alias("weight2"), F.col("total").alias("total2"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "shared", "weight", "total", "shared2", "weight2", "total2").mapInArrow(run, "a long, b long")

    return verify


def _similar_in_block(ids: np.ndarray, labels: np.ndarray, asking: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between the rows that ask and all rows of other labels; of links that connect the same classes, one is enough."""
    sizes = np.array([len(k) for k, _ in vectors])
    begin = np.append(0, np.cumsum(sizes))
    columns, which = np.unique(np.concatenate([k for k, _ in vectors]), return_inverse=True)
    weight = np.concatenate([w for _, w in vectors])
    some = np.flatnonzero(sizes)
    number = np.unique(labels, return_inverse=True)[1]
    forest, out = Forest(int(number.max()) + 1), []
    mark = np.zeros(len(columns))
    for i in np.flatnonzero(asking):
        span = slice(begin[i], begin[i + 1])
        mark[which[span]] = weight[span]
        both = np.zeros(len(ids))
        both[some] = np.add.reduceat(np.minimum(mark[which], weight), begin[:-1][some])
        mark[which[span]] = 0
        for j in np.flatnonzero((both >= threshold * (totals[i] + totals - both) - 1e-6) & (number != number[i])).tolist():
            if forest.join(int(number[i]), int(number[j])):
                out.append((int(ids[i]), int(ids[j])))
    return out


def _block_check(threshold: float):
    """For ``across``: similarities within a block of members with their vectors."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors = []
        for shared, packed in zip(table.column("shared").to_pylist(), table.column("weight").to_pylist(), strict=True):
            keys = unpack_sorted(shared)
            vectors.append((keys, np.frombuffer(expand(packed), "<f4").astype(float)))
        found = _similar_in_block(table.column("id").to_numpy(), table.column("label").to_numpy(), table.column("asks").to_numpy(), vectors, table.column("total").to_numpy(), threshold)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents that links of weighted Jaccard similarity ``threshold`` or more connect: id and class_id, a row for each id.

    Shingles are runs of five words; weights are those of ``weights`` over counts of all documents. The class id is the
    least id of the class; a document without near copies is its own class. Texts of equal words are one class.
    Null, empty and word-free texts are near nothing. Rows of one id count as one document. Rows with a null id have
    no name to be linked by: they count for the weights, and one row (null, null) stands for all of them. An empty table
    gives an empty result; other columns are not read. Ids must be integers.
    """
    small_batches(docs.sparkSession)
    clean_shuffles(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut_table(signatures(docs, threshold, "id", "text").where("id is not null"))
    same = cut(found.groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = found.select("id", "words").join(same, "words").select("id", "rep")
    # of texts of equal words one is compared; only ids and bands move here, vectors only where pairs need them
    rows = found.select("id", "words", "bands").join(same.select("rep", F.col("words").alias("w")), (F.col("id") == F.col("rep")) & (F.col("words") == F.col("w")))
    rows = cut(rows.select("id", F.explode("bands").alias("bucket")).select("bucket", "id").distinct())
    reps = found.select("id", "shared", "weight", "total")
    # first a few leaders of each bucket, which settles most members; then all that are not in one class yet
    labels, links = classes(rows, similar(reps, threshold), rounds=1)
    more = cut(across(rows, labels, reps, _block_check(threshold)))
    if not more.isEmpty():
        labels = connected(links.union(more))
    of = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("label"))
    least = of.groupBy("label").agg(F.min("id").alias("least"))
    of = cut(of.join(least, "label").groupBy("id").agg(F.min("least").alias("least")))
    return docs.select("id").distinct().join(of, "id", "left").select(F.col("id").alias(id_col), F.coalesce("least", "id").alias("class_id"))
