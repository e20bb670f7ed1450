"""Target-distribution importance resampling over an integer word dictionary: hashed n-gram buckets weigh documents towards a target."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._counts import pack_counts, unpack_counts
from docloom.llm._text import Words, free_memory, small_batches, span_strings, steps, text_bytes
from docloom.session import clean_shuffles, cut_table

#: Bytes of text whose words are numbered together; a longer text is numbered by itself.
BLOCK_BYTES = 5 << 20
#: Buckets up to which their gains are sent to every executor; beyond that they are joined.
SENT_BUCKETS = 1 << 20
_BLOCK = "target boolean, ids array<{kind}>, sizes array<int>, words array<string>, counts array<int>, codes binary"


def _numbered(rows: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """One row: the ids of documents, their numbers of words, the distinct words, how often each occurs, and the text as numbers of words.

    Frequent words have small numbers, which makes the text as numbers about half as large as its own bytes compressed.
    """
    texts = pa.concat_arrays([r.column(2).cast(pa.large_string()) for r in rows])
    w = Words(texts)
    _, first, which, counts = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    words = span_strings(w.data, w.start[first[order]], w.end[first[order]])
    row = [rows[0].column(0)[:1], [pa.concat_arrays([r.column(1) for r in rows]).to_pylist()], [w.counts.tolist()], [words], [counts[order].tolist()], [pack_counts(number[which])]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(row, schema, strict=True)], schema=schema)


def number_words(docs: DataFrame) -> DataFrame:
    """Blocks of the rows (target, id, text), each with its own dictionary; no row moves and none is split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, flag = [], 0, None
        for batch in batches:
            edges = np.append(np.flatnonzero(np.diff(np.asarray(batch.column(0)).astype(np.int8))) + 1, batch.num_rows)
            for part in (batch.slice(a, b - a) for a, b in zip(np.append(0, edges[:-1]).tolist(), edges.tolist(), strict=True)):
                for step in steps(part, "text", BLOCK_BYTES):
                    n, of = len(text_bytes(step.column(2))[0]), step.column(0)[0].as_py()
                    if held and (size + n > BLOCK_BYTES or of != flag):
                        yield _numbered(held, schema)
                        held, size = [], 0
                    held, size, flag = [*held, step], size + n, of
        if held:
            yield _numbered(held, schema)
        free_memory()

    kind = docs.schema["id"].dataType.simpleString()
    spark_schema = docs.sparkSession.createDataFrame([], _BLOCK.format(kind=kind)).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark_schema)
    return docs.mapInArrow(run, spark_schema)


def _local_tuples(codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of ``n`` numbers inside texts (rows), which of them each run is, and the text of each run."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    key = codes[at].astype(np.uint64)
    for k in range(1, n):  # pairs of a number and a number of a word, told apart step by step
        _, key = np.unique(key * np.uint64(int(codes.max(initial=0)) + 1) + codes[at + k], return_inverse=True)
        key = key.astype(np.uint64)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return codes[at[first][:, None] + np.arange(n)] if len(at) else np.zeros((0, n), np.int64), which, doc[at]


def _codes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return unpack_counts(row["codes"]).astype(np.int64), np.array(row["sizes"], dtype=np.int64)


def score_documents(docs: DataFrame, target: DataFrame, min_n: int = 1, max_n: int = 1, buckets: int = 10_000, seed: str = "2024:", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight and score of every row of ``docs``.

    Features are all runs of ``min_n`` to ``max_n`` words of a text, repeats counted; a feature's bucket is the crc32 of its words, joined by a
    space, modulo ``buckets``. A bucket's gain is floor(1000 ln) of its smoothed share in the target over that in the documents, and a
    document's weight the sum of the gains of its features. The score adds Gumbel noise drawn by a hash of ``seed`` and the id.

    Words become integers: each block of documents numbers its own, and what blocks have in common meets in one dictionary that
    gives every distinct word an id. Longer runs are tuples of these ids; each distinct tuple is put back into bytes and
    hashed once, whatever its count, and its bucket's gain goes back to the blocks that have it. A word that
    is everywhere costs one row a block, and all joins have one row of the dictionary's side for a key.

    Null and word-free texts have no features and weight 0; repeated rows count and are scored each; a null id draws its noise like an empty one;
    empty tables give an empty result or gains of the other table alone; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clean_shuffles(spark)
    rows = [docs.select(F.lit(False).alias("target"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))]
    rows.append(target.select(F.lit(True).alias("target"), F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), F.col(target_text_col).alias("text")))
    blocks = cut_table(rows[0].unionAll(rows[1]).transform(number_words).withColumn("block", F.monotonically_increasing_id()))
    of_target = lambda flag: F.sum(F.when(F.col("target") == flag, F.col("n")).otherwise(0))
    own = blocks.select("block", "target", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w"))
    # new names for columns that the blocks also have
    own = own.select(*(F.col(c).alias(c) for c in ("block", "target", "k")), F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("n"))
    dictionary = own.groupBy("word").agg(of_target(False).alias("s"), of_target(True).alias("t"))
    dictionary = cut_table(dictionary.withColumns({"wid": F.monotonically_increasing_id(), "bucket": F.crc32(F.col("word").cast("binary")) % buckets}))
    grams, hashed = None, []
    if min_n == 1:
        hashed.append(dictionary.select("bucket", "s", "t"))
    if max_n > 1:
        grams, more = _longer(blocks, own, dictionary, max(min_n, 2), max_n, buckets, of_target)
        hashed.append(more.select("bucket", "s", "t"))
    sums = hashed[0] if len(hashed) == 1 else hashed[0].unionAll(hashed[1])
    sums = cut_table(sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))  # a row for each bucket at most
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(total[0] + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(total[1] + buckets)))
    gains = sums.select("bucket", F.floor(F.log(ratio) * 1000).cast("int").alias("gain"))
    gains = F.broadcast(gains) if buckets <= SENT_BUCKETS else gains
    back = []
    if min_n == 1:
        gain_of = dictionary.where("s > 0").join(gains, "bucket").select("word", "gain")
        back.append(own.where("not target").join(gain_of, "word").select("block", F.lit(1).alias("size"), "k", "gain"))
    if max_n > 1:
        gain_of = more.where("s > 0").join(gains, "bucket").select("gram", "gain")
        back.append(grams.where("not target").join(gain_of, "gram").select("block", F.size("gram").alias("size"), "k", "gain"))
    back = back[0] if len(back) == 1 else back[0].unionAll(back[1])

    # the gains of a block's distinct runs in the order of its own numbers; a table, so that what was joined leaves the disk
    back = back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "k", "gain"))).alias("x")).select(F.col("block").alias("of"), F.col("x.gain").alias("gains"))
    back = cut_table(back)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                codes, sizes = _codes(row)
                gains, at, weight = np.array(row["gains"] or [], dtype=np.int64), 0, np.zeros(len(sizes), dtype=np.int64)
                for n in range(min_n, max_n + 1):
                    which, doc = (codes, np.repeat(np.arange(len(sizes)), sizes)) if n == 1 else _local_tuples(codes, sizes, n)[1:]
                    own = int(which.max(initial=-1)) + 1
                    weight += np.bincount(doc, weights=gains[at : at + own][which], minlength=len(sizes)).astype(np.int64)
                    at += own
                features = sum(np.maximum(sizes - n + 1, 0) for n in range(min_n, max_n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(sizes), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])
                free_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    both = blocks.where("not target").select("block", "ids", "sizes", "codes").join(back, F.col("block") == F.col("of"), "left").select("ids", "sizes", "codes", "gains")
    weighed = both.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + F.floor(F.log(-F.log(u)) * -1000)).alias("score"))


def _longer(blocks: DataFrame, own: DataFrame, dictionary: DataFrame, min_n: int, max_n: int, buckets: int, of_target) -> tuple[DataFrame, DataFrame]:
    """Runs of two and more words as tuples of dictionary ids: those of each block with its numbers, and all distinct ones with buckets and counts."""
    named = own.join(dictionary.select("word", "wid"), "word").select("block", "k", "wid")

    def tuples(left: pa.Table, right: pa.Table) -> pa.Table:
        free_memory()
        row = left.to_pylist()[0]
        codes, sizes = _codes(row)
        k, wid = right.column("k").to_numpy(), right.column("wid").to_numpy()
        of = np.zeros(int(k.max(initial=-1)) + 1, dtype=np.int64)
        of[k] = wid
        out = []
        for n in range(min_n, max_n + 1):
            local, which, _ = _local_tuples(codes, sizes, n)
            gram = pa.ListArray.from_arrays(pa.array(np.arange(len(local) + 1, dtype=np.int32) * n), pa.array(of[local].ravel()))
            out.append(pa.table({"block": np.full(len(local), row["block"]), "target": pa.array([row["target"]] * len(local), pa.bool_()), "k": np.arange(len(local), dtype=np.int32), "gram": gram, "n": np.bincount(which, minlength=len(local)).astype(np.int64)}))
        return pa.concat_tables(out)

    grams = blocks.select("block", "target", "sizes", "codes").groupBy("block").cogroup(named.groupBy("block")).applyInArrow(tuples, "block long, target boolean, k int, gram array<long>, n long")
    grams = cut_table(grams)
    distinct = grams.groupBy("gram").agg(of_target(False).alias("s"), of_target(True).alias("t"))
    distinct = cut_table(distinct.withColumn("gid", F.monotonically_increasing_id()))
    words = distinct.select("gid", F.posexplode("gram").alias("i", "wid")).join(dictionary.select("wid", "word"), "wid")
    texts = words.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x")).select("gid", F.concat_ws(" ", F.col("x.word")).alias("text"))
    return grams, cut_table(distinct.join(texts, "gid").select("gram", "s", "t", (F.crc32(F.col("text").cast("binary")) % buckets).alias("bucket")))


def resample(scored: DataFrame, min_words: int = 20, percent: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with ``rank``: of the rows with at least ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn by the highest scores.

    Ties go to the smaller id, null ids first; equal rows are ranked in any order. Rows are dealt out by ranges of their scores and sorted where they are;
    only the number of rows in each range goes through the driver.
    """
    columns = scored.columns
    may = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    spread = scored.select(*columns, may.alias("may"), F.when(may, F.col("score")).alias("key"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("may").desc(), F.col("key").desc(), F.col(id_col), F.col("tie")]
    ranged = cut_table(spread).repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a row in its range, from an id that counts rows within a partition
    placed = cut_table(ranged.select(*columns, "may", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("number")))
    sizes = sorted((r[0], r[1]) for r in placed.where("may").groupBy("range").count().collect())
    drawn = sum(n for _, n in sizes) * percent // 100
    before, offsets = 0, []
    for r, n in sizes:
        offsets.append((r, before))
        before += n
    offsets = scored.sparkSession.createDataFrame(offsets, "range int, before long")  # a row for each range
    rank = F.col("before") + F.col("number") + 1
    return placed.join(F.broadcast(offsets), "range", "left").select(*columns, F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))
