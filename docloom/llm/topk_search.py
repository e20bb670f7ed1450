"""Exact top-k search by inner product over buckets of vectors of similar length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_table

#: Lengths of one bucket differ by this factor at most.
RATIO = 1.15
#: Bytes of candidates, and of queries, that one task compares at once; and the fewest vectors of each, however long.
BLOCK_BYTES, LEAST_BLOCK = 16 << 20, 256
#: Pairs of a bucket and a block of queries up to which their list is sent to every executor.
PAIRS = 1_000_000
#: From this local cosine threshold on, single coordinates prune better than lengths.
COORDINATE_FROM = 0.35
_SLACK = 1e-9


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``id``, ``v`` (floor of ``scale`` times each component, as double), ``norm`` and ``dim``; rows with null or non-finite components go."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    out = df.where(x.isNotNull() & F.col(id_col).isNotNull()).where(~bad).select(F.col(id_col).alias("id"), v.alias("v"))
    return out.withColumns({"norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)), "dim": F.size("v")})


def block_rows(dim: int) -> int:
    """Vectors of so many doubles that make a block."""
    return max(LEAST_BLOCK, BLOCK_BYTES // (8 * max(dim, 1)))


def deal(classes: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Blocks for classes of queries (dim, lowest, n): dim, lowest, the number of the first block, and how many.

    Classes of one dimension that follow each other share a block while they fit into it; one that is larger has blocks of its own.
    """
    out, block, room, before = [], -1, 0, None
    for dim, lowest, n in sorted(classes):
        size = block_rows(dim)
        if n > size:
            blocks = -(-n // size)
            out.append((dim, lowest, block + 1, blocks))
            block, room = block + blocks, 0
        else:
            if dim != before or n > room:
                block, room = block + 1, size
            room -= n
            out.append((dim, lowest, block, 1))
        before = dim
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))[:k]


def search_block(queries: tuple[np.ndarray, np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The ``k`` best of a block for each query, given as (ids, vectors, least score that can still count) and (ids, vectors, norms).

    The least score gives a threshold for the cosine in this block. A high one prunes by the query's largest
    coordinate: a unit vector that close to the query has it within a narrow range. A low one prunes by length:
    shorter candidates than score / query length go. What is left is verified by its products.
    """
    ids, v, norms = block
    order = np.argsort(-norms, kind="stable")
    ids, v, norms = ids[order], v[order], norms[order]
    unit = v / np.maximum(norms, 1e-300)[:, None]
    longest = norms[0]
    for q, x, least in zip(*queries, strict=True):
        length = np.sqrt(x @ x)
        rows = slice(None)
        if least > 0:
            bound = least * (1 - _SLACK)
            if length * longest < bound:
                continue
            cosine = min(1.0, bound / (length * longest))
            n = int(np.searchsorted(-norms, -bound / length, side="right"))
            rows = slice(0, n)
            if cosine >= COORDINATE_FROM:
                u = x / length
                f = int(np.abs(u).argmax())
                away = np.sqrt((1 - cosine * cosine) * (1 - u[f] * u[f])) + 1e-9
                if u[f] > 0:
                    rows = np.flatnonzero(unit[:n, f] >= u[f] * cosine - away)
                else:
                    rows = np.flatnonzero(unit[:n, f] <= u[f] * cosine + away)
        scores = v[rows] @ x
        near, others = ids[rows], scores
        ok = (near != q) & (others >= least)
        near, others = near[ok], others[ok]
        if len(near):
            at = _best(near, others, k)
            yield q, near[at], others[at]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query the ``k`` candidates with the largest inner product: query_id, rank, vec_id, score.

    Both frames come from ``integer_vectors``. A query never meets its own id. Ties go to the smaller id. A query
    with fewer candidates gets all of them; vectors of another dimension are no candidates. Repeated candidate ids
    count as separate rows. Queries of one id are one query, by the least of their vectors.

    Buckets hold vectors of one dimension and similar length, and large ones are split by a hash of the id into
    blocks of about ``BLOCK_BYTES``. First each query meets the longest vectors alone, which bounds its k-th score from
    below; then it goes only to the buckets whose longest vector can still reach that score. Queries that reach down to
    the same bucket, or to neighbours of it, share their blocks: a block of candidates meets only blocks whose queries, or their
    neighbours, ask for it. Bounds are a table in the shared checkpoint folder, so the first search runs once.
    """
    spark = vectors.sparkSession
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(RATIO)))).otherwise(-1_000_000).cast("int")
    data = vectors.withColumn("bucket", bucket)
    # one row for each dimension and length class: a few thousand at most, whatever the number of vectors
    sizes = data.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    splits = {(r["dim"], r["bucket"]): max(1, -(-r["n"] // block_rows(r["dim"]))) for r in sizes}
    queries = queries.groupBy("id").agg(F.min(F.struct("v", "norm", "dim")).alias("q")).select("id", "q.*")
    query_blocks = [(r["dim"], max(1, -(-r["n"] // block_rows(r["dim"])))) for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    buckets = spark.createDataFrame([(r["dim"], r["bucket"], float(r["longest"]), splits[r["dim"], r["bucket"]]) for r in sizes], "dim int, bucket int, longest double, splits int")
    dealt = F.xxhash64(F.lit(3), "id")
    by_dim = spark.createDataFrame(query_blocks, "dim int, blocks int")

    def blocks_of(chosen: DataFrame, asked: DataFrame, n_blocks: int) -> DataFrame:
        """Candidates of the chosen buckets, each sent to its block for every block of queries that asks the bucket."""
        asking = asked.select("dim", "bucket", "qblock").distinct().groupBy("dim", "bucket").agg(F.collect_list("qblock").alias("qblocks"))
        asking = chosen.join(asking, ["dim", "bucket"])
        if len(sizes) * n_blocks <= PAIRS:
            asking = F.broadcast(asking)
        out = data.drop("norm").join(asking, ["dim", "bucket"])
        out = out.withColumn("split", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("splits")).cast("int"))
        return out.withColumn("qblock", F.explode("qblocks")).select(*(F.col(c).alias(c) for c in ("dim", "bucket", "split", "qblock", "id", "v")))

    def compare(asked: DataFrame, chosen: DataFrame, n_blocks: int) -> DataFrame:
        """asked: queries with ``least``, their block, and the buckets they go to."""
        candidates = blocks_of(chosen, asked, n_blocks)
        asked = asked.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        # new names for columns that the candidates also come from
        asked = asked.select(*(F.col(c).alias(c) for c in ("dim", "bucket", "split", "qblock", "id", "v", "least")))

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows and right.num_rows:
                dim = key[0].as_py()

                def matrix(t: pa.Table) -> np.ndarray:
                    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)

                x, y = matrix(left), matrix(right)
                for qid, ids, scores in search_block((left.column("id").to_numpy(), x, left.column("least").to_numpy()), (right.column("id").to_numpy(), y, np.sqrt((y * y).sum(axis=1))), k):
                    rows.append((np.full(len(ids), qid), ids, scores))
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2].astype(np.int64)})

        keys = ["dim", "bucket", "split", "qblock"]
        found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # the longest vectors of each dimension, a block of them at least
    seeds, have = [], {}
    for r in sorted(sizes, key=lambda r: -r["bucket"]):
        if have.get(r["dim"], 0) < block_rows(r["dim"]):
            have[r["dim"]] = have.get(r["dim"], 0) + r["n"]
            seeds.append((r["dim"], r["bucket"], splits[r["dim"], r["bucket"]]))
    seed = spark.createDataFrame(seeds, "dim int, bucket int, splits int")
    first = queries.join(F.broadcast(by_dim), "dim").withColumn("qblock", F.pmod(dealt, F.col("blocks")).cast("int")).drop("blocks")
    first = first.withColumn("least", F.lit(float("-inf"))).join(F.broadcast(seed), "dim")
    found = compare(first, seed, sum(n for _, n in query_blocks))
    bounds = cut_table(found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bound")))

    # a few thousand buckets at most in all, as above
    ladder = buckets.groupBy("dim").agg(F.collect_list(F.struct("bucket", "longest", "splits")).alias("ladder"))
    asked = queries.join(bounds, "id", "left").withColumn("least", F.coalesce("bound", F.lit(float("-inf")))).join(F.broadcast(ladder), "dim")
    asked = asked.withColumn("asks", F.filter("ladder", lambda b: F.col("norm") * b["longest"] * (1 + _SLACK) >= F.col("least"))).drop("ladder", "bound")
    asked = asked.withColumn("lowest", F.array_min(F.transform("asks", lambda b: b["bucket"])))
    classes = [(r["dim"], r["lowest"], r["n"]) for r in asked.where("lowest is not null").groupBy("dim", "lowest").agg(F.count("*").alias("n")).collect()]
    blocks = deal(classes)
    places = spark.createDataFrame(blocks, "dim int, lowest int, first int, blocks int")
    asked = asked.join(F.broadcast(places), ["dim", "lowest"]).withColumn("qblock", (F.col("first") + F.pmod(dealt, F.col("blocks"))).cast("int"))
    asked = asked.withColumn("ask", F.explode("asks")).select("dim", "id", "v", "least", "qblock", "ask.bucket", "ask.splits")
    out = compare(asked, buckets.select("dim", "bucket", "splits"), max((at + n for _, _, at, n in blocks), default=0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
