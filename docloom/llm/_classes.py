"""Classes of items that verified links connect, from buckets of items that may be alike.

No bucket is ever gathered and no bucket emits all its pairs. In each round the members of a bucket meet a few
leaders: those members whose hash falls into the round's slice of the unit interval. Slices grow fourfold from round
to round until they have covered everything, so any two members of a bucket that are not yet in one class meet in the
end; buckets whose members all are in one class leave at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

#: Leaders that a bucket has in the first round, on average; smaller buckets have all members as leaders.
LEADERS = 6


class Forest:
    """Union-find over numbers from 0; a root is the least of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition's edges, each node (but roots) and the least node that it is connected to."""
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not edges:
        return
    ends = np.concatenate([np.concatenate(c) for c in zip(*edges, strict=True)])
    nodes, number = np.unique(ends, return_inverse=True)
    forest, half = Forest(len(nodes)), len(ends) // 2
    for x, y in zip(number[:half].tolist(), number[half:].tolist(), strict=True):
        forest.join(x, y)
    roots = np.array([forest.root(x) for x in range(len(nodes))])
    below = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[roots[below]])], names=["id", "root"])


#: Edges that one partition connects at once.
EDGES = 500_000


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``label`` of every end of a link; ends have one label if links connect them.

    In each round, partitions of at most about ``EDGES`` edges find their own trees. A node goes to the least root that it
    has in any partition, and its other roots are edges of the next round; a new hash deals the edges each time.
    """
    edges, labels = cut(links.select("a", "b").where("a <> b")), None
    for k in range(rounds):
        n = edges.count()
        if not n:
            break
        dealt = edges.repartition(-(-n // EDGES), F.xxhash64(F.lit(k), F.greatest("a", "b") if k % 2 else F.least("a", "b")))
        roots = dealt.mapInArrow(_local_roots, "id long, root long").groupBy("id").agg(F.min("root").alias("now"), F.collect_set("root").alias("roots"))
        roots = cut(roots)
        edges = cut(roots.select(F.col("now").alias("a"), F.explode("roots").alias("b")).where("a <> b").distinct())
        moves = roots.select(F.col("id").alias("was"), "now")
        if labels is None:
            labels = moves.select(F.col("was").alias("id"), F.col("now").alias("label"))
        else:
            old = labels.join(moves, F.col("label") == F.col("was"), "left").select("id", F.coalesce("now", "label").alias("label"))
            fresh = moves.join(labels.select(F.col("id").alias("was")), "was", "left_anti").select(F.col("was").alias("id"), F.col("now").alias("label"))
            labels = cut(old.union(fresh))
    else:
        raise RuntimeError("the links did not shrink to labels")
    if labels is None:
        return links.sparkSession.createDataFrame([], "id long, label long")
    return labels.union(labels.select(F.col("label").alias("id"), "label").distinct()).dropDuplicates(["id"])


def classes(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], leaders: int = LEADERS, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``id`` and ``label`` of all items that ``verify`` links to another; items without a link are not returned. And the links.

    ``rows`` has (bucket, id), each pair once; ``verify`` takes pairs (a, b) and returns those that are links. Every two items
    that share a bucket are verified, or are in one class already, unless ``rounds`` ends this earlier.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    u = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40)) / float(1 << 40)
    live = cut(rows.join(sizes, "bucket").select("bucket", "id", "n", u.alias("u")))
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, label long")
    low = turn = 0
    while not live.isEmpty():
        high = 4 * low + leaders
        labelled = live.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        place = F.col("u") * F.col("n")
        # small buckets: all members lead; the slice of a large one is a share of the unit interval
        leads = (F.when(F.col("n") <= leaders, low == 0).otherwise((place >= low) & (place < high)))
        chosen = labelled.where(leads).groupBy("bucket").agg(F.collect_list(F.struct(F.col("id").alias("id"), F.col("label").alias("label"))).alias("leaders"))
        met = labelled.join(chosen, "bucket").select("id", F.expr("transform(filter(leaders, x -> x.label <> label), x -> x.id)").alias("near"))
        met = met.where(F.size("near") > 0).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        pairs = met.select(F.col("id").alias("a"), F.explode("near").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = cut(verify(pairs))
        if not found.isEmpty():
            links = cut(links.union(found))
            labels = connected(links)
        low, turn = high, turn + 1
        if turn == rounds:
            break
        open_ = live.where(F.col("n") > max(low, leaders))  # others have met all their members
        mixed = open_.join(labels, "id", "left").groupBy("bucket").agg(F.min(F.coalesce("label", "id")).alias("x"), F.max(F.coalesce("label", "id")).alias("y")).where("x <> y")
        live = cut(open_.join(mixed, "bucket", "left_semi"))
    return labels, links


#: Members of a bucket that one task compares with as many others at once.
BLOCK = 512


def across(rows: DataFrame, labels: DataFrame, payload: DataFrame, run: Callable[[pa.Table], pa.Table], block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that ``run`` finds between classes that still share a bucket.

    In each bucket, members outside its largest class ask all members. Buckets are cut by a hash into blocks of about
    ``block`` askers and members; ``run`` gets a block's members: id, label, asks and the columns of ``payload`` (by id).
    """
    labelled = rows.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    per_class = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    buckets = per_class.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("n") - F.max("n")).alias("asking")).where("classes > 1")
    cuts = buckets.select("bucket", "main", F.ceil(F.col("asking") / block).cast("int").alias("s"), F.ceil(F.col("n") / block).cast("int").alias("t"))
    open_ = cut(labelled.join(cuts, "bucket"))
    place = F.xxhash64(F.lit(13), "id")
    asks = open_.where("label <> main").withColumns({"s": F.pmod(place, F.col("s")).cast("int"), "t": F.explode(F.sequence(F.lit(0), F.col("t") - 1)), "asks": F.lit(True)})
    members = open_.withColumns({"t": F.pmod(place, F.col("t")).cast("int"), "s": F.explode(F.sequence(F.lit(0), F.col("s") - 1)), "asks": F.lit(False)})
    names = ["bucket", "s", "t", "id", "label"]
    # a bucket of one block has its askers among its members
    both = asks.select(*names, "asks").union(members.select(*names, "asks")).groupBy(*names).agg(F.max("asks").alias("asks"))
    return both.join(payload, "id").groupBy("bucket", "s", "t").applyInArrow(run, "a long, b long")
