"""The tables of a guideline platform, as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import read_table

ACTIVE = ("o",)


def guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = read_table(spark, sf_dir, "customer"), F.col("c_custkey")
    owner = F.when(key % 10 == 0, 1).when(key % 10 == 1, 2).otherwise(F.col("c_nationkey") + 1000).cast("long")
    disease = F.when(key % 3 == 0, F.concat(F.lit("Bệnh số "), key.cast("string")))
    kind = F.when(key % 4 == 0, "Trạm y tế").when(key % 4 == 1, " TRAM Y-TE").otherwise(F.col("c_mktsegment"))
    return c.select(key.alias("guideline_id"), F.col("c_name").alias("title"), disease.alias("disease"), F.col("c_mktsegment").alias("publisher"), kind.alias("specialty"), owner.alias("owner_id"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("guideline_id"), F.to_date("o_orderdate").alias("release_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("label"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of users: two administrators, one below the other; regions below them, nations below these."""
    root = spark.createDataFrame([(1, None, "admin", True), (2, 1, "admin", True)], "user_id long, parent_id long, role string, inherits boolean")
    key = F.col("r_regionkey")
    r = read_table(spark, sf_dir, "region").select((key + 100).cast("long").alias("user_id"), F.when(key % 2 == 0, 1).otherwise(2).cast("long").alias("parent_id"), F.when(key == 4, "health_station").otherwise("hospital").alias("role"), (key % 3 != 0).alias("inherits"))
    n = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("user_id"), (F.col("n_regionkey") + 100).cast("long").alias("parent_id"), F.when(F.col("n_nationkey") % 4 == 0, "health_station").otherwise("doctor").alias("role"), (F.col("n_nationkey") % 3 != 0).alias("inherits"))
    return root.union(r).union(n)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document, three children to a parent."""
    d = read_table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return s.withColumn("parent_pos", F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / 3)).cast("int"))


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``path``: the positions from the root down to a section."""
    up = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.array("pos"), lambda a, _: F.when(a[0] > 0, F.concat(F.array(F.floor((a[0] - 1) / 3).cast("int")), a)).otherwise(a))
    return sections(spark, sf_dir).withColumn("path", up)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of scanned pages: the lines of all documents of one kind, ten to a page; every third one is no text."""
    d = read_table(spark, sf_dir, "documents")
    s = d.select((F.col("doc_id") % 40).alias("version_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    top = F.col("pos") % 10 / 10.0 + 0.05
    return s.select("version_id", F.concat_ws("-", "doc_id", "pos").alias("id"), F.when(F.col("pos") % 3 == 2, "figure").otherwise("text").alias("type"), "text", F.when(F.col("pos") % 7 != 6, top).alias("top"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("version_id"), F.col("ts").alias("requested_at"), F.col("event_type").alias("status"))
