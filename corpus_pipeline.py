"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``, the last
returns packed pieces. Between stages, rows are written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, line_dedup, minhash_dedup, packing
from docloom.llm._sample import id_remainder
from docloom.session import cut_table, ensure_checkpoint_dir, read_table


#: Least posterior probability of a document's language.
LANGUAGE_SCORE = 0.5
#: Least share of the characters of a document's lines that must be left by line dedup: with less, 0.8 of it or more is a copy.
KEPT_SHARE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is sure: those without a letter and those below ``LANGUAGE_SCORE`` go. A null ``lang`` becomes the predicted one.

    Learns from the documents whose crc32(doc_id as text) mod 4 is not 2. Where none has a text and a language there is
    nothing to reject by, and all stay.
    """
    model = language_id.train(docs.where(id_remainder("doc_id", 4) != 2))
    if not model.languages:
        return docs
    found = language_id.identify(docs, model, carry=True)
    found = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE))
    return found.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines. A document of whose lines less than ``KEPT_SHARE`` stays is a copy of others: it goes, and no fragment of it stays."""
    found = line_dedup.dedup_lines(docs).where(F.col("kept_chars") >= KEPT_SHARE * F.col("chars"))
    row = F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType))
    return found.select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, that with the least id (null ids last), and of equal rows one.

    A row is known by a hash of its id and its text, so different texts under one id are different documents. Null, empty and
    word-free texts are near nothing, and equal rows of them are one; an empty table stays empty.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    near = cut_table(minhash_dedup.near_duplicates(keyed, id_col="key"))
    several = near.where("key <> class_id").select("class_id").distinct()
    members = near.join(several, "class_id", "left_semi").join(keyed.select("key", "id"), "key").groupBy("class_id", "key").agg(F.min("id").alias("id"))
    stays = members.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    near = members.join(stays, "class_id").where("key <> best.key").select("key", F.lit(True).alias("gone"))
    again = keyed.groupBy("key").count().where("count > 1").select("key", F.lit(False).alias("gone"))
    # a table, so that Spark knows its size; few documents have copies
    marks = cut_table(near.union(again)).groupBy("key").agg(F.max("gone").alias("gone"))
    out = keyed.join(marks, "key", "left_anti").select("row.*")
    return out.union(keyed.join(marks.where("not gone"), "key", "left_semi").dropDuplicates(["key", "id", "text"]).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Null, empty and word-free texts hold none and stay, equal rows share their fate, an empty table stays empty."""
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"), carry=True)
    return found.where(F.size("ranges") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents, packed into sequences of 4096: a row for each piece, see ``packing.pack_documents``.

    Null and empty texts are one token, the end; equal rows are packed each; an empty table has no pieces.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models and samplers have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
