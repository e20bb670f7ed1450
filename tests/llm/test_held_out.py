"""What the models are worth on documents that they did not learn from, and how full packed sequences are."""

import pytest
from pyspark.sql import functions as F

from docloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("truth")).where("truth is not null")
    return QUERIES[name](spark, DATA).where("held_out").join(labels, "doc_id").toPandas()


@pytest.mark.parametrize(("name", "label", "precision", "recall"), [("op4_toxicity", "toxic", 0.9, 0.5), ("op6_quality", "quality", 0.95, 0.95)])
def test_labels(spark, name, label, precision, recall):
    """A few labels of the tables are turned round, so recall of the rarer label can't be full."""
    rows = held_out(spark, name, label)
    assert len(rows) > 50 and rows.truth.nunique() == 2
    assert rows.score.between(0, 1).all()
    assert rows.truth[rows.predicted == 1].mean() >= precision
    assert rows.predicted[rows.truth == 1].mean() >= recall
    # the share of pairs of unlike documents that stand in order
    ones, zeros = rows.score[rows.truth == 1].to_numpy(), rows.score[rows.truth == 0].to_numpy()
    assert (ones[:, None] > zeros[None, :]).mean() >= 0.75


def test_languages(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = QUERIES["op9_language_id"](spark, DATA).where("held_out").join(truth, "doc_id").toPandas()
    assert len(rows) > 100 and rows.lang.nunique() > 3
    assert (rows.lang == rows.lang_pred).mean() >= 0.98


def test_sequences_are_full(spark):
    """No packing can do with fewer sequences than the sum of lengths by the capacity; this one takes at most 3 % more."""
    rows = QUERIES["op5_packing"](spark, DATA).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096
    assert rows.sequence_id.nunique() <= 1.03 * rows.length.sum() / 4096 + 1
