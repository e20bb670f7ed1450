"""Each operator on odd tables: nulls in any column, empty and very long texts, equal rows, clashing names, no rows."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, line_dedup, lm_scoring, minhash_dedup, packing, quality, token_counts, topk_search, toxicity

#: Names that operators use themselves.
NAMES = "id long, rest string, row int, block int, rows int, bytes int, score double, n_lines int, keep int, line string, number int, n_words int, ranges int, items int, n_tokens int, packer int, order int, label string, class_id string, bucket int, key int"


@pytest.fixture(scope="module")
def docs(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(1, words), (1, words), (2, words), (3, None), (4, ""), (5, " \n!"), (6, "x" * 50_000 + " " + "y z " * 100_000), (7, "日本語のテキスト" * 500), (None, words), (None, None), (8, "tie"), (9, "tie")]
    values = tuple(None for _ in NAMES.split(","))
    return spark.createDataFrame([(i, t, "en" if i != 2 else None, *values) for i, t in texts], f"doc_id long, text string, lang string, {NAMES}")


@pytest.fixture(scope="module")
def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 3 == 0).cast("int").alias("quality")).distinct()


def row_for_row(docs, run, id_col="doc_id"):
    got = run(docs)
    assert sorted(str(r[id_col]) for r in got.select(id_col).collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    assert run(docs.limit(0)).count() == 0
    return got


def test_lm_scoring(docs):
    got = row_for_row(docs, lm_scoring.score_documents)
    assert len({r["log_score"] for r in got.where("doc_id in (1, 2)").collect()}) == 1  # equal rows see each other
    assert {r["mean_log_score"] for r in got.where("doc_id in (3, 4, 5)").collect()} == {None}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(None, "two three"), (1, "one two three four five six seven eight nine ten"), (1, "TIE"), (2, "")], "item_id long, text string")
    got = row_for_row(docs, lambda d: decontaminate.contamination_report(decontaminate.find_contamination(d, items)))
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in got.collect()}
    assert rows[1] == (10, 1) and rows[8] == (1, 1) and rows[3] == (0, 0) and rows[6] == (0, 0)
    assert row_for_row(docs, lambda d: decontaminate.find_contamination(d, items.limit(0), carry=True).select("row.doc_id")).count() == docs.count()
    whole = sorted(map(repr, decontaminate.find_contamination(docs, items, carry=True).select("row.doc_id", "n_words", "ranges", "items").collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate, "PART_BYTES", 20)
        assert sorted(map(repr, decontaminate.find_contamination(docs, items, carry=True).select("row.doc_id", "n_words", "ranges", "items").collect())) == whole


def test_decontamination_of_repeated_words():
    for pattern in ("same ", "a b ", "one two three four five six seven "):
        text = (pattern * 50_000).strip()
        items = [(1, text), (2, pattern * 20), (3, pattern * 3), (4, "other words that are nowhere")]
        began = time.time()
        index = decontaminate.Index(items, 10)
        ranges, found = index.find(decontaminate.normal_words(text))
        assert ranges == [(0, len(text.split()))] and found == [1, 2, 3]
        assert time.time() - began < 8  # it grew with the square: minutes


def test_rare_bytes_do_not_underflow():
    pieces = [bytes([b]) for b in range(256)]
    p = np.full((len(pieces), 2), 1e-12)
    p[:, 1] = 1e-11
    model = language_id.LanguageModel(["a", "b"], p, np.zeros(2), pieces)
    got = model.log_likelihoods(pa.array(["\U0001f600" * 7, "\U0001f600" * 8, "x"]))
    assert np.isfinite(got).all() and (got[:, 1] > got[:, 0]).all()
    assert abs(got[0, 0] - 29 * np.log(1e-12)) < 1e-6  # 28 bytes and the space before
    fitted = language_id.fit(pa.array(["\U0001f600\U0001f64f" * 4 + " plain words"] * 3), ["x", "x", "y"], pieces, {"x": 2, "y": 1}, smooth=1e-9)
    assert np.isfinite(fitted.p).all() and (fitted.p > 0).all()


def test_models(docs, labels):
    for m in (toxicity, quality):
        got = row_for_row(docs, lambda d, m=m: m.score_documents(d, m.train(docs, labels)))
        assert all(0 <= r["score"] <= 1 for r in got.collect())
    model = language_id.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in row_for_row(docs, lambda d: language_id.identify(d, model)).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[6] == got[7] == "en"
    assert language_id.identify(docs, model, carry=True).select("row.*").columns == docs.columns


def test_tokens_and_packing(docs):
    row_for_row(docs, token_counts.count_tokens)
    pieces = packing.pack_documents(docs, capacity=64, open_bins=4).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in docs.select("doc_id").collect()}
    places = [(r["sequence_id"], r["offset"]) for r in pieces]
    assert len(places) == len(set(places))
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_near_duplicates_and_lines(docs):
    got = {r[0]: r[1] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, None: None}
    lines = line_dedup.dedup_lines(docs)
    assert lines.select("row.*").columns == docs.columns
    row_for_row(docs, lambda d: line_dedup.line_report(line_dedup.dedup_lines(d)))
    kept = {r["row"]["doc_id"]: r["n_kept"] for r in lines.collect()}
    assert kept[1] == 1 and kept[2] == 0 and kept[8] == 1 and kept[9] == 0 and kept[None] in (0, 1)


def test_search_of_few_and_equal_vectors(spark):
    rows = [(i, [0.5, 0.5], 3) for i in range(4)] + [(9, [1.0], 4), (None, [1.0, 1.0], 5), (10, [], 6)]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>, norm int"), "vec_id", "e")
    got = sorted(map(tuple, topk_search.top_k(v, v.where("id in (0, 9)"), k=2).collect()))
    assert got == [(0, 1, 1, 2 * 128 * 128), (0, 2, 2, 2 * 128 * 128)]
