"""Operators against DuckDB, libraries and brute force on small tables; and the odd rows that each must take."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, line_dedup, lm_scoring, minhash_dedup, packing, quality, token_counts, topk_search, toxicity
from docloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, id long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and word-free texts, a long text, copies, and columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", "!!! ...", base, base, base.upper() + "!", base + "\n" + base, "x " * 50_000, "日本語 テキスト é", "<|endoftext|> a  b\n"]
    return spark.createDataFrame([(i, t, "en", -i, "z") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = c.execute(ORACLE_SQL[name])
    at = [x[0] for x in cursor.description]
    assert sorted(repr([r[k] for k in columns]) for r in df.collect()) == sorted(repr([r[at.index(k)] for k in columns]) for r in cursor.fetchall())


def test_token_counts_and_packing_match_the_library(spark, odd):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(odd.select(F.col("doc_id") - 100, "text"))
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    t = Tokenizer.from_file(token_counts.default_tokenizer())
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs).collect()}
    for k, x in texts.items():
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert got[k] == (len(x.encode()), n, n > 1024)
    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs, capacity=256, open_bins=16).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    for k, x in texts.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")
        for p, at in enumerate(range(0, len(ids), 256)):
            r = pieces.pop((k, p))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))
    assert not pieces
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        ends = [0]
        for at, n in sorted(spans):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 256


def test_banded_edit_distance():
    random.seed(1)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(4000):
        a, b = ("".join(random.choice("aé") for _ in range(random.randint(0, 9))) for _ in range(2))
        assert line_dedup.within(a, b, 2) == (distance(a, b) <= 2)


def test_line_dedup(spark, odd, none):
    line = "a line of this length is long enough for edits"
    docs = spark.createDataFrame([(1, line + "\nshort\n\n"), (2, line.replace("edits", "edit") + "\nnew\nshort"), (3, None), (4, "short"), (None, line)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["row"]["text"], r["n_lines"], r["n_kept"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (line + "\nshort\n\n", 2, 2), 2: ("new", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0), None: (line, 1, 1)}
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(none).count() == 0


def test_near_duplicates(spark, odd, none):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    one = [random.choice(words) for _ in range(200)]
    other = one[:100] + ["changed"] + one[101:]
    docs = spark.createDataFrame([(5, " ".join(one)), (3, " ".join(other)), (9, " ".join(random.choice(words) for _ in range(200))), (7, " ".join(one).upper())], "doc_id long, text string")
    assert {r[0]: r[1] for r in minhash_dedup.near_duplicates(docs).collect()} == {5: 3, 3: 3, 7: 3, 9: 9}
    got = {r[0]: r[1] for r in minhash_dedup.near_duplicates(odd).collect()}
    assert [got[k] for k in range(6)] == [0, 1, 2, 3, 3, 3] and minhash_dedup.near_duplicates(none).count() == 0


def test_models_take_odd_rows(spark, odd, none):
    model = language_id.train(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == "en"
    assert language_id.identify(none, language_id.train(none)).count() == 0
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    for m in (toxicity, quality):
        scores = [r["score"] for r in m.score_documents(odd, m.train(odd, labels)).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
        assert m.score_documents(none, m.train(none, labels.limit(0))).count() == 0


def test_lm_and_decontamination_take_odd_rows(spark, odd, none):
    assert lm_scoring.score_documents(odd).count() == odd.count() and lm_scoring.score_documents(none).count() == 0
    items = spark.createDataFrame([(1, "Two three FOUR"), (2, None), (3, "")], "item_id long, text string")
    found = decontaminate.find_contamination(odd, items)
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate.contamination_report(found).collect()}
    assert got[3] == (3, True) and got[6] == (6, True) and got[0] == (0, False)
    assert (4, 4, 18) in [tuple(r) for r in decontaminate.hit_spans(found).collect()]
    assert decontaminate.find_contamination(none, items).count() == 0


def test_trigram_contexts_are_scored(spark, tmp_path):
    rows = [(1, "a b c d"), (2, "a b c"), (3, "a b d"), (4, "x c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in QUERIES["op1_lm_scoring"](spark, str(tmp_path)).collect()}
    # for document 2, elsewhere: a is 2 of 9 words, a b follows both a, and a b c one of two a b
    assert got[2] == round(math.log(2 / 9) + math.log(2 / 2) + math.log(1 / 2), 4)
    # of document 3: a b d is nowhere else, nor is b d, so d alone counts, two words shorter
    assert got[3] == round(math.log(2 / 9) + math.log(2 / 2) + 2 * math.log(0.4) + math.log(1 / 9), 4)


def test_topk_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [0.5, 0.5]), (5, [0.0, 0.0])]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = sorted(map(tuple, topk_search.top_k(v, v.where("id = 0"), k=2).collect()))
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 4, 128 * 256)]
