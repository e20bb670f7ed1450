"""The corpus pipeline's stages and the whole, on small tables, against plain loops."""

import random

import pytest
from test_brute_force import kept_lines, near_classes, words_of

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, n_lines int, keep string"


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of four languages with exact and near copies, repeated lines, a benchmark passage, and texts of nothing."""
    random.seed(8)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 200 and 3000").select("text", "lang").orderBy("doc_id").limit(70).collect()]
    texts = [(t, x) for t, x in docs]
    texts += [docs[0], docs[1], (docs[2][0].replace(" ", "  "), docs[2][1])]
    long = docs[3][0].split()
    long[4] = "changed"
    texts.append((" ".join(long), docs[3][1]))
    texts.append(("\n".join([*docs[4][0].split("\n"), "and this one line is new"]), docs[4][1]))
    texts.append((docs[5][0] + "\nthe quick brown fox of the test jumps over nine lazy dogs at noon", None))
    texts += [(None, "en"), ("", "en"), ("12 34 !!", None), ("x y " * 3000, "en")]
    return [(i, t, x, "s", len(t or ""), "k", 5, 9, "z") for i, (t, x) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "The quick, brown fox of the test jumps over nine lazy dogs"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_language_stage_acts_on_its_prediction(spark, rows, folder, monkeypatch):
    docs = spark.createDataFrame(rows, COLUMNS)
    got = {r["doc_id"]: r for r in P.identify_language(spark, docs, folder).collect()}
    assert set(got) == {r[0] for r in rows if any(map(str.isalpha, r[1] or ""))}
    assert all(got[r[0]]["lang"] == r[2] for r in rows if r[2] and r[0] in got) and all(r["lang"] for r in got.values())
    assert list(next(iter(got.values())).asDict()) == docs.columns
    monkeypatch.setattr(P, "LANGUAGE_SCORE", 1.1)
    assert P.identify_language(spark, docs, folder).count() == 0
    empty = docs.limit(0)
    assert P.identify_language(spark, empty, folder).count() == 0


def lines_stage(rows):
    texts, _ = kept_lines([(r[0], r[1]) for r in rows])
    out = []
    for r in rows:
        size = lambda t: sum(len(x) for x in (t or "").split("\n") if words_of(x))
        if size(texts[r[0]]) >= P.KEPT_SHARE * size(r[1]):
            out.append((r[0], texts[r[0]], *r[2:4], None if texts[r[0]] is None else len(texts[r[0]]), *r[5:]))
    return out


def near_stage(rows):
    classes, _ = near_classes([r[0] for r in rows], [r[1] for r in rows])
    return [r for r in rows if classes[r[0]] == r[0]]


def clean_stage(rows):
    window = words_of("The quick, brown fox of the test jumps over nine lazy dogs")
    hit = lambda w: any(w[i : i + 10] == window[k : k + 10] for i in range(len(w) - 9) for k in range(len(window) - 9))
    return [r for r in rows if not hit(words_of(r[1]))]


def test_middle_stages_and_the_whole(spark, rows, folder):
    table = lambda rows: spark.createDataFrame(rows, COLUMNS)
    same = lambda df, rows: sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))
    some = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    lined, near, clean = lines_stage(some), near_stage(some), clean_stage(some)
    assert len(lined) < len(some) and len(near) < len(some) and len(clean) == len(some) - 1
    assert same(P.dedup_lines(spark, table(some), folder), lined)
    assert same(P.drop_near_duplicates(spark, table(some), folder), near)
    assert same(P.drop_contaminated(spark, table(some), folder), clean)
    last = clean_stage(near_stage(lined))
    packed = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in last}
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    assert [k for k, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "decontamination", "packing"]


def test_near_copies_without_ids_and_equal_rows(spark, folder):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rest = ("en", "s", 1, "k", 1, 1, "z")
    rows = [(None, text, *rest), (None, text, *rest), (3, text, *rest), (3, text, *rest), (4, other, *rest), (None, None, *rest), (None, "alone and only", *rest), (7, "", *rest), (7, "", *rest)]
    got = [tuple(r)[:2] for r in P.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()]
    assert sorted(got, key=str) == sorted([(3, text), (4, other), (None, None), (None, "alone and only"), (7, "")], key=str)


def test_texts_that_share_an_id_stay(spark):
    one, other = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3).strip(), "nothing of this is like the other text at all, it has words of its own"
    docs = spark.createDataFrame([(1, one), (5, one), (5, other), (5, other), (None, one), (None, None), (7, None), (7, "")], "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in P.drop_near_duplicates(spark, docs, "").collect())))
    assert got == sorted(map(repr, [(1, one), (5, other), (None, None), (7, None), (7, "")]))
    assert P.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
