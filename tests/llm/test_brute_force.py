"""Operators that SQL cannot express, against plain loops that follow their definitions."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, line_dedup, minhash_dedup, packing, quality, topk_search, toxicity
from docloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lower)


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")


# Near-duplicates


def weighted(texts):
    """TF-IDF weights of the five-word shingles of each text, as the operator defines them."""
    bags = []
    for w in map(words_of, texts):
        n = min(len(w), 5)
        bags.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter())
    df, n = Counter(g for b in bags for g in b), sum(bool(b) for b in bags)
    return [{g: np.float32((1 + math.log(c)) * math.log1p(1 / (df[g] / n + minhash_dedup.SMOOTH))) for g, c in b.items()} for b in bags]


def similarity(x, y):
    both = sum(float(min(w, y[g])) for g, w in x.items() if g in y)
    return both / (sum(map(float, x.values())) + sum(map(float, y.values())) - both)


def near_classes(ids, texts):
    bags, rows = weighted(texts), [words_of(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if bags[i] and bags[j] and (rows[i] == rows[j] or similarity(bags[i], bags[j]) >= 0.8)]
    return {ids[i]: ids[r] for i, r in enumerate(roots(len(ids), links))}, len(links)


def test_op7_finds_all_pairs(spark, documents):
    want, n_links = near_classes(documents["doc_id"].tolist(), documents["text"].tolist())
    got = {r[0]: r[1] for r in QUERIES["op7_minhash_dedup"](spark, DATA).collect()}
    same = sum(got[k] == v for k, v in want.items() if k != v)
    print(f"op7: {n_links} links, {same} of {sum(k != v for k, v in want.items())} members in their class")
    assert n_links and got == want


def test_op7_with_large_groups_and_odd_rows(spark, tmp_path):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [random.choice(vocabulary) for _ in range(150)]
    texts = []
    for k in range(60):  # near copies of one text, a few words apart from each other
        t = list(base)
        for _ in range(k % 3):
            t[random.randrange(150)] = f"x{random.randrange(9)}"
        texts.append(" ".join(t))
    texts += [" ".join(random.choice(vocabulary) for _ in range(80)) for _ in range(40)] + [None, "", "!!", "one two", "One two", "three"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0], (None, texts[1]), (None, texts[1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op7_minhash_dedup"](spark, str(tmp_path)).collect()), key=str)
    # repeated rows and rows without an id count for the weights, and give one row each
    every, _ = near_classes([*range(len(texts)), *range(1000, 1003)], [*texts, texts[0], texts[1], texts[1]])
    assert got == sorted([*((k, v) for k, v in every.items() if k < 1000), (None, None)], key=str)


# Lines


def kept_lines(rows, edits=2):
    """(doc_id, text) without repeated lines, by comparing every two distinct lines."""
    places = {}
    for d, t in sorted(r for r in rows if r[1] is not None):
        for k, line in enumerate(t.split("\n")):
            if words_of(line):
                places.setdefault(line, (d, k))
    lines = sorted(places, key=places.get)
    links = []
    for i, j in itertools.combinations(range(len(lines)), 2):
        a, b = lines[i], lines[j]
        most = min(edits, min(len(a), len(b)) // line_dedup.CHARS_PER_EDIT)
        if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
            links.append((i, j))
    stay = {places[lines[r]] for r in roots(len(lines), links)}
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not words_of(x) or (d, k) in stay) for d, t in rows}, len(links)


def test_op8_on_random_lines(spark, tmp_path):
    random.seed(3)
    letters = "ab cé日😀"
    lines = ["".join(random.choice(letters) for _ in range(n)) for n in range(8, 40) for _ in range(3)]
    for line in list(lines):
        for _ in range(3):
            x = list(line)
            for _ in range(random.randint(1, 3)):
                k = random.randrange(len(x))
                x[k : k + 1] = random.choice([[], [random.choice(letters)], [x[k], random.choice(letters)]])
            lines.append("".join(x))
    random.shuffle(lines)
    rows = [(i, "\n".join(random.choice(lines) for _ in range(6))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n")]
    want, n_links = kept_lines(rows)
    assert n_links > 100
    spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, n_lines int, keep string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = line_dedup.dedup_lines(docs)
    assert {r["row"]["doc_id"]: r["row"]["text"] for r in found.collect()} == want
    assert {(r["row"]["n_lines"], r["row"]["keep"]) for r in found.collect()} == {(9, "k")}  # columns of the same names pass through
    report = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert report == {i: tuple(sum(bool(words_of(x)) for x in (s or "").split("\n")) for s in (t, want[i])) for i, t in rows}


def test_op8_on_documents(spark, documents):
    rows = list(documents.itertuples(index=False, name=None))[:60]
    want, _ = kept_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["row"]["doc_id"]: r["row"]["text"] for r in got.collect()} == want


# Language


def test_op9_sums_all_segmentations(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    number, longest = {p: i for i, p in enumerate(model.pieces)}, max(map(len, model.pieces))
    assert longest > 16
    seen = {}

    def word_log(word):
        if word not in seen:
            w = b" " + word.encode()
            at = np.full((len(w) + 1, len(model.languages)), -np.inf)
            at[0] = 0
            for j in range(1, len(w) + 1):
                for i in range(max(0, j - longest), j):
                    p = number.get(w[i:j])
                    if p is not None:
                        at[j] = np.logaddexp(at[j], at[i] + np.log(model.p[p]))
            seen[word] = at[-1]
        return seen[word]

    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, DATA).collect()}
    for i, text in documents.itertuples(index=False, name=None):
        if text is None or not any(map(str.isalpha, text)):
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        logs = sum((word_log(w) for w in words_of(text)), np.zeros(len(model.languages))) + model.prior
        assert got[i]["lang_pred"] == model.languages[int(logs.argmax())]
        assert math.isclose(got[i]["score"], 1 / np.exp(logs - logs.max()).sum(), rel_tol=1e-6)


def test_long_words_are_never_cut(monkeypatch):
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abcab", b" a", "日本日本日本日本".encode()})
    texts = pa.array(["abcab" * n for n in (1, 6, 7, 12)] + ["日本日" * 7 + "abc", "日本" * 6])
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel(["x", "y"], rng.dirichlet(np.ones(len(pieces)), size=2).T, np.zeros(2), pieces)

    def everything():
        fitted = language_id.fit(texts.slice(0, 3), ["x", "y", "x"], pieces, {"x": 1}, rounds=3)
        return model.log_likelihoods(texts), fitted.p

    by_place = everything()
    monkeypatch.setattr(language_id, "SHORT", 400)
    by_length = everything()
    monkeypatch.setattr(language_id, "SHORT", 0)
    assert all(np.allclose(a, b, rtol=1e-8) and np.allclose(a, c, rtol=1e-8) for a, b, c in zip(by_place, by_length, everything(), strict=True))


# Toxicity and quality


def test_op4_marginals_are_those_of_whole_texts(spark, documents, monkeypatch):
    rng = np.random.default_rng(0)
    crf = toxicity.Crf()
    crf.move = rng.normal(size=(2, 2))
    counts = np.array([0, 1, 2, 3, 4, 7, 0, 9, 10, 5])
    e = 2 * rng.normal(size=counts.sum())
    want = []
    for x in np.split(e, np.cumsum(counts)[:-1]):
        paths = np.array(list(itertools.product((0, 1), repeat=len(x)))) if len(x) else np.zeros((1, 0), int)
        w = np.exp((paths * x).sum(axis=1) + crf.move[paths[:, :-1], paths[:, 1:]].sum(axis=1))
        want.append(w @ paths / w.sum())
    for block in (2, 3, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        r, s = crf.forward_backward(e, counts)
        assert np.allclose(r * s / (1 + r * s), np.concatenate(want))
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_toxicity"](spark, DATA).collect()}
    a = np.exp(model.crf.move)
    for i, text in list(documents.itertuples(index=False, name=None))[:60]:
        w = toxicity.Words(pa.array([text], pa.string()))
        x = np.exp(np.clip(model.crf.emissions(model.crf.features(w)), -40, 40))
        f, b = [np.array([1.0, v]) for v in x[:1]], [np.ones(2)]
        for v in x[1:]:
            f.append((a.T @ f[-1]) * [1, v] / (a.T @ f[-1]).sum())
        for v in x[:0:-1]:
            b.append(a @ ([1, v] * b[-1]) / (a @ ([1, v] * b[-1])).sum())
        m = np.array([(p * q)[1] / (p * q).sum() for p, q in zip(f, b[::-1], strict=True)]) if len(x) else np.zeros(0)
        z = np.array([m.max(initial=0), math.log1p(m.sum()), m.sum() / max(len(m), 1), 1]) @ model.weights
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_op6_scores_and_gradients(spark, documents):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op6_quality"](spark, DATA).collect()}
    p = model.p
    for i, text in list(documents.itertuples(index=False, name=None))[:60]:
        x, _ = quality.passages(pa.array([text], pa.string()))
        h = [np.tanh(np.clip((row - model.mean) / model.scale, -6, 6) @ p["enc"] + p["enc_b"]) for row in x]
        e = [math.exp((np.tanh(v @ p["v"]) / (1 + np.exp(-(v @ p["u"])))) @ p["w"]) for v in h]
        bag = sum(w * v for w, v in zip(e, h, strict=True)) / sum(e)
        assert math.isclose(got[i], 1 / (1 + math.exp(-(bag @ p["out"] + p["out_b"][0]))), rel_tol=1e-6)
    x, begin = quality.passages(pa.array(documents["text"].tolist()[:5], pa.string()))
    y, weight = np.array([0, 1, 1, 0, 1]), np.array([1.0, 2, 1, 1, 1])

    def loss():
        q = 1 / (1 + np.exp(-model.run(x, begin)["logit"]))
        return -(weight * np.where(y == 1, np.log(q), np.log(1 - q))).sum() / weight.sum()

    for k, g in model.gradient(x, begin, y, weight).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, step = p[k][at], 1e-5
        p[k][at] = was + step
        up = loss()
        p[k][at] = was - step
        down = loss()
        p[k][at] = was
        assert math.isclose((up - down) / (2 * step), g[at], rel_tol=1e-3, abs_tol=1e-7)


# Packing, decontamination, search


def test_best_fit_follows_its_rule():
    random.seed(4)
    for _ in range(200):
        lengths, capacity, most = [random.randint(1, 30) for _ in range(60)], 30, random.choice([1, 3, 100])
        bins, offsets = packing.best_fit(lengths, capacity, most)
        free = []  # of the open bins; those of equal space can stand for each other
        for n, at in zip(lengths, offsets, strict=True):
            fits = [f for f in free if f >= n]
            if fits:
                space = min(fits)
                free.remove(space)
            else:
                if len(free) >= most:
                    free.remove(min(free))
                space = capacity
            assert at == capacity - space
            if space > n:
                free.append(space - n)
        for b in set(bins):
            spans = sorted((at, n) for x, at, n in zip(bins, offsets, lengths, strict=True) if x == b)
            assert all(x + n == y for (x, n), (y, _) in itertools.pairwise(spans)) and sum(spans[-1]) <= capacity


def test_windows_are_found_as_by_comparing_all(spark):
    random.seed(6)
    for width in (2, 3, 4, 10):
        items = [(k, " ".join(random.choice("ab") for _ in range(random.randint(0, 14)))) for k in range(8)]
        index = decontaminate.Index(items, width)
        for _ in range(60):
            words = [random.choice("abc").encode() for _ in range(random.randint(0, 40))]
            hit, found = set(), set()
            for k, text in items:
                own = text.encode().split()
                n = min(width, len(own))
                for i in range(len(own) - n + 1 if n else 0):
                    for at in range(len(words) - n + 1):
                        if words[at : at + n] == own[i : i + n]:
                            hit.update(range(at, at + n))
                            found.add(k)
            spans, ids = index.find(words)
            assert {i for a, b in spans for i in range(a, b)} == hit and ids == sorted(found)


def test_repeated_queries_are_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.5])]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = sorted(map(tuple, topk_search.top_k(v, v.where("id = 0"), k=3).collect()))
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256), (0, 3, 2, 64 * 256)]
    assert topk_search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_query_blocks_follow_the_buckets_they_reach():
    size = topk_search.block_rows(64)
    got = topk_search.deal([(64, 5, 10), (64, 3, size), (64, 4, size - 10), (64, 9, 2 * size + 1), (64, 10, 1), (8, 1, 3)])
    # another dimension has its own; 4 and 5 share one; 9 is cut into three; 10 comes behind
    assert got == [(8, 1, 0, 1), (64, 3, 1, 1), (64, 4, 2, 1), (64, 5, 2, 1), (64, 9, 3, 3), (64, 10, 6, 1)]
    assert topk_search.deal([]) == []


def test_topk_over_many_blocks_against_all_products(spark, monkeypatch):
    """Lengths from short to long, ties, two dimensions and a query that stands for many, with blocks so small that buckets and queries have several."""
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(topk_search, "LEAST_BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6 if i % 9 else 3) * np.exp(r.normal())).tolist()) for i in range(900)]
    rows += [(i, rows[1][1]) for i in range(900, 1000)] + [(1000, [0.0] * 6), (1001, None)]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = sorted(map(tuple, topk_search.top_k(v, v.where("id % 5 = 0"), k=4).collect()))
    whole = {i: np.floor(np.array(e) * 256) for i, e in rows if e is not None}
    want = []
    for q in (i for i in whole if i % 5 == 0):
        scores = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)
