"""Importance resampling, SimHash near-duplicates and fill-in-middle against plain loops that follow their definitions, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import fill_in_middle, importance_resampling, simhash_dedup
from docloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, white and long texts, copies, marks, and columns with names that the operators use."""
    names = "id long, rest string, h int, n int, form string, text2 string, fp int, block int, word string, rank int, score long, weight int, n_words int, may int, key int, tie int, target string"
    words = "one Two three four five six seven eight nine ten eleven twelve " * 2
    texts = [(1, words), (1, words), (2, words + "!"), (3, None), (4, ""), (5, " \t\n"), (6, "x" * 70_000 + " é日本 y z" * 60_000), (None, words), (None, None), (7, "a <P> b"), (8, "<<S>"), (9, "日本語のテキスト" * 40), (10, "q")]
    values = tuple(None for _ in names.split(","))
    return spark.createDataFrame([(i, t, *values) for i, t in texts], f"doc_id long, text string, {names}")


def in_middle(doc_id, text):
    text, x = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, units = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)], re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out, text


def test_fill_in_middle(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    want = sorted(repr((r[0], *in_middle(*r))) for r in docs.collect())
    found = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
    assert {in_middle(*r)[1] for r in docs.collect()} == {"plain", "spm", "psm"}
    assert fill_in_middle.transform(odd.limit(0)).count() == 0 and fill_in_middle.transform(odd).count() == odd.count()


def test_cuts_of_adjacent_texts():
    """Letters at the edges of texts, marks across edges, and slices of a column."""
    random.seed(5)
    texts = ["".join(random.choice("ab<PSM>é 日") for _ in range(random.randint(0, 12))) or None for _ in range(600)]
    h = np.array([[random.getrandbits(32) for _ in range(4)] for _ in texts], dtype=np.int64)
    column = pa.array(["zz", *texts])[1:]
    got = fill_in_middle.cut_texts(column, h)
    for k, text in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
        a, b = sorted(int(x) % (len(units) + 1) for x in h[k][:2])
        p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        plain = not text or bool(re.search("<[PSM]>", text)) or h[k][2] % 100 >= 90
        want = (text or "") if plain else f"<S>{s}<P>{p}<M>{m}" if h[k][3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
        assert (got["n"][k].as_py(), got["output"][k].as_py(), got["prefix_chars"][k].as_py()) == (len(units), want, None if plain else len(p))


def simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_documents(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text").where("doc_id is null or doc_id <> 6").withColumn("doc_id", F.col("doc_id") + 100_000)).unionAll(spark.createDataFrame([(7_000_000, "A b\x0bc d"), (7_000_001, "a\tb c  \x0cd ")], "doc_id long, text string"))
    rows = docs.collect()
    prints = [simhash(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = components(len(rows), links)
    least = {}
    for r, k in zip(rows, root, strict=True):
        least[k] = min(x for x in (least.get(k), r[0]) if x is not None) if (least.get(k), r[0]) != (None, None) else None
    want = sorted(repr((r[0], f"{p:016x}", least[k])) for r, p, k in zip(rows, prints, root, strict=True))
    assert sorted(repr(tuple(r)) for r in simhash_dedup.near_duplicates(docs).collect()) == want
    assert len(set(root)) < len(rows) - 10
    assert simhash_dedup.near_duplicates(odd.limit(0)).count() == 0 and simhash_dedup.near_duplicates(odd).count() == odd.count()


def test_the_query_is_the_operator(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op12_simhash_dedup"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        assert got[r["doc_id"]][0] == f"{simhash(r['text']):016x}" and got[r["doc_id"]][1] <= r["doc_id"]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_the_radius(radius):
    random.seed(radius)
    for free in (list(range(64)), random.sample(range(64), 28), random.sample(range(64), 11)):
        masks = simhash_dedup.covering_masks(free, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            apart = sum(1 << b for b in random.sample(free, radius))
            assert any(not apart & m for m in masks)


@pytest.mark.parametrize("members", [40, 512])
def test_dense_values_lose_no_link(spark, members):
    """Values in dense balls, so that buckets overflow on every level; signed ones too."""
    random.seed(9)
    values = set()
    for centre in (0, (1 << 64) - 1, random.getrandbits(64)):
        for _ in range(150):
            values.add(centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))))
    values |= {random.getrandbits(64) for _ in range(50)}
    values = sorted(values)
    root = components(len(values), [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash_dedup.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), members=members).collect()
    at = {v: k for k, v in enumerate(signed)}
    assert components(len(values), [(at[r["a"]], at[r["b"]]) for r in found]) == root
    assert len(set(root)) < len(values) - 100


def resampled(docs, items, orders, buckets):
    def words(text):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", lower(text))

    def features(w):
        return [" ".join(w[i : i + n]) for n in orders for i in range(len(w) - n + 1)]

    where = lambda f: zlib.crc32(f.encode()) % buckets
    source, target = (Counter(where(f) for t in texts for f in features(words(t))) for texts in ([t for _, t in docs], items))
    n_s, n_t = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (n_s + buckets) / ((s + 1) * (n_t + buckets)))) for b, s in source.items()}
    out = []
    for i, t in docs:
        f, u = features(words(t)), (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[where(x)] for x in f)
        out.append((i, len(words(t)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u)))))
    return out


@pytest.mark.parametrize("orders", [(1,), (1, 2), (2, 3)])
def test_weights_and_scores(spark, odd, orders):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").unionAll(spark.createDataFrame([(None,), ("",)], "text string"))
    got = importance_resampling.score_documents(docs, items, min_n=min(orders), max_n=max(orders), buckets=500)
    want = resampled([tuple(r) for r in docs.collect()], [r[0] for r in items.collect()], orders, 500)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))


def test_small_blocks_give_the_same(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, importance_resampling.score_documents(docs, items, max_n=2).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(importance_resampling, "BLOCK_BYTES", 40_000)
        m.setattr(importance_resampling, "SENT_BUCKETS", 1)
        assert sorted(map(tuple, importance_resampling.score_documents(docs, items, max_n=2).collect())) == whole


def test_ranks_of_odd_and_empty_tables(spark, odd):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for d, i in ((odd, items), (odd, items.limit(0)), (odd.limit(0), items), (odd.limit(0), items.limit(0))):
        found = importance_resampling.resample(importance_resampling.score_documents(d, i), percent=50)
        assert found.count() == d.count()
    found = importance_resampling.resample(importance_resampling.score_documents(odd, items), percent=60).collect()
    may = sorted((r for r in found if r["n_words"] >= 20), key=lambda r: (-r["score"], r["doc_id"] or 0))
    drawn = len(may) * 60 // 100
    assert sorted(r["rank"] for r in found if r["rank"] is not None) == list(range(1, drawn + 1))
    assert [r["score"] for r in sorted(found, key=lambda r: r["rank"] or 99) if r["rank"]] == [r["score"] for r in may[:drawn]]
