"""Edits and their counters, folders of deleted versions, jobs as keyed state, headings by type, routes, and contents put in order."""

import datetime
import itertools
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.functions import jsons, outline
from docloom.functions import text as T
from docloom.operators import toc, trees, typography, versions
from docloom.sources import sinks
from docloom.streaming import job_feed

SECTION = "section_id long, heading string, content string"


@pytest.mark.parametrize(
    ("updates", "message"),
    [([(1, "a", None), (1, None, "b")], "updated twice"), ([(1, None, None)], "changes nothing"), ([(9, "a", None)], "no such section"), ([(None, "a", None)], "no such section")],
)
def test_faulty_edits_write_nothing(spark, tmp_path, updates, message):
    s = spark.createDataFrame([(1, "h", "c"), (2, None, None)], SECTION)
    edited = versions.edit_sections(s, spark.createDataFrame(updates, SECTION))
    with pytest.raises(PySparkException, match=message):
        edited.write.parquet(f"{tmp_path}/out")
    assert not list((tmp_path / "out").glob("*.parquet"))
    # also if no column of the edit is read
    with pytest.raises(PySparkException, match=message):
        edited.select(F.lit(1)).collect()


def test_edits_and_their_counters(spark, tmp_path):
    s = spark.createDataFrame([(1, "h", "c"), (2, "i", None), (None, "n", None)], SECTION)
    edited = versions.edit_sections(s, spark.createDataFrame([(1, "  ", None), (2, None, "d")], SECTION))
    out, seen = versions.counted(edited, "edits", blank=F.col("heading").isNull(), none=F.col("content").isNull(), unknown=F.lit(None).cast("boolean"))
    out.write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in got.collect()} == {(1, None, "c"), (2, "i", "d"), (None, "n", None)}
    assert seen.get == {"rows": got.count(), "blank": got.where("heading is null").count(), "none": got.where("content is null").count(), "unknown": 0}
    empty, seen = versions.counted(s.limit(0), "none", blank=F.col("heading").isNull())
    empty.collect()
    assert seen.get == {"rows": 0, "blank": 0}


def test_folders_of_deleted_versions(spark, tmp_path):
    for g, v in [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]:
        (tmp_path / f"guidelines/{g}/{v}/pages").mkdir(parents=True)
        (tmp_path / f"guidelines/{g}/{v}/pages/x.png").write_bytes(b"x")
    doomed = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, None), (4, 1), (None, 1)], "guideline_id long, version_id long")
    run = lambda: {(r[0], r[1]): r[2] for r in sinks.delete_folders(doomed, str(tmp_path)).collect()}
    assert run() == {(1, 1): "deleted", (2, 1): "deleted", (3, None): "deleted", (4, 1): "absent"}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.glob("guidelines/*/*")) == ["guidelines/1/2"] and not (tmp_path / "guidelines/2").exists()
    assert set(run().values()) == {"absent"}


def test_one_active_job_until_it_ends(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "version_id long, job_id long, at timestamp, event string"
    parts = [
        [(7, 1, 0, "queued"), (7, 2, 1, "queued"), (8, 3, 0, "running"), (8, 3, 1, "queued"), (None, 4, 0, "queued"), (9, 5, 0, "other")],
        # far beyond any watermark the version is still taken
        [(7, 6, 10**6, "queued"), (7, 1, 10**6 + 1, "running"), (7, 2, 10**6 + 2, "succeeded")],
        # the request is free only after the end, though the rows come the other way round
        [(7, 2, 2 * 10**6 + 1, "queued"), (7, 1, 2 * 10**6, "failed"), (8, 3, 2 * 10**6, "succeeded")],
    ]
    empty = spark.createDataFrame([], schema).schema
    for k, rows in enumerate(parts):
        spark.createDataFrame([(v, j, at + datetime.timedelta(seconds=s), e) for v, j, s, e in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        # every part is a restart from the checkpoint
        events = job_feed.read_jobs(spark, f"{tmp_path}/in/*", empty)
        job_feed.append_to(job_feed.admit(events), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["version_id"], r["job_id"], (r["at"] - at).total_seconds(), r["event"]): r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {
        (7, 1, 0, "queued"): "accepted", (7, 2, 1, "queued"): "refused", (8, 3, 0, "running"): "ignored", (8, 3, 1, "queued"): "accepted",
        (7, 6, 10**6, "queued"): "refused", (7, 1, 10**6 + 1, "running"): "started", (7, 2, 10**6 + 2, "succeeded"): "ignored",
        (7, 1, 2 * 10**6, "failed"): "ended", (7, 2, 2 * 10**6 + 1, "queued"): "accepted", (8, 3, 2 * 10**6, "succeeded"): "ignored",
    }
    # a part sent once more is a new micro-batch: of a version that is taken all is refused or ignored
    assert job_feed._next((1, "running"), 1, "queued") == ((1, "running"), "refused") and job_feed._next(None, 1, "failed") == (None, "ignored")


def test_headings_by_type(spark):
    span = "version_id long, seq long, page int, text string, size double, flags int, y0 double"
    rows = [
        (1, 0, 1, "1. Aims", 14.0, 0, 84.2), (1, 1, 1, "2. same height", 14.0, 0, 84.2), (1, 2, 1, " body", 10.04, 0, 200.0), (1, 3, 1, "1.1 bold\tone", 10.0, 20, 400.0),
        (1, 4, 2, "1.2 plain", 10.0, 0, 10.0), (1, 5, 2, "not numbered", 20.0, 16, 20.0), (1, 6, 2, "CHƯƠNG II Next", 12.0, 0, -5.0), (1, 7, 3, "2.1) in", 12.0, None, 99.0),
        (1, 8, 3, "1.5 points", 11.5, 0, 120.0), (1, 9, 4, "3. null size", None, 16, 1.0), (1, 10, 4, "  ", 30.0, 16, 2.0), (1, 11, 4, None, 30.0, 16, 2.0),
        # sizes that tie: the first is the body's
        (2, 0, 1, "1. a", 12.0, 0, 0.0), (2, 1, 1, "2. b", 10.0, 0, 1.0),
    ]
    pages = spark.createDataFrame([(1, 1, 842.0), (1, 2, 842.0), (1, 3, 0.0), (1, 4, None)], "version_id long, page int, height double")
    got = typography.headings_by_type(spark.createDataFrame(rows, span), pages).orderBy("version_id", "pos").collect()
    assert [(r["version_id"], r["pos"], r["page"], r["y"], r["level"], r["title"], r["parent_pos"]) for r in got] == [
        (1, 0, 1, 0.1, 1, "1. Aims", None), (1, 1, 1, 0.475059, 2, "1.1 bold one", 0), (1, 2, 2, 0.0, 1, "CHƯƠNG II Next", None), (1, 3, 3, 0.0, 2, "2.1) in", 2), (1, 4, 4, 1.0, 1, "3. null size", None),
    ]
    assert typography.headings_by_type(spark.createDataFrame([], span), pages).count() == 0


def test_structure_and_routes(spark):
    columns = "version_id long, page_count long, outline_root boolean, entries long, actionable long, depth int, visible boolean, struct_tree boolean, vietnamese boolean, title string, creator string, producer string, format string, words long"
    rows = [
        (1, 10, True, 9, 9, 2, False, False, False, None, None, None, None, 90),  # rich by levels
        (2, 50, True, 8, 8, 1, False, False, False, None, "CorelDRAW X5", None, None, 90),  # rich, but of a poor author
        (3, 50, True, 6, 6, 1, None, None, None, None, None, None, None, 90),  # weak: one level, few entries
        (4, 50, True, 7, 7, 1, None, None, None, None, None, None, None, 90),  # too many to be weak
        (5, 8, True, 4, 4, 1, None, None, None, None, None, None, None, 90),  # more than 3 for its pages
        (6, 50, True, 6, 6, 1, False, True, False, "Sổ tay Tiếng Việt", None, None, None, 90),
        (7, 50, True, 6, 4, None, True, False, False, None, None, "coreldraw", None, 90),  # too few lead somewhere
        (8, 0, False, 0, 0, None, None, None, None, None, None, None, None, 0),
        (9, 66, True, 8, 8, 1, True, False, False, None, "CorelDRAW", None, None, 29),
    ]
    got = {r["version_id"]: (r["rich"], r["weak"], r["reason"].split("_")[0]) for r in toc.route(toc.with_structure(spark.createDataFrame(rows, columns))).collect()}
    assert got == {
        1: (True, False, "native"), 2: (True, True, "extractable"), 3: (False, True, "extractable"), 4: (False, False, "native"), 5: (False, False, "native"),
        6: (False, False, "detected"), 7: (False, False, "missing"), 8: (False, False, "empty"), 9: (True, False, "native"),
    }


def _rises(places):
    return all(a <= b for a, b in itertools.pairwise(places))


def test_contents_put_in_order(spark):
    """Against every choice of nodes: those that stay are a longest run, landmarks and unknown chunks stay whatever they say, nothing is left empty behind a placed node."""
    dice = random.Random(5)
    nodes, places, sure = [], [(v, f"c{p}", p) for v in range(8) for p in range(9)], []
    for v in range(8):
        for i in range(9):
            c = dice.choice([None, "zz", *[f"c{p}" for p in range(9)] * 2])
            nodes.append((v, i, f"t{i}", 1, f"t{i}", c))
            if c and dice.random() < 0.2:
                sure.append((v, i))
    node = "version_id long, idx int, path string, level int, title string, chunk_id string"
    got = toc.settle(spark.createDataFrame(nodes, node), spark.createDataFrame(places, "version_id long, chunk_id string, position int"), spark.createDataFrame(sure, "version_id long, idx int")).collect()
    for v in range(8):
        was = {n[1]: n[5] for n in nodes if n[0] == v}
        now = {r["idx"]: r["chunk_id"] for r in got if r["version_id"] == v}
        judged = [i for i in was if was[i] and was[i] != "zz" and (v, i) not in sure]
        best = max(n for n in range(len(judged) + 1) for c in itertools.combinations(judged, n) if _rises([int(was[i][1:]) for i in c]))
        # what a node may have: its own chunk if it stayed, or that of the last one before it that did
        runs = [set(c) for c in itertools.combinations(judged, best) if _rises([int(was[i][1:]) for i in c])]

        def filled(run, was=was, judged=judged):
            out, last = {}, None
            for i in sorted(was):
                last = was[i] if was[i] and (i in run or i not in judged) else last
                out[i] = last
            first = min((int(c[1:]) for c in was.values() if c and c != "zz"), default=None)
            return out, first

        assert any(all(now[i] == want for i, want in filled(run)[0].items() if want is not None) for run in runs)


def test_names_of_things(spark):
    df = spark.createDataFrame([(" Clinic/Guide.v2.pdf ", "/x/9.pdf"), ("  ", "/x/9.pdf"), (None, "9"), (".pdf", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(outline.source_name(F.col("a"), F.col("b"))).collect()] == ["Guide.v2_ocr.md", "9_ocr.md", "9_ocr.md", ".pdf_ocr.md", "_ocr.md"]
    kinds = spark.createDataFrame([("table",), ("diagram",), ("video",), ("",), (None,)], "k string")
    assert [r[0] for r in kinds.select(outline.asset_label(F.col("k"))).collect()] == ["Bảng biểu", "Hình ảnh", "Video", "Tài liệu", "Tài liệu"]
    roles = spark.createDataFrame([("doctor",), ("other",), (None,)], "k string")
    assert [r[0] for r in roles.select(outline.role_label(F.col("k"))).collect()] == ["Bác sĩ", "other", ""]
    mails = spark.createDataFrame([("MAILTO: soyteA@example.com;",), ("x@example.com",), ("soytea@other.com",), ("soyte@example.com",), ("@example.com",), (None,)], "m string")
    got = [r[0] for r in mails.select(T.moved_email(F.col("m"), "example.com", "mail.vn", "soyte", "tramyte")).collect()]
    assert got == ["tramytea@mail.vn", None, None, "tramyte@mail.vn", None, None]


def test_trees_of_six_levels(spark):
    nodes = [(1, k, list(range(k + 1)), f"t{k}") for k in range(6)]
    df = spark.createDataFrame(nodes, "version_id long, idx int, path array<int>, title string")
    at, titles = trees.nested(df).first()["children"], []
    while at:
        titles.append(at[0]["title"])
        at = at[0]["children"] if "children" in at[0] else None
    assert titles == [f"t{k}" for k in range(6)]
    with pytest.raises(PySparkException, match="deeper than 5"):
        trees.nested(df, 5).collect()
    keys = ["sections", "subsections", "subsubsections", "subsubsubsections", "subsubsubsubsections"]
    text = '{"title": "6"}'
    for k, name in enumerate(reversed(keys)):
        text = f'{{"title": "{5 - k}", "{name}": [{text}]}}'
    at, titles = spark.range(1).select(jsons.toc_of(F.lit(f'{{"chapters": [{text}]}}')).alias("t")).first()["t"]["children"], []
    while at:
        titles.append(at[0]["title"])
        at = at[0]["children"] if "children" in at[0] else None
    assert Counter(titles) == Counter("123456")


def test_chunks_with_their_vectors(spark):
    chunks = spark.createDataFrame([(1, [1], "", "a"), (1, [1, 2], "a", "b"), (2, [1], "", "c")], "version_id long, path array<int>, context string, text string")
    vectors = spark.createDataFrame([(1, [1], [0.5, 1.25]), (1, [1, 2], [0.1]), (9, [1], [1.0, 1.0])], "version_id long, path array<int>, vector array<double>")
    once, again = ({(r["version_id"], tuple(r["path"])): (r["chunk_id"], r["embedding"]) for r in sinks.chunk_rows(chunks, vectors, 2).collect()} for _ in range(2))
    # a vector of another size is none; ids are their own and come again
    assert {k: v[1] for k, v in once.items()} == {(1, (1,)): "[0.5,1.25]", (1, (1, 2)): None, (2, (1,)): None}
    assert once == again and len({v[0] for v in once.values()}) == 3
