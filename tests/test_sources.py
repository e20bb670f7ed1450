"""Files as tables, sinks, tree and markup operators on small hand-made inputs."""

import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import markup
from docloom.operators import trees
from docloom.sources import files, sinks


def test_byte_range(spark):
    cases = {None: (0, 9), "bytes=2-4": (2, 4), "bytes=7-": (7, 9), "bytes=-3": (7, 9), "bytes=-99": (0, 9), "bytes=5-99": (5, 9), "bytes=10-": None, "bytes=4-2": None, "bytes=-": None, "bytes=0-1,3-4": None, "x": None, "": (0, 9), "  ": (0, 9), " Bytes= 2 - 4 ": (2, 4), "bytes=-0": None}
    df = spark.createDataFrame([(h, b"0123456789") for h in cases], "h string, content binary").withColumn("r", files.byte_range(F.col("h"), F.length("content").cast("long")))
    rows = df.withColumn("part", files.slice_bytes(F.col("content"), F.col("r"))).collect()
    assert {r["h"]: r["r"] and tuple(r["r"]) for r in rows} == cases
    assert next(r["part"] for r in rows if r["h"] == "bytes=2-4") == b"234"


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>List</t></is></c></row>
            <row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="inlineStr"><is><t>E-mail</t></is></c></row>
            <row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3" t="inlineStr"><is><t>a@b.vn</t></is></c></row><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>""")
    cells = files.read_workbooks(spark, str(tmp_path))
    assert {(r["row"], r["column"], r["value"]) for r in cells.collect()} == {(1, 1, "List"), (2, 2, "Name"), (2, 27, "E-mail"), (3, 2, "Anna"), (3, 27, "a@b.vn"), (4, 2, "7")}
    assert [(r["row"], r["name"], r["email"]) for r in files.account_rows(cells).collect()] == [(3, "Anna", "a@b.vn")]


def test_files(spark, tmp_path):
    (tmp_path / "up/7/8").mkdir(parents=True)
    (tmp_path / "up/7/8/source.pdf").write_bytes(b"%PDF")
    (tmp_path / "up/7/8/other.txt").write_text("x")
    assert [(r["guideline_id"], r["version_id"], r["length"]) for r in files.read_uploads(spark, f"{tmp_path}/up").collect()] == [(7, 8, 4)]
    (tmp_path / "md").mkdir()
    (tmp_path / "md/a.md").write_text("one\ntwo")
    (tmp_path / "md/b.md").write_text("three")
    md = files.read_markdown(spark, f"{tmp_path}/md")
    assert {tuple(r) for r in md.collect()} == {("a", "one\ntwo"), ("b", "three")}
    assert [r["stem"] for r in files.not_done(md, md.where("stem = 'a'")).collect()] == ["b"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text('[{"id": "x", "type": "text", "markdown": "m", "bboxes": [{"page": 1, "left": 0.5}]}, {"id": "y"}]')
    assert {(r["stem"], r["id"], r["type"]) for r in files.read_chunks(spark, f"{tmp_path}/c").collect()} == {("a", "x", "text"), ("a", "y", None)}


def test_assets(spark):
    uid = "0a1b2c3d-0000-1111-2222-333344445555"
    found = spark.createDataFrame([(f"/root/v/{uid}.png",), (f"/root/v/../{uid}.png",), (f"/other/{uid}.png",)], "path string")
    wanted = spark.createDataFrame([(uid.upper(),), ("no-uuid",), (None,)], "asset_id string")
    assert [r["path"] for r in files.assets_by_id(found, wanted, "/root/v").collect()] == [f"/root/v/{uid}.png"]


def test_replace_versions(spark, tmp_path):
    path = str(tmp_path / "sections")
    sinks.replace_versions(spark.createDataFrame([(1, "1", "a"), (2, "1", "b")], "version_id long, section_path string, content string"), path)
    sinks.replace_versions(spark.createDataFrame([(2, "1.2", "c")], "version_id long, section_path string, content string"), path)
    rows = sinks.section_rows(spark.read.parquet(path)).collect()
    assert {(r["version_id"], r["content"], r["level"], r["order_index"]) for r in rows} == {(1, "a", 1, 1), (2, "c", 2, 2)}
    assert sinks.conform(spark.range(1), "x string, id int").dtypes == [("x", "string"), ("id", "int")]


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x<a id='1'></a>\ny<!-- PAGE BREAK -->"), ("b", "z")], "stem string, text string")
    sinks.write_clean_markdown(texts, f"{tmp_path}/md")
    got = {r["stem"]: r["value"].removesuffix("\n") for r in spark.read.text(f"{tmp_path}/md", wholetext=True).collect()}
    assert got == {"a": "x\ny<!-- PAGE_BREAK -->", "b": "z"}
    sinks.write_trees(texts.select("stem", F.array(F.struct("text")).alias("toc")), f"{tmp_path}/toc")
    assert spark.read.json(f"{tmp_path}/toc").where("stem = 'b'").first()["toc"][0]["text"] == "z"
    sinks.write_artifacts(texts.selectExpr("1 as guideline_id", "2 as version_id", "text"), f"{tmp_path}/art")
    assert spark.read.json(f"{tmp_path}/art").where("guideline_id = 1 and version_id = 2").count() == 2
    box = "struct<page:int,left:double,top:double,right:double,bottom:double>"
    tree = spark.createDataFrame([(1, "1", "h", "c", None, None, 3, None, None, None, 0.123456), (1, "1.2", "i", "d", (1, 0.1, 0.2, 0.3, 0.4), None, None, None, None, None, None)], f"version_id long, section_path string, heading string, content string, heading_box {box}, boxes array<{box}>, page_start int, page_end int, start_y double, end_y double, score double")
    rows = {r["section_path"]: r for r in sinks.placed_sections(tree, spark.createDataFrame([(1, 9), (1, 8)], "version_id long, document_id long")).collect()}
    assert (rows["1"]["document_id"], rows["1"]["page_start"], rows["1"]["score"], rows["1"]["is_suspect"]) == (8, 3, 0.1235, True)
    assert (rows["1.2"]["page_start"], rows["1.2"]["start_y"], rows["1.2"]["is_suspect"], rows["1.2"]["parent_id"]) == (2, 0.2, False, rows["1"]["section_id"])


def test_half_precision(spark):
    import numpy as np

    values = [0.0, 1.0, -0.1, 3.14159, 65000.0, 1e-5, 1e-7, 0.333251953125, 2049.0, 2051.0]
    text = spark.range(1).select(sinks.half_precision(F.array(*map(F.lit, values)), len(values))).first()[0]
    assert [float(x) for x in text.strip("[]").split(",")] == [float(np.float16(v)) for v in values]
    assert spark.range(1).select(sinks.half_precision(F.array(F.lit(1.0)), 2)).first()[0] is None


def test_jobs_as_a_stream(spark, tmp_path):
    import datetime

    from docloom.streaming import job_feed

    at = datetime.datetime(2024, 1, 1)
    schema = "job_id long, version_id long, requested_at timestamp, status string"
    for k, rows in enumerate([[(1, 7, at, "queued"), (2, 8, at, "queued")], [(3, 7, at + datetime.timedelta(minutes=5), "queued"), (4, 9, at, "queued")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    jobs = job_feed.read_jobs(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
    job_feed.work_off(job_feed.accept_once(jobs), lambda b: b.select("version_id"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["version_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [7, 8, 9]
    events = spark.createDataFrame([(1, at, "queued", None), (1, at, "running", None), (1, at, "failed", "x" * 5000)], "job_id long, at timestamp, event string, message string")
    assert len(job_feed.failed_jobs(events).first()["error"]) == 4000


@pytest.mark.parametrize("strict", [True, False])
def test_rising_anchors(spark, strict):
    rows = [(v, i, (i * 37 + v * 11) % 5) for v in range(3) for i in range(7)]
    got = trees.rising_anchors(spark.createDataFrame(rows, "version_id long, idx long, position long"), strict).collect()

    def rises(p):
        return all(a < b or (a == b and not strict) for a, b in itertools.pairwise(p))

    for v in range(3):
        values = [p for w, _, p in rows if w == v]
        best = max(n for n in range(8) for c in itertools.combinations(values, n) if rises(c))
        mine = [r["position"] for r in sorted(got, key=lambda r: r["idx"]) if r["version_id"] == v]
        assert len(mine) == best and rises(mine)


def test_chunks_and_titles(spark):
    nodes = spark.createDataFrame([(1, [1], "A", "x" * 10), (1, [1, 1], "B", "y" * 10), (1, [1, 2], None, "z" * 40), (1, [2], "B", None)], "version_id long, path array<int>, heading string, content string")
    got = {tuple(r["path"]): (r["context"], r["text"]) for r in trees.pack_chunks(nodes, 20).collect()}
    above = "A\n\n" + "x" * 10
    assert got == {(1, 1): (above, "B\n\n" + "y" * 10), (1, 2): (above, "z" * 40), (2,): ("", "B")}
    assert {tuple(r["path"]) for r in trees.shallowest_titles(nodes, F.lower("heading")).collect()} == {(1,), (1, 2), (2,)}


def test_markup(spark):
    row = spark.range(1).select(
        markup.flow_steps(F.lit("a -> b → c -->")).alias("steps"), markup.bold_spans(F.lit("x **y z** **w**")).alias("bold"),
        markup.pack_paragraphs(F.lit("aaaa\n\nbb\n\ncccccccccccc\n\nd"), 8).alias("parts"), markup.pack_paragraphs(F.lit(None), 8).alias("none"),
    ).first()
    assert row["steps"] == ["a", "b", "c"] and row["bold"] == ["y z", "w"]
    assert row["parts"] == ["aaaa\n\nbb", "cccccccc", "cccc", "d"] and row["none"] == []
