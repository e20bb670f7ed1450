"""Findings of round 3: odd documents through registered queries against their SQL, and plans that grow with their input."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.operators import boundaries, chunks, toc
from docloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def of_documents(spark, tmp_path):
    """A query over given texts, its rows and those of its SQL."""

    def run(name, texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted(repr([r[c] for c in columns]) for r in df.collect())
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        cursor = c.execute(ORACLE_SQL[name])
        at = [x[0] for x in cursor.description]
        return got, sorted(repr([r[at.index(c)] for c in columns]) for r in cursor.fetchall())

    return run


def test_headings_by_type_of_numbers_with_many_parts(of_documents):
    """Host addresses and marks behind a number: the query's outline has two levels, as in its SQL."""
    got, sql = of_documents("headings_by_type", ["88.189.45.142 Host abcd", "a line.\n1)ab.cd.ef gh\n12.ab.cd efgh\n3.1 abcd\n1.2.3 abcdef", "plain.\n\nmore of it."])
    assert got == sql and len(sql) >= 4


def test_windows_meet_no_landmarks_one_by_one(spark):
    """Ranges at, before and behind landmarks, without any, and without places; no range carries its version's landmarks."""
    marks = [(1, 0, 9), (1, 10, 40), (1, 10, 30), (1, 20, 80), (1, 30, 60), (1, None, 99), (2, None, 7), (4, 5, None)]
    ranges = [(v, a, b) for v in (1, 2, 3, 4) for a in (None, -1, 0, 5, 10, 15, 20, 30, 40) for b in (None, -1, 0, 10, 11, 30, 31)] + [(1, 10, 30)]
    n = {1: 100, 2: 50, 3: 20, 4: 10}

    def plain(v, first, last):
        own = [m for m in marks if m[0] == v]
        of = lambda keep: [p for _, i, p in own if i is not None and p is not None and keep(i)]
        before, earlier = (max(of(lambda i, f=f: first is not None and f(i)), default=0) for f in (lambda i: i <= first, lambda i: i < first))
        behind = min(of(lambda i: last is not None and i >= last), default=n[v])
        low, high = max((earlier + before) // 2 if earlier > 0 else 0, before - toc.BUFFER), min(n[v], behind + 2)
        if not own:
            return 0, n[v]
        return (low, high) if low < high else (max(0, before - toc.BUFFER), min(n[v], before + 4 * toc.BUFFER))

    m = spark.createDataFrame(marks, "version_id long, idx long, position long")
    r = spark.createDataFrame(ranges, "version_id long, first long, last long")
    df = toc.windows(r, m, spark.createDataFrame(list(n.items()), "version_id long, n int"))
    got = sorted(((x.version_id, x.first, x.last, x.low, x.high) for x in df.collect()), key=repr)
    assert got == sorted(((*x, *plain(*x)) for x in ranges), key=repr)
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_words_of_lines_are_not_shuffled(spark, of_documents):
    """Titles meet lines inside their text's row: only titles, texts and what was found move. A document of more titles than meet lines at once, equal lines, tags and empty ones."""
    many = "\n".join(f"{'<b>' if k % 7 == 0 else ''}alpha w{k % 90} w{k % 13} beta{'</b> | x' if k % 7 == 0 else ''}" for k in range(3000))
    got, sql = of_documents("find_headings", [many, "", "\n\n", "one two three\n## one two\n1.1 one\none two three four\n\nÉté à Huế", "same\n" * 700])
    assert got == sql and len(sql) > 700
    texts = spark.createDataFrame([(1, "a b\nc d")], "version_id long, text string")
    titles = spark.createDataFrame([(1, 0, "c d")], "version_id long, section_id int, title string")
    df = boundaries.heading_candidates(titles, texts)
    assert [(r.offset, r.kind, r.score) for r in df.orderBy("kind").collect()] == [(4, boundaries.LINE, 1.0), (4, boundaries.BEGINNING, 1.0)]
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 6  # of titles and texts, each shown twice by an adaptive plan


def test_heading_outline_moves_headings_only(spark, of_documents, tmp_path):
    """Marks, tags, numbers, capitals and equal headings in turn, as in the SQL; texts are not taken apart and gathered again."""
    got, sql = of_documents("heading_outline", ["# A b\nA b\nTHE WHOLE LINE\n\nTHE WHOLE LINE\n12, 13\n<i></i>\n* *\nIV. four\nmục 3\n1.2. two", "", "\n\nabcde\nABCDEFGHIJ"])
    assert got == sql and len(sql) > 4
    assert "collect_list" not in QUERIES["heading_outline"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_section_spans_go_to_python_many_at_once(spark, of_documents, tmp_path):
    """A group for each table of contents cost more than its work; here documents of one line, of many, and empty ones."""
    got, sql = of_documents("section_spans", ["one", "", *("\n".join(f"l {i} {k}" for i in range(k)) for k in range(1, 40))])
    assert got == sql and len(sql) > 300
    assert "FlatMapGroups" not in QUERIES["section_spans"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_sections_meet_by_their_document_alone(spark, tmp_path):
    """Texts, chunks and nodes move once, to their document: nothing is dealt out anew by an id or number inside of it, and no outline is a group of its own."""
    spark.createDataFrame([(1, "# One\n\nmore of it\n## Two\nlast"), (2, ""), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("section_boundaries", "section_contents", "section_nodes"):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
        assert dealt and all(re.fullmatch(r"version_id#\d+L", x) for x in dealt), (name, dealt)
        assert "CoGroup" not in plan
        assert sorted((r["version_id"], r["idx"]) for r in df.collect()) == [(1, 0), (1, 2), (1, 4), (2, 0)]


def test_offsets_of_chunks_with_odd_ids(spark):
    """Repeated anchors and ids, ids without an anchor, null ones, and versions that only one side has; a chunk's text is not asked for."""
    texts = spark.createDataFrame([(1, "ab<a id='x'></a>cd<a id='y'></a><a id='x'></a>e"), (2, "no anchor"), (4, None)], "version_id long, text string")
    c = spark.createDataFrame([(1, 0, "y"), (1, 1, "gone"), (1, 2, "x"), (1, 3, None), (1, 4, "y"), (2, 0, "x"), (3, 0, "x"), (4, 0, "x")], "version_id long, pos int, id string")
    got = sorted((r.version_id, r.pos, r.id, r.start, r.end) for r in chunks.chunk_offsets(c, texts).collect())
    assert got == [(1, 0, "y", 18, 2), (1, 1, "gone", -1, 2), (1, 2, "x", 2, 18), (1, 3, None, -1, 18), (1, 4, "y", 18, 47), (2, 0, "x", -1, 9), (4, 0, "x", -1, None)]


def test_titles_move_once_with_their_windows(spark, tmp_path):
    """Windows that begin late, end early or hold nothing, more titles than meet lines at once, and a text under two rows; titles are read and dealt out once, and candidates stay with their text."""
    text = "\n".join(["alpha beta"] * 40 + ["| x | 1.2 gamma delta | y"] + ["alpha beta gamma"] * 3)
    last, whole = 40 * 11, "alpha beta"
    asked = [(k, whole, 11 * k - 3, None) for k in range(300)] + [(300, whole, 12, 22), (301, whole, 12, 23), (302, whole, 40 * 11, None), (303, "1.2 gamma delta", 0, None), (304, "1.2 gamma delta", 0, last + 6), (305, None, 0, None), (None, whole, 0, None)]
    titles = spark.createDataFrame([(v, *x) for v in (1, 2, 3) for x in asked], "version_id long, section_id int, title string, low int, high int")
    texts = spark.createDataFrame([(1, text), (2, None), (4, text), (1, "no\nalpha beta")], "version_id long, text string")
    got = {r["section_id"]: (r["version_id"], r["offset"], round(r["score"], 6)) for r in boundaries.find_headings(titles, texts).collect()}
    late = last + len("| x | 1.2 gamma delta | y") + 1
    want = {k: (1, 3 if k == 0 else 11 * k, 1.0) for k in range(40)} | {k: (1, late + 17 * max(0, -(-(11 * k - 3 - late) // 17)), 0.8) for k in range(40, 300) if 11 * k - 3 <= late + 34}
    assert got == want | {0: (1, 0, 1.0), 301: (1, 22, 1.0), 302: (1, late, 0.8), 303: (1, last + 6, 1.0), 304: (1, last, 0.8)}
    spark.createDataFrame([(1, "# One\n\nmore of it\n## Two\nlast")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["find_headings"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Join") == 1


def test_columns_score_only_numbers_inside_lines(spark):
    """Lines with numbers first and inside, bars, letters, tags, and words on every line; whole lines and beginnings are scored without columns for each pair."""
    lines = ["1.2 dose of drug | a b c d e f", "x 1.2 dose of drug | y", "11.2 dose of drug", "<i>1.2</i> dose of drug", "A. dose of drug", "## dose of drug and eight more words stand here at its end", "<1.2 dose of drug>", "dose of drug 1.2"]
    starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    titles = spark.createDataFrame([(1, 0, "1.2 dose of drug"), (1, 1, "B. dose of drug"), (1, 2, "dose of drug"), (1, 3, "!"), (1, 4, None)], "version_id long, section_id int, title string")
    df = boundaries.heading_candidates(titles, spark.createDataFrame([(1, "\n".join(lines))], "version_id long, text string"))
    got = {k: {(lines[max(n for n, at in enumerate(starts) if at <= r.offset)], r.kind): round(r.score, 4) for r in df.where(f"section_id = {k}").collect()} for k in range(5)}
    line, inside, begin = boundaries.LINE, boundaries.INSIDE, boundaries.BEGINNING
    both = lambda k, score: {(lines[k], line): score, (lines[k], begin): score}
    assert got[0] == {(lines[0], line): 1.0, (lines[0], begin): 0.6667, **both(1, 0.8333), (lines[1], inside): 1.0, (lines[2], line): 0.8, **both(3, 1.0), **both(4, 0.6667), **both(7, 1.0), (lines[7], inside): 0.9}
    assert got[1] == {(lines[2], line): 0.6667, (lines[3], line): 0.6667, (lines[4], line): 0.75, **both(7, 0.6667)}
    assert got[2] == {**both(1, 0.6), **both(2, 0.75), **both(3, 0.75), **both(4, 0.8571), **both(7, 0.75)} and not got[3] and not got[4]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") <= 1


def test_a_text_is_measured_once(spark):
    """Sizes of a text are not computed anew for each of its anchors."""
    texts = spark.createDataFrame([(1, "<a id='x'></a>ab<a id='y'></a>")], "version_id long, text string")
    c = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "version_id long, pos int, id string")
    df = chunks.chunk_offsets(c, texts)
    assert sorted((r.pos, r.start, r.end) for r in df.collect()) == [(0, 0, 16), (1, 16, 30), (2, -1, 30)]
    sized = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "length(text" in x]
    assert sized and all("Generate" in x for x in sized)


def test_a_heading_is_looked_for_once(spark):
    """Lines of a section meet its title once, whatever of the best one is asked for after."""
    rows = [("Dose of drug", "x\nDose of drug: take two\nmore\nof\nit\nall"), ("Dose", "<:: a\nfigure ::>## Dose\nbody"), ("Dose", None), ("Dose", ""), (None, "Dose\nx")]
    df = spark.createDataFrame(rows, "title string, text string")
    df = df.select(boundaries.without_heading(chunks.without_attributes(F.col("text")), F.col("title")).alias("got"))
    assert [r.got for r in df.collect()] == [" take two\nmore\nof\nit\nall", "body", None, "", "Dose\nx"]
    assert df._jdf.queryExecution().analyzed().toString().count("array_max") == 1


def test_keys_of_noise_are_made_at_edges_only(spark):
    """Of chunks that tell their type and boxes, only text in a header or footer is compared with others; the noise is the same."""
    box = lambda top: [(0, 0.1, top, 0.9, top)]
    rows = [(1, k, f"k{k}", kind, "<a id='k'></a>3 | Same  words", top) for k, (kind, top) in enumerate([("text", box(0.01)), ("text", box(0.5)), ("figure", box(0.01)), ("text", []), ("text", None), ("text", box(0.99))])]
    c = spark.createDataFrame(rows, "version_id long, pos int, id string, type string, text string, boxes array<struct<page:int,left:double,top:double,right:double,bottom:double>>")
    assert [r.noise_key for r in chunks.measured(c).orderBy("pos").collect()] == ["same words", None, None, None, None, "same words"]
    placed = c.withColumn("start", F.col("pos") * 10).withColumn("end", F.col("pos") * 10 + 10)
    noise = lambda df: sorted(map(tuple, chunks.noise_intervals(df, 2).collect()))
    assert noise(placed) == noise(chunks.measured(placed)) == [(1, 0, 10, ""), (1, 20, 30, "[figure:k2]"), (1, 50, 60, "")]


def test_texts_meet_their_titles_a_few_at_once():
    """Blocks add up to what a step may hold, so that memory does not grow with what Spark passes at once; a larger item is a block of its own."""
    import numpy as np

    assert [(x.start, x.stop) for x in boundaries._blocks(np.array([1, 5, 1, 2, 0, 1]), 3)] == [(0, 1), (1, 2), (2, 5), (5, 6)]
    assert boundaries.CHARACTERS_AT_ONCE <= 1 << 21 and not list(boundaries._blocks(np.array([], int), 3))
