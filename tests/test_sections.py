"""Boundaries and contents of sections, places on pages, merged outlines, rich blocks and numbered tables, by small cases and plain loops."""

import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import markup
from docloom.operators import boundaries, chunks, positions, sections, toc

NODE = "version_id long, idx int, path string, level int, title string, chunk_id string"


def headings(spark, titles, text):
    t = spark.createDataFrame([(1, k, x, 0, None) for k, x in enumerate(titles)], "version_id long, section_id int, title string, low int, high int")
    return {r["section_id"]: (r["offset"], round(r["score"], 6)) for r in boundaries.find_headings(t, spark.createDataFrame([(1, text)], "version_id long, text string")).collect()}


def test_headings_inside_lines(spark):
    one = "| foo | 1.2 Dosage of drugs | 14 and many other cells stand here\nnothing"
    assert headings(spark, ["1.2 Dosage of drugs"], one) == {0: (8, 1.0)}
    two = "intro\n2. Aims | this is a cell with a lot of words here"
    assert headings(spark, ["2. Aims"], two) == {0: (6, 1.0)}
    assert headings(spark, ["1.2 Dosage of drugs"], "11.2 Dosage of drugs and 31.2 Dosage of drugs that go on and on and on for long") == {}
    assert headings(spark, ["3 Side effects"], "side effects\n## 3 Side effects of it\nside effects 3") == {0: (37, 1.0)}


def words(text):
    return set(re.sub(r"[^\w\s]", " ", text.lower()).split())


def slow_heading(title, text, least=0.55):
    """The rules of a heading's place, line by line."""
    a, best = words(title), (0.0, None)
    m = re.match(r"^(\d[\d.]*)", title.strip())
    number = m and m[1].rstrip(".").lower()
    starts = lambda x: number and re.match(re.escape(number) + r"(?:[.\s]|$)", x.lower())
    limit, offset = max(2 * len(a) + 2, 8), 0

    def offer(sub, at):
        nonlocal best
        b = words(sub)
        score = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
        if score >= least:
            score = max(score, 0.9) if starts(sub) and len(b) <= limit else score
            best = (score, at) if score > best[0] else best

    for line in text.split("\n"):
        clean = re.sub(r"^#{1,6}\s*", "", re.sub(r"<[^>]+>", " ", line)).strip()
        if clean:
            offer(clean[: clean.find(" | ")] if starts(clean) and clean.find(" | ") > 0 else clean, offset)
            for x in re.finditer(re.escape(number) + r"(?=[.\s]|$)", line) if number and not starts(clean) else ():
                before = line[: x.start()]
                if before and not before[-1].isdigit() and not re.search(r"\d\.$", before):
                    sub = line[x.start() :]
                    sub = sub[: sub.find(" | ")] if sub.find(" | ") > 0 else sub
                    offer(re.sub(r"<[^>]+>", " ", sub).strip(), offset + x.start())
        offset += len(line) + 1
    return best


def test_headings_against_a_plain_loop(spark):
    random.seed(4)
    vocabulary = ["aims", "dose", "drug", "the", "of", "care", "1.2", "3", "2.1.4", "|", "##", "side"]
    lines = [" ".join(random.choice(vocabulary) for _ in range(random.randint(1, 9))) for _ in range(120)]
    text = "\n".join(lines)
    titles = [" ".join([random.choice(["1.2", "3", "2.1.4", "", "the"]), *(random.choice(vocabulary[:6]) for _ in range(random.randint(1, 4)))]).strip() for _ in range(60)]
    got = headings(spark, titles, text)
    for k, title in enumerate(titles):
        score, at = slow_heading(title, text)
        assert got.get(k) == (None if at is None else (at, round(score, 6))), title


def document(spark, parts):
    """A text of chunks (id, body), its chunks with places."""
    text = "".join(f"<a id='{i}'></a>\n\n{body}\n\n" for i, body in parts)
    c = [(1, k, i, "table" if body.startswith("[") else "text", f"<a id='{i}'></a>\n\n{body}", [(k // 2, 0.1, 0.2, 0.9, 0.3 + k / 100)]) for k, (i, body) in enumerate(parts)]
    kind = f"version_id long, pos int, id string, type string, text string, boxes array<{positions.BOX}>"
    texts = spark.createDataFrame([(1, text)], "version_id long, text string")
    return text, texts, chunks.chunk_offsets(spark.createDataFrame(c, kind), texts)


def outline(spark, nodes):
    above, rows = [], []
    for k, (level, title, chunk) in enumerate(nodes):
        above = [*above[: level - 1], title]
        rows.append((1, k, "/".join(above), level, title, chunk))
    return spark.createDataFrame(rows, NODE)


def test_siblings_in_one_chunk(spark):
    parts = [("a", "# Care of wounds\nfirst text\n# Dose of drugs\nsecond text"), ("b", "more of the second\n# Side effects here\nthird text"), ("c", "# Last chapter\nend")]
    text, texts, placed = document(spark, parts)
    # split in the chunk; the third is found only beyond it
    rows = [(1, "Care of wounds", "a"), (1, "Dose of drugs", "a"), (1, "Side effects here", "a"), (1, "Last chapter", "c")]
    nodes = outline(spark, rows)
    got = {r["title"]: r for r in chunks.section_nodes(nodes, placed, texts).collect()}
    dose, side, last = (text.index(x) for x in ("# Dose", "# Side", "# Last"))
    assert [(r["start"], r["end"]) for r in got.values()] == [(text.index("# Care"), dose), (dose, side), (side, last), (last, len(text))]
    assert [r["content"] for r in got.values()] == ["first text", "second text\n\nmore of the second", "third text", "end"]
    assert {r["score"] for r in got.values()} == {1.0} and got["Care of wounds"]["node_id"] == hashlib.sha1(b"Care of wounds").hexdigest()[:12]
    # a heading that is nowhere splits nothing: what is before it would end before it begins, and has no text
    nodes = outline(spark, [*rows[:3], (1, "Nowhere at all", "a"), rows[3]])
    got = {r["title"]: r for r in boundaries.section_bounds(nodes, placed, texts).collect()}
    assert (got["Side effects here"]["start"], got["Side effects here"]["end"]) == (side, None)
    assert (got["Nowhere at all"]["start"], got["Nowhere at all"]["end"]) == (0, last)


def test_children_and_what_follows_their_parent(spark):
    parts = [("a", "# One\nintro of one\n## Part A of one\ntext A"), ("t", "[cells]"), ("b", "before\n## Part B of one\ntext B\n# Two begins\ntext two"), ("c", "tail")]
    text, texts, placed = document(spark, parts)
    nodes = outline(spark, [(1, "One", "a"), (2, "Part A of one", "a"), (2, "Part B of one", "b"), (1, "Two begins", "b")])
    got = {r["title"]: r for r in chunks.section_nodes(nodes, placed, texts).collect()}
    assert got["One"]["content"] == "intro of one"
    assert got["Part A of one"]["start"] == text.index("## Part A") and got["Part B of one"]["start"] == text.index("## Part B")
    assert got["Part B of one"]["end"] == text.index("# Two") and got["Two begins"]["start"] == text.index("# Two")
    assert got["Part B of one"]["content"] == "text B" and got["Two begins"]["content"] == "text two\n\ntail"
    assert "[table:t]" in got["Part A of one"]["content"] and got["Part A of one"]["content"].startswith("text A")
    assert [x["id"] for x in got["Part A of one"]["landing_chunks"]] == ["t"]


def test_odd_outlines(spark):
    text, texts, placed = document(spark, [("a", "x"), ("b", "y")])
    # later siblings earlier in the text, chunks that are not there, a parent behind its children, no titles' words
    nodes = outline(spark, [(1, "!!", "b"), (2, "y", "a"), (1, "none", None), (1, "x", "a"), (1, "gone", "zz")])
    got = {r["idx"]: r for r in boundaries.section_bounds(nodes, placed, texts).collect()}
    assert got[0]["first"] == 0 and got[2]["start"] is None and got[4]["first"] is None and len(got) == 5
    assert boundaries.section_bounds(nodes.limit(0), placed, texts).count() == 0
    assert chunks.section_nodes(nodes, placed, texts).count() == 5


def test_text_behind_headings(spark):
    cases = [("Aims", "## Aims\nbody", "body"), ("Aims", "all other words\nbody text", "all other words\nbody text"), ("Dose of drug", "Dose of drug: take two\nmore", " take two\nmore"), ("", "x", "x"), ("Long title here", "text text\ntext more\ntext most\nthe long title here maybe also so", "text text\ntext more\ntext most\nthe long title here maybe also so")]
    df = spark.createDataFrame(cases, "title string, text string, want string")
    for r in df.select("want", boundaries.without_heading(F.col("text"), F.col("title")).alias("got")).collect():
        assert r["got"] == r["want"]


def section_rows(spark, rows):
    return spark.createDataFrame(rows, "version_id long, section_id long, level int, page_start int, start_y double, page_end int, end_y double")


def test_sections_at_points(spark):
    at = lambda rows, page, y: sections.section_at(spark.createDataFrame([(1, page, y)], "version_id long, page int, y double"), section_rows(spark, rows)).first()["section_id"]
    assert at([(1, 10, 2, 1, 0.1, 2, 0.9), (1, 11, 1, 1, 0.5, 2, 0.6)], 1, 0.7) == 10
    assert at([(1, 1, 1, 1, 0.1, 1, 0.9), (1, 2, 1, 3, 0.5, 3, 0.8)], 3, 0.1) == 2
    assert at([(1, 1, 1, 2, 0.1, 2, 0.9)], 1, 0.5) is None
    assert at([(1, 1, 1, 2, 0.1, 2, 0.9), (1, 2, 2, 2, None, None, None)], 5, 0.5) == 2
    assert at([(1, 1, 1, 2, 0.1, 2, 0.9), (1, 2, 2, 2, None, 2, None)], 2, 0.5) == 1


def nested(rows):
    roots, open_ = [], []
    for title, level in rows:
        node = [title, []]
        open_ = [x for x in open_ if x[1] < level]
        (open_[-1][0][1] if open_ else roots).append(node)
        open_.append((node, level))
    return roots


def merged(spark, base, new, lock=1):
    def frame(rows):
        return spark.createDataFrame([(1, k, t, level, t, None) for k, (t, level) in enumerate(rows)], NODE)

    return [(r["title"], r["level"]) for r in toc.merge(frame(base), frame(new), lock).orderBy("idx").collect()]


def test_merges_move_bypass_and_keep_slashes(spark):
    assert merged(spark, [("A", 1)], [("A", 1), ("B", 2)], lock=2) == [("A", 1), ("B", 2)]
    assert merged(spark, [("A", 1), ("X", 2), ("Y", 2)], [("A", 1), ("X", 1)], lock=0) == [("A", 1), ("Y", 2), ("X", 1)]
    assert merged(spark, [("A", 1), ("X", 2)], [("A", 1), ("X", 1)], lock=1) == [("A", 1), ("X", 2)]
    assert merged(spark, [("A", 1), ("x", 2)], [("A", 1), ("HIV/AIDS", 2), ("more", 3)]) == [("A", 1), ("x", 2), ("HIV/AIDS", 2), ("more", 3)]


def test_merges_of_random_trees_keep_the_base_and_take_what_is_new(spark):
    random.seed(3)
    for _ in range(4):
        base, new = ([(random.choice("abcdefgh/") + str(random.randint(1, 3)), min(k + 1, random.randint(1, 3))) for k in range(12)] for _ in range(2))
        got = merged(spark, base, new, lock=0)
        assert {t for t, level in new if level == 1} <= {t for t, _ in got}
        tops = [t for t, level in got if level == 1]
        assert tops[: len(nested(base))] == [x[0] for x in nested(base)]


def test_blocks_of_rich_texts(spark):
    cases = {
        "<:: flow\nA\n->\nB\n: flow ::>": ["flowchart"], "<:: flow : A -> B": ["flowchart"], "<:: something : custom body : something ::>": ["custom"],
        "<:: unknown block with missing ending": ["text"], "text [table:id-1] text [figure:id-2]": ["text", "asset", "text", "asset"],
        '<table><tr><th>h</th></tr><tr><td colspan="2">v</td></tr></table>': ["table"], "<table><tr><td>x": ["text"],
        "[note:id-1]": ["text"], "[Figure:ab 1]": ["asset"], "<:: a b\n<:: kind : value ::> end": ["text", "custom", "text"], "<:: ::>": [], None: [], "": [],
    }
    for text, want in cases.items():
        assert [kind for kind, _ in markup.blocks_of(text)] == want, text
    values = dict(markup.blocks_of("<:: something : custom body : something ::> [Figure: ab 1 ]"))
    assert values == {"custom": "custom body", "asset": "[Figure: ab 1 ]"}
    df = spark.createDataFrame([(3, "a [table:x] b"), (4, None)], "k long, `a.b` string")
    assert [tuple(r) for r in markup.content_blocks(df, "k", "a.b").collect()] == [(3, 0, "text", "a"), (3, 1, "asset", "[table:x]"), (3, 2, "text", "b")]
    found = spark.range(1).select(markup.placeholders(F.lit("[note:1] [Figure:ab 1] [table: z ]")).alias("p"), markup.flow_steps(F.lit("a => b ⬇ c")).alias("s")).first()
    assert [tuple(x) for x in found["p"]] == [("figure", "ab 1"), ("table", "z")] and found["s"] == ["a", "b", "c"]


def test_tables_are_numbered_on_across_parts(spark):
    mark = "<!-- PAGE_BREAK -->"
    page = lambda k, tables: f"page {k} with words that are only here, number {k} of all pages\n" + "".join(f'<table id="{t}-1"><td id="{t}-2">x</td></table>\n' for t in tables)
    pages = [page(k, [k] if k % 2 == 0 else []) for k in range(12)]

    def part(first, last):
        own, n, out = [], 0, []
        for k in range(first, last):
            text = pages[k]
            if k % 2 == 0:
                text = text.replace(f'"{k}-', f'"{n}-')
                n += 1
            out.append(text)
        return mark.join(out)

    got = chunks.numbered_tables([part(0, 6), part(3, 9), part(6, 12)])
    numbers = [[int(x) for x in re.findall(r'<table id="(\d+)-', p)] for p in got]
    assert numbers == [[0, 1, 2], [2, 3, 4], [3, 4, 5]]
    assert '<td id="4-2">' in got[1]
    assert chunks.numbered_tables(["no tables", '<table id="5-1">']) == ["no tables", '<table id="5-1">']


@pytest.mark.parametrize("share", [(273, 448), (1, 2), (1, 3), (125, 1000)])
def test_heights_round_by_their_binary_value(spark, share):
    y = 0.2 + (0.7 - 0.2) * (share[0] / share[1])
    df = spark.createDataFrame(pd.DataFrame({"y": [y, 0.0000005, 0.0000015]}))
    assert [r[0] for r in df.select(positions.binary_round(F.col("y"))).collect()] == [round(y, 6), round(0.0000005, 6), round(0.0000015, 6)]


def test_contradictions_lose_their_chunks_but_landmarks_do_not(spark):
    nodes = spark.createDataFrame([(1, k, f"t{k}", 1, f"t{k}", c) for k, c in enumerate(["a", "z", "b", "y", None])], NODE)
    kept = spark.createDataFrame([(1, 0), (1, 2)], "version_id long, idx int")
    got = toc.clear_contradictions(nodes, kept, F.col("idx") == 3).orderBy("idx").collect()
    assert [r["chunk_id"] for r in got] == ["a", None, "b", "y", None]


def test_pages_and_anchors_of_offsets(spark):
    text = "one <br> two <br> three <a id='x'></a>"
    df = spark.createDataFrame([(text,)], "t string").withColumn("b", positions.break_offsets(F.col("t"), "<br>"))
    r = df.select("b", *(positions.page_of_offset(F.lit(k), F.col("b")).alias(f"p{k}") for k in (0, 4, 12, 13, 30)), positions.anchor_offset(F.col("t"), F.lit("x")).alias("a"), positions.anchor_offset(F.col("t"), F.lit("y")).alias("n")).first()
    assert r["b"] == [4, 13] and [r[f"p{k}"] for k in (0, 4, 12, 13, 30)] == [1, 2, 2, 3, 3] and (r["a"], r["n"]) == (text.index("<a"), -1)


def test_boxes_of_chunks_in_their_order(spark):
    box = (0, 0.1, 0.2, 0.9, 0.3)
    c = spark.createDataFrame([(1, "a", "text", [box]), (1, "b", "figure", [])], f"version_id long, id string, type string, boxes array<{positions.BOX}>")
    s = spark.createDataFrame([(1, 7, ["b", "zz", "a"])], "version_id long, section_id int, chunk_ids array<string>")
    got = chunks.with_boxes(s, c).first()["chunks"]
    assert [(x["id"], x["type"]) for x in got] == [("b", "figure"), ("zz", None), ("a", "text")] and got[0]["box"] is None and tuple(got[2]["box"]) == box


def test_pixels_and_flipped_heights(spark):
    r = spark.range(1).select(positions.in_pixels(F.struct(*(F.lit(v).alias(k) for k, v in zip(("left", "top", "right", "bottom"), (0.1, 0.2, 0.5, 0.4), strict=True))), F.lit(100), F.lit(200)).alias("p"), positions.flipped(F.lit(30.0), F.lit(100.0)).alias("y")).first()
    assert [round(x, 6) for x in r["p"]] == [10, 40, 40, 40] and r["y"] == 70
