from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import access


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_accent_table_has_67_letters():
    source, target = T.accent_table()
    assert len(source) == len(target) == 67 and set(target) == set("aeiouyd")


def test_search_key(spark):
    assert one(spark, T.search_key, "Trạm Y-tế Đống Đa 1") == "tramytedongda1"
    assert one(spark, T.search_key, None) == ""
    assert T.literal_search_key("  Trạm Y tế ñ") == "tramyten"


def test_markup_keeps_page_breaks(spark):
    text = "a<a id='x'></a><A name=y></a><!-- note -->b<!-- PAGE BREAK -->c<!--pagebreak-->d<!-- PAGE  BREAK -->e<!-- page_break -->f<a x>g</a>"
    assert one(spark, T.clean_markup, text) == "ab<!-- PAGE_BREAK -->c<!-- PAGE_BREAK -->d<!-- PAGE_BREAK -->e<!-- PAGE_BREAK -->f<a x>g</a>"
    audit = one(spark, T.cleaning_audit, text)
    assert audit["expected"] == audit["found"] and audit["same_breaks"] and audit["anchors"] == len("<a id='x'></a><A name=y></a>")


def test_section_text(spark):
    assert one(spark, T.section_text, "  a\n 12 \n\n\n\nb<!-- PAGE BREAK -->c\n") == "a\n\nb\nc"


def test_dice_of_nothing_is_zero(spark):
    row = spark.createDataFrame([("a b", "b c", "")], "x string, y string, z string").select(T.dice(T.words(F.col("x")), T.words(F.col("y"))), T.dice(T.words(F.col("x")), T.words(F.col("z")))).first()
    assert tuple(row) == (0.5, 0.0)


def test_ancestors_stop_at_cycles_and_missing_parents(spark):
    users = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "user_id long, parent_id long")
    assert sorted(map(tuple, access.ancestors(users).collect())) == [(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 3, 0)]


def test_ancestors_have_no_limit_of_depth(spark):
    """A chain of 20 users below an administrator, with a health station two steps below it."""
    rows = [(k, k - 1 if k else None, {0: "admin", 2: "health_station"}.get(k, "doctor"), True) for k in range(21)]
    users = spark.createDataFrame(rows, "user_id long, parent_id long, role string, inherits boolean")
    assert sorted(map(tuple, access.ancestors(users).collect())) == sorted((k, k - d, d) for k in range(21) for d in range(k + 1))
    assert sorted(map(tuple, access.descendants(users, 3).collect())) == [(k, k - 3) for k in range(3, 21)]
    assert {tuple(r) for r in access.visible_owners(users).where("user_id = 20").collect()} == {(20, k) for k in range(21)}
    assert {r[0]: r[1] for r in access.station_scope(users).collect()} == {k: k >= 2 for k in range(21)}
    assert {r[0]: r[1] for r in access.subtree_height(users).collect()} == {k: 20 - k for k in range(21)}


def test_visible_owners_with_several_administrators(spark):
    """Two administrators, one below the other, see their own; users below see all administrators, unless one on the way does not inherit."""
    rows = [(1, None, "admin", True), (2, None, "admin", True), (3, 1, "admin", True), (4, 3, "hospital", True), (5, 4, "doctor", True), (6, 4, "doctor", False), (7, None, "hospital", True), (8, 7, "doctor", True)]
    users = spark.createDataFrame(rows, "user_id long, parent_id long, role string, inherits boolean")
    got = {}
    for r in access.visible_owners(users).collect():
        got.setdefault(r["user_id"], set()).add(r["owner_id"])
    assert got == {1: {1}, 2: {2}, 3: {3, 1}, 4: {4, 1, 2, 3}, 5: {5, 4, 1, 2, 3}, 6: {6, 4}, 7: {7}, 8: {8, 7}}
    assert {tuple(r) for r in access.visible_owners(users, users.where("user_id = 6")).collect()} == {(6, 6), (6, 4)}


def test_overlaps_of_scanned_parts(spark):
    from docloom.operators import chunks

    line = [f"line {k} of a text that is long enough to be told from all others" for k in range(12)]
    parts = spark.createDataFrame([(1, 1, "\n".join(line[5:])), (1, 0, "\n".join(line[:8])), (2, 0, " one "), (2, 1, "two")], "version_id long, part int, text string")
    got = {r[0]: r[1] for r in chunks.join_parts(parts).collect()}
    assert [x for x in got[1].split("\n") if x] == line and got[2] == "one\n\ntwo"


def test_contents_merge_below_their_parents(spark):
    from docloom.operators import toc

    node = "version_id long, idx int, path string, level int, title string, chunk_id string"
    base = spark.createDataFrame([(1, 0, "Chương 1", 1, "Chương 1", "a"), (1, 1, "Chương 1/x", 2, "x", None), (1, 2, "Chương 2", 1, "Chương 2", "b")], node)
    new = spark.createDataFrame([(1, 0, "## Chương 1", 1, "## Chương 1", None), (1, 1, "## Chương 1/y", 2, "y", "c"), (1, 2, "## Chương 1/y/z", 3, "z", None), (1, 3, "## Chương 1/Chương 2 b", 2, "Chương 2 b", None), (1, 4, "new", 1, "new", None)], node)
    got = [r["path"] for r in toc.merge(base, new).orderBy("idx").collect()]
    assert got == ["Chương 1", "Chương 1/x", "Chương 1/y", "Chương 1/y/z", "Chương 2"]


def test_json_of_language_models(spark):
    from docloom.functions import jsons

    good = '{"a": [1, {"b": "x, y"}]}'
    cases = {good: good, f"```json\n{good}\n```": good, f"Sure: {good} bye": good, '{"a": [1, 2, ': '{"a": [1, 2]}', '{"a": "b", "c": "d': '{"a": "b"}', "none": None}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r["x"]: r["y"] for r in jsons.repair(df, "x", "y").collect()} == cases
    assert jsons.repaired(None) is None


def test_attribute_blocks_keep_bodies(spark):
    from docloom.operators import chunks

    text = "a <::Step one\ngo on\n: flowchart::> b <::A picture of x\n: figure::> c <::logo::> d <:: open"
    assert one(spark, chunks.without_attributes, text) == "a Step one\ngo on b  c  d "


def test_changes_of_accounts(spark):
    from docloom.operators import users as U

    rows = [(1, "r@x", "admin", None, True, True), (2, "h@x", "health_department", 1, True, True), (3, "k@x", "hospital", 2, True, True), (4, "d@x", "doctor", 3, True, True)]
    users = spark.createDataFrame(rows, "user_id long, email string, role string, parent_id long, inherits boolean, is_active boolean")
    moved = U.change_role(users, 3, "health_station", 1, parent_id=2)
    assert {(r["user_id"], r["role"], r["parent_id"]) for r in moved.collect()} == {(1, "admin", None), (2, "health_department", 1), (3, "health_station", 2), (4, "doctor", 3)}
    shut = {r["user_id"]: r["inherits"] for r in U.change_role(users, 2, "health_department", 1, inherits=False).collect()}
    assert shut == {1: True, 2: False, 3: False, 4: False}
    guidelines = spark.createDataFrame([(7, 4), (8, 1)], "guideline_id long, owner_id long")
    left, kept, gone = U.delete_users(users, guidelines, 3)
    assert {r[0] for r in left.select("user_id").collect()} == {1, 2} and [r["guideline_id"] for r in kept.collect()] == [8] and [r["guideline_id"] for r in gone.collect()] == [7]


def test_a_new_guideline_has_a_version_and_a_document(spark):
    import datetime

    import pytest

    from docloom.operators import versions

    g = spark.createDataFrame([(4, "old")], "guideline_id long, title string")
    v = spark.createDataFrame([(9, 4, "1", "active", None)], "version_id long, guideline_id long, label string, status string, effective_from date")
    d = spark.createDataFrame([], "document_id long, version_id long, path string")
    tables = versions.create_guideline(g, v, d, {"title": " new "}, {"effective_from": datetime.date(2024, 1, 1)}, {"path": "p"})
    assert [sorted(map(tuple, t.collect()))[-1] for t in tables] == [(5, "new"), (10, 5, "1", "processing", datetime.date(2024, 1, 1)), (1, 10, "p")]
    with pytest.raises(ValueError):
        versions.create_guideline(g, v, d, {"title": " "}, {}, {})


def test_point_lookup(spark):
    import pytest

    from docloom.plans import listing

    t = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert listing.point_lookup(t, "id", 1).count() == 1
    for value, error in ((3, listing.NotFound), (2, ValueError)):
        with pytest.raises(error):
            listing.point_lookup(t, "id", value)
