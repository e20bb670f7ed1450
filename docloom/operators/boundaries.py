"""Boundaries of sections: places in a text that can be a title's heading, and where sections begin and end that share chunks.

Candidates are found for all titles of all documents at once; what must go in order, as one split moves the next search on,
is a fold over each document's table of contents that sees only titles' numbers, chunks' places and candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Least Dice coefficient of a heading, and of a child's heading in its parent's chunk; characters that a search reaches, and beyond a boundary.
SCORE, CHILD_SCORE, REACH, SLACK = 0.55, 0.55 * 0.82, 60_000, 5_000
_NUMBER, _LETTER, _BLANK = r"^(\d[\d.]*)", r"^([A-Za-z])\.", r"[\s\u0085\u2028\u2029]"
#: Kinds of candidates: a line, a number inside a line, and the beginning of a line (which refines a chunk's start).
LINE, INSIDE, BEGINNING = range(3)


def bare_line(line: Column) -> Column:
    """A line without tags and heading marks."""
    return T.strip_text(F.regexp_replace(F.regexp_replace(line, r"<[^>]+>", " "), r"^#{1,6}\s*", ""))


def _without_tags(line: Column) -> Column:
    """As ``bare_line``, but for its last marks; without patterns where there is nothing to find."""
    marks = lambda x: F.when(F.startswith(x, F.lit("#")), F.regexp_replace(x, r"^#{1,6}", "")).otherwise(x)
    return F.btrim(T.let(F.when(F.contains(line, F.lit("<")), F.regexp_replace(line, r"<[^>]+>", " ")).otherwise(line), marks), F.lit(" \t\n\x0b\f\r"))


def _spaced(text: Column) -> Column:
    """A text in lower case with a blank for what is between words."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")


def _words_in_order(text: Column) -> Column:
    return F.filter(F.split(_spaced(text), " "), lambda w: w != "")


def _to_bar(text: Column) -> Column:
    at = F.instr(text, " | ")
    return F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def _numbers_inside(line: Column, number: Column) -> Column:
    """Offsets in a line at which a number begins that is not part of a longer one."""
    pattern = F.concat(F.lit(r"(?!^)(?<!\d)(?<!\d\.)\Q"), number, F.lit(r"\E(?=[.\s]|$)"))
    ends = lambda parts: F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, k: F.aggregate(F.slice(parts, 1, k + 1), F.lit(0), lambda a, n: a + n) + k * F.length(number))
    return T.let(F.transform(F.split(line, pattern, -1), lambda x: F.length(x)), ends)


#: Titles of one document that meet its lines at once, pairs of titles and words that one step holds, and characters of texts that meet their titles at once.
TITLES_AT_ONCE, PAIRS_AT_ONCE, CHARACTERS_AT_ONCE = 256, 1 << 19, 1 << 21


def _blocks(n: np.ndarray, most: int = PAIRS_AT_ONCE) -> Iterator[slice]:
    """Runs of items whose numbers add up to ``most`` at most, or of one item."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, upto)
        at = upto


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts whose words are parted by blanks: the text of each, and the words."""
    parts = pc.split_pattern(texts.fill_null(""), " ")
    words, of = parts.flatten(), np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    kept = pc.not_equal(words, "")
    return of[kept.to_numpy(zero_copy_only=False)], words.filter(kept)


def _codes(*words: pa.Array) -> tuple[int, list[np.ndarray]]:
    """Numbers of words, equal ones for equal words (-1 for null), and how many there are."""
    found = pa.concat_arrays(words).dictionary_encode()
    codes = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return max(1, len(found.dictionary)), np.split(codes, np.cumsum([len(x) for x in words])[:-1])


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort: here several times faster than ``np.unique``, which hashes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _lists(of: np.ndarray, n: int, **values: np.ndarray) -> pa.Array:
    """Lists of structs, one for each of ``n`` owners, of values in the order of their owners."""
    items = pa.StructArray.from_arrays([pa.array(v) for v in values.values()], list(values))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32()), items)


#: Where words stand that are in a line's tags alone, and what looking a word up in a line costs, if finding one of a title's words in a next line costs 1.
_IN_TAGS, _LOOK_UP = 1 << 30, 16


def _is_inside(number: str, digits: str) -> bool:
    """Whether a number stands behind a line's start (its ``digits``, see ``_met``), not as part of a longer one."""
    at = digits.find(number, 1)
    while at > 0:
        before, behind = digits[max(0, at - 2) : at], digits[at + len(number) : at + len(number) + 1]
        if not behind.isdigit() and behind != "x" and not before[-1].isdigit() and not (before[-1] == "." and before[0].isdigit()):
            return True
        at = digits.find(number, at + 1)
    return False


def _is_first(number: str, head: str) -> bool:
    """Whether a line that begins with ``head`` begins with a number."""
    behind = head[len(number) : len(number) + 1]
    return head.startswith(number) and behind != "" and not behind.isdigit()


def _meetings(least: float, beginnings: bool) -> Callable:
    """Of rows with titles and lines: for each title what it ``found``, and the ``places`` of lines that have enough words in common with it and its number inside."""
    share = least / (2 - least)

    def few(titles: pa.Array, lines: pa.Array) -> pa.Array:
        t, x = titles.flatten(), lines.flatten()
        n_titles, n_lines = (v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for v in (titles, lines))
        row_of_title, first_line = np.repeat(np.arange(len(n_titles)), n_titles), np.cumsum(n_lines) - n_lines
        row_of_line = np.repeat(np.arange(len(n_lines)), n_lines)
        (of_title, a), (of_line, b), (of_tags, c) = (_words_of(v) for v in (t.field("words"), x.field("words"), x.field("tags")))
        v, (a, b, c) = _codes(a, b, c)
        # the distinct words of each title, and those of each line with the place of their first occurrence
        of_title, asked = np.divmod(_distinct(of_title * v + a), v)
        size = np.bincount(of_title, minlength=len(t))
        place = np.concatenate([np.arange(len(of_line)) - np.searchsorted(of_line, of_line), np.full(len(c), _IN_TAGS)])
        in_line, at = np.unique(np.concatenate([of_line * v + b, of_tags * v + c]), return_index=True)
        line_of, place = in_line // v, place[at]
        in_order = np.sort((line_of << 31) + place)
        bar = x.field("bar").fill_null(_IN_TAGS).to_numpy(zero_copy_only=False).astype(np.int64)
        by_row = row_of_line[line_of] * v + in_line % v
        order = np.argsort(by_row, kind="stable")
        by_row, at_line, at_place = by_row[order], line_of[order], place[order]
        key = row_of_title[of_title] * v + asked
        low = np.searchsorted(by_row, key, "left")
        often = np.searchsorted(by_row, key, "right") - low
        needed, begin, most = np.ceil(share * size - 1e-9).astype(np.int64), np.cumsum(size) - size, np.maximum(2 * size, 10)
        # the rarest words of each title, as many as must hold one that any line with enough of them has
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((often, of_title))] = np.arange(len(key)) - begin[of_title]
        rare = (rank <= size[of_title] - needed[of_title]) & (often > 0)
        cells = n_lines[row_of_title]
        every = np.bincount(of_title, often, len(t)).astype(np.int64) + cells
        by_rare = np.bincount(of_title[rare], often[rare], len(t)).astype(np.int64)
        found = [np.empty((5, 0), np.int64)]

        def keep(title: np.ndarray, line: np.ndarray, pair: np.ndarray, place: np.ndarray) -> None:
            """Of pairs, and the places of each word that they share, those with enough of them: title, line, and the numbers of words in the line, in its beginning, and before its bar."""
            enough = np.bincount(pair, minlength=len(title)) >= np.maximum(1, needed[title])
            mine = enough[pair]
            pair, place, title, line = (np.cumsum(enough) - 1)[pair[mine]], place[mine], title[enough], line[enough]
            n = [np.bincount(pair[m], minlength=len(title)) for m in (place < _IN_TAGS, place < most[title][pair], place < bar[line][pair])]
            found.append(np.stack([title, line, *n]))

        # a title meets all lines that have one of its words or, where that is less work, looks its words up in those that have one of its rarest words
        looks = every > by_rare * size * _LOOK_UP
        whole, some = np.flatnonzero(~looks & (size > 0)), np.flatnonzero(looks)
        for part in _blocks(every[whole]):
            title = whole[part]
            corner = np.cumsum(cells[title]) - cells[title]
            words = _spread(begin[title], size[title])
            entry = _spread(low[words], often[words])
            shift = np.repeat(np.repeat(corner - first_line[row_of_title[title]], size[title]), often[words])
            line = _spread(first_line[row_of_title[title]], cells[title])
            keep(np.repeat(title, cells[title]), line, shift + at_line[entry], at_place[entry])
        rare, first = np.flatnonzero(rare), np.searchsorted(of_title[rare], np.arange(len(t) + 1))
        for part in _blocks(by_rare[some]):
            words = rare[_spread(first[some[part]], first[some[part] + 1] - first[some[part]])]
            pairs = _distinct(np.repeat(of_title[words], often[words]) * max(1, len(x)) + at_line[_spread(low[words], often[words])])
            for k in _blocks(size[pairs // max(1, len(x))]):
                title, line = np.divmod(pairs[k], max(1, len(x)))
                probe = np.repeat(line, size[title]) * v + asked[_spread(begin[title], size[title])]
                k = np.minimum(np.searchsorted(in_line, probe), len(in_line) - 1)
                met = in_line[k] == probe
                keep(title, line, np.repeat(np.arange(len(title)), size[title])[met], place[k[met]])

        title, line, common, early, to_bar = np.concatenate(found, axis=1)
        step = x.field("length").to_numpy(zero_copy_only=False).astype(np.int64) + 1
        start = np.cumsum(step) - step
        offset = start[line] - start[first_line[row_of_title[title]]]
        numbers, heads, digits = t.field("number").to_pylist(), x.field("head").to_pylist(), x.field("digits").to_pylist()
        first, inside = np.zeros(len(title), bool), np.zeros(len(title), bool)
        for k in np.flatnonzero(t.field("number").is_valid().to_numpy(zero_copy_only=False)[title]):
            number, head, there = numbers[title[k]], heads[line[k]], digits[line[k]]
            if number in there:
                first[k] = head is not None and _is_first(number, head)
                inside[k] = not first[k] and _is_inside(number, there)
        _, (mark, of) = _codes(t.field("mark"), x.field("mark"))
        digit = [np.array([m is not None and m[0].isdigit() for m in z.field("mark").to_pylist()], bool) for z in (t, x)]
        other = (mark[title] >= 0) & (of[line] >= 0) & (mark[title] != of[line]) & (digit[1][line] | ~digit[0][title])
        upto = lambda place: np.searchsorted(in_order, (line << 31) + place) - np.searchsorted(in_order, line << 31)
        counts, n_early = np.where(first, [to_bar, upto(bar[line])], [common, upto(_IN_TAGS)]), upto(most[title])
        whole = 2.0 * counts[0] / (size[title] + counts[1])
        near = first & (counts[1] <= np.maximum(2 * size[title] + 2, 8)) & (whole >= least)
        scores = [(LINE, np.where(near, np.maximum(whole, 0.9), whole))]
        if beginnings:
            scores.append((BEGINNING, np.where(other, 0.0, 2.0 * early / (size[title] + n_early))))
        good = [(kind, np.flatnonzero(score >= least), score) for kind, score in scores]
        rows = np.concatenate([k for _, k, _ in good])
        kinds, values = np.concatenate([np.full(len(k), kind) for kind, k, _ in good]), np.concatenate([score[k] for _, k, score in good])
        order = np.argsort(title[rows], kind="stable")
        out = _lists(title[rows], len(t), offset=offset[rows][order].astype(np.int32), kind=kinds[order].astype(np.int32), score=values[order])
        rows = np.flatnonzero(inside)
        rows = rows[np.argsort(title[rows], kind="stable")]
        places = _lists(title[rows], len(t), line=(line - first_line[row_of_title[title]])[rows].astype(np.int32), offset=offset[rows].astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_titles)]), pa.int32()), pa.StructArray.from_arrays([out, places], ["found", "places"]))

    @F.arrow_udf("array<struct<found:array<struct<offset:int,kind:int,score:double>>,places:array<struct<line:int,offset:int>>>>")
    def meet(titles: pa.Array, lines: pa.Array) -> pa.Array:
        upto = np.cumsum(np.concatenate([[0], lines.flatten().field("length").to_numpy(zero_copy_only=False) + 1]))
        size = np.diff(upto[np.cumsum(np.concatenate([[0], lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))])
        parts = [few(titles[part], lines[part]) for part in _blocks(size, CHARACTERS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else few(titles, lines)

    return meet


def heading_candidates(titles: DataFrame, texts: DataFrame, least: float = SCORE, beginnings: bool = True) -> DataFrame:
    """Places in texts whose words have a Dice coefficient of ``least`` or more with a title: version_id, section_id, offset, kind, score.

    titles: version_id, section_id, title. A line counts with its words; one that begins with the title's number only up to a `` | ``. A number
    inside a line counts with what follows up to a `` | ``. Either is 0.9 at least if it begins with the number and is not much longer
    than the title. Of kind ``BEGINNING`` (with ``beginnings``) a line counts with its first words, and not if its number or letter is another.

    A coefficient of t needs t / (2 - t) of a title's words in the line. So a line that has none of the title's rarest words but that many
    can't reach it: titles and lines meet by those alone, and a word that is on every line brings no pairs. Titles without words have
    no candidates.
    """
    return _met(titles, texts, least, beginnings).select("version_id", "section_id", F.explode("found").alias("x")).select("version_id", "section_id", "x.*")


def _met(titles: DataFrame, texts: DataFrame, least: float, beginnings: bool, *own: str) -> DataFrame:
    """Titles that have candidates (see ``heading_candidates``): version_id, section_id, the titles' columns ``own``, and ``found``, an array of offset, kind, score.

    A text meets all its titles in one row, ``TITLES_AT_ONCE`` at a time. Python gets words, numbers and letters, and scores the pairs; where a title's number
    stands inside the line, it tells the pair, and columns score what follows.
    """
    # what a title and a line without its tags begin with, behind marks of a heading
    numbered = lambda text, before: F.nullif(F.regexp_replace(F.regexp_extract(text, before + _NUMBER[1:], 1), r"\.+$", ""), F.lit(""))
    marked = lambda text, before: F.coalesce(F.nullif(F.upper(F.regexp_extract(text, before + _LETTER[1:], 1)), F.lit("")), numbered(text, before)) if beginnings else F.lit(None).cast("string")

    def title_of(t: Column) -> Column:
        return F.struct(*(t[c].alias(c) for c in ("section_id", "title", *own)), numbered(t["title"], "^ *").alias("number"), marked(t["title"], r"^ *(?:#{1,6})?\s*").alias("mark"))

    def line_of(line: Column, clean: Column) -> Column:
        # the words of a line without its tags, and those of its tags (a line of tags alone has none); its first number, and all its digits and points, with a blank or an x for what is between
        tags = F.when(F.contains(line, F.lit("<")) & (clean != ""), _spaced(F.array_join(F.regexp_extract_all(line, F.lit(r"<[^>]+>"), F.lit(0)), " ")))
        head = F.when(clean.rlike("^[0-9]"), F.regexp_extract(F.concat(clean, F.lit(" ")), rf"^[0-9.]+{_BLANK}?", 0))
        digits = F.when(line.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(line, rf"{_BLANK}(?<![^0-9.]{_BLANK})[^0-9.]*", " "), rf"(?!{_BLANK})[^0-9.]+", "x")).otherwise("")
        bar = F.when(clean.rlike("^[0-9]") & F.contains(clean, F.lit(" | ")), F.size(_words_in_order(_to_bar(clean))))
        return F.struct(_spaced(clean).alias("words"), tags.alias("tags"), head.alias("head"), digits.alias("digits"), bar.alias("bar"), marked(clean, "^").alias("mark"), F.length(line).alias("length"))

    t = titles.groupBy("version_id").agg(F.collect_list(F.struct("section_id", "title", *own)).alias("titles"))
    rows = texts.where("text is not null").select("version_id", "text").join(t, "version_id")
    shown = lambda lines: F.transform(lines, lambda x: T.let(_without_tags(x), lambda clean: line_of(x, clean)))
    titled = F.filter(F.transform("titles", title_of), lambda t: t["title"].isNotNull())
    # arrays of one element, exploded, keep what is computed from being put into each of its uses
    rows = rows.select("version_id", F.explode(F.transform(F.array(F.split("text", "\n")), lambda lines: F.struct(titled.alias("titles"), lines.alias("lines"), shown(lines).alias("shown")))).alias("x"))
    parts = F.transform(F.sequence(F.lit(1), F.size("x.titles"), F.lit(TITLES_AT_ONCE)), lambda k: F.slice(F.col("x.titles"), k, TITLES_AT_ONCE))
    rows = rows.where(F.size("x.titles") > 0).select("version_id", F.explode(parts).alias("titles"), F.col("x.lines").alias("lines"), F.col("x.shown").alias("shown"))
    asked = F.transform("titles", lambda t: F.struct(_spaced(t["title"]).alias("words"), t["number"].alias("number"), t["mark"].alias("mark")))
    rows = rows.withColumn("met", _meetings(least, beginnings)(asked, F.col("shown")))

    def inside(t: Column, a: Column, line: Column, offset: Column) -> Column:
        """A title's number inside a line, with what follows up to a bar."""
        number, limit = t["number"], F.greatest(2 * F.size(a) + 2, F.lit(8))
        starts = lambda text: F.startswith(text, number) & F.substring(text, F.length(number) + 1, F.lit(1)).rlike(r"^[.\s]?$")
        scored = lambda p, sub, b: T.let(T.dice(a, b), lambda dice: F.struct((offset + p).alias("offset"), F.lit(INSIDE).alias("kind"), F.when(starts(sub) & (F.size(b) <= limit) & (dice >= least), F.greatest(dice, F.lit(0.9))).otherwise(dice).alias("score")))
        part = lambda p: T.let(T.let(T.let(F.substring(line, p + 1, F.length(line)), _to_bar), _without_tags), lambda sub: T.let(T.words(sub), lambda b: scored(p, sub, b)))
        return F.filter(T.let(_numbers_inside(line, number), lambda at: F.transform(at, part)), lambda s: s["score"] >= least)

    of_places = lambda t, places: T.let(T.words(t["title"]), lambda a: F.flatten(F.transform(places, lambda p: inside(t, a, F.get("lines", p["line"]), p["offset"]))))
    both = lambda t, m: F.when(F.size(m["places"]) == 0, m["found"]).otherwise(F.concat(m["found"], of_places(t, m["places"])))
    found = F.zip_with("titles", "met", lambda t, m: F.struct(*(t[c].alias(c) for c in ("section_id", *own)), both(t, m).alias("found")))
    return rows.select("version_id", F.explode(F.filter(found, lambda t: F.size(t["found"]) > 0)).alias("x")).select("version_id", "x.*")


def find_headings(titles: DataFrame, texts: DataFrame, score: float = SCORE, window: int = REACH) -> DataFrame:
    """Where each title's heading stands: (version_id, section_id, offset, score) of the candidate with the largest score, the first of equal ones.

    titles: version_id, section_id, title, low (offset from which to look) and high (or null: ``window`` characters on). A line that a window cuts
    belongs to it if it begins there. A title moves once, with its window, to its text, where its candidates stay: only the best of them goes on.
    """
    asked = titles.where("section_id is not null").select("version_id", "section_id", "title", "low", F.coalesce("high", F.col("low") + window).alias("high"))
    inside = F.filter("found", lambda x: (x["offset"] >= F.col("low")) & (x["offset"] < F.col("high")))
    best = F.array_max(F.transform(inside, lambda x: F.struct(x["score"].alias("score"), (-x["offset"]).alias("back"))))
    best = _met(asked, texts, score, False, "low", "high").groupBy("version_id", "section_id").agg(F.max(best).alias("best")).where("best is not null")
    return best.select("version_id", "section_id", (-F.col("best.back")).alias("offset"), F.col("best.score").alias("score"))


def heading_only(text: Column) -> Column:
    """Whether a chunk of 500 characters at most has only lines that are headings: marked ones, or, up to 100 characters in all, ones without lower case."""
    bare = T.strip_text(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<a\s+id='[^']*'>.*?</a>", ""))
    rows = lambda bare: F.filter(F.transform(F.split(bare, "\n"), T.strip_text), lambda x: x != "")
    good = lambda bare, x: F.startswith(x, F.lit("#")) | ((F.length(bare) <= 100) & (x == F.upper(x)))
    return T.let(bare, lambda bare: (F.length(bare) <= 500) & T.let(rows(bare), lambda rows: (F.size(rows) > 0) & F.forall(rows, lambda x: good(bare, x))))


@dataclass
class _Node:
    level: int
    place: int | None
    candidates: list
    children: list = field(default_factory=list)
    asked: int | None = None
    until: int | None = None
    begin: int | None = None
    end: int | None = None
    exact: bool = False


class _Document:
    """The fold over one document: chunks are (start or -1, end, length of the anchor, heading only), places are their numbers."""

    def __init__(self, chunks: list[tuple], size: int):
        self.chunks, self.size = chunks, size
        #: by chunk, where the last split in it was made
        self.splits: dict[int, int] = {}
        self.next_start = [size] * (len(chunks) + 1)
        for k in range(len(chunks) - 1, -1, -1):
            self.next_start[k] = chunks[k][0] if chunks[k][0] >= 0 else self.next_start[k + 1]

    def search(self, node: _Node, after: int, upto: int | None = None, least: float = SCORE, kinds: tuple = (LINE, INSIDE)) -> int | None:
        """The best candidate behind ``after``, the first of equal ones."""
        upto = after + 1 + REACH if upto is None else upto
        found = [(-score, at) for at, kind, score in node.candidates if after < at < upto and kind in kinds and score >= least]
        return min(found)[1] if found else None

    def refined(self, node: _Node, place: int) -> int | None:
        """Where a heading stands in its chunk, unless at the chunk's anchor."""
        start, end, anchor, _ = self.chunks[place]
        found = self.search(node, start - 1, end, kinds=(BEGINNING,))
        return found if found is not None and found - start >= anchor else None

    def split(self, left: _Node, right: _Node | None, at: int, place: int | None) -> None:
        left.end = at
        if right is not None:
            right.begin = at
        if place is not None:
            self.splits[place] = at

    def between(self, left: _Node, right: _Node, upto: int) -> None:
        """The boundary of two siblings, of which the second has a chunk."""
        a, b = left.place, right.place
        if a is None or b > a:
            if b < len(self.chunks) and self.chunks[b][0] >= 0:
                at = self.refined(right, b)
                if at is not None:
                    self.split(left, right, at, None)
            return
        start, end, _, only = self.chunks[a]
        if start < 0:
            return
        after = self.splits.get(a, start)
        if b < a:
            tries = [(after, end)]
        else:
            beyond = max(after, end - 1) if only and end > after else after
            tries = ([] if only else [(after, end)]) + [(beyond, self.next_start[min(upto, len(self.chunks))])]
        for low, high in tries:
            at = self.search(right, low, high)
            if at is not None:
                return self.split(left, right, at, a)

    def outer(self, last: _Node, boundary: _Node, upto: int) -> None:
        """The boundary of a node without a placed sibling behind it: the heading of what follows its parent."""
        n = len(self.chunks)
        if last.place is not None:
            start = self.chunks[last.place][0] if last.place < n else -1
            if start < 0:
                return
            after = max(self.splits.get(last.place, start), last.begin or 0)
            edge = self.chunks[upto][1] if upto < n else self.size + SLACK
            at, place = self.search(boundary, after, max(min(after + REACH, edge), after + SLACK)), last.place
        else:
            place = next((k for k in range(min(upto, n) - 1, -1, -1) if self.chunks[k][0] >= 0), None) if upto > 0 else None
            if place is None:
                return
            after = self.splits.get(place, self.chunks[place][0])
            at = self.search(boundary, after, after + REACH)
        if at is not None:
            self.split(last, None, at, place)

    def level(self, nodes: list[_Node], low: int, high: int, boundary: _Node | None = None) -> None:
        """Places and boundaries of siblings whose parent has the chunks from ``low`` to ``high``, and of all below them."""
        floors = [min((c.asked for c in x.children if c.asked is not None), default=None) for x in nodes]
        before = low
        for node, floor in zip(nodes, floors, strict=True):
            node.exact = node.asked is not None and low <= node.asked <= high
            node.place = node.asked if node.exact else None
            if floor is not None and floor < (before if node.place is None else node.place):
                node.place = floor
            before = before if node.place is None else node.place
        for i, node in enumerate(nodes):
            after = nodes[i + 1] if i + 1 < len(nodes) else None
            if after is None or after.place is None:
                node.until = high
                if boundary is not None:
                    self.outer(node, boundary, high)
                continue
            if node.place is None or after.place > node.place:
                node.until = after.place
            elif after.place == node.place:
                node.until = min(node.place + 1, high)
            else:
                node.until = next((x.place for x in nodes[i + 1 :] if x.place is not None and x.place > node.place), high)
            self.between(node, after, high)
        seen = low
        for i, (node, floor) in enumerate(zip(nodes, floors, strict=True)):
            seen = seen if node.place is None else node.place
            if not node.children:
                continue
            first, last, n = seen if floor is None else min(seen, floor), node.until, len(self.chunks)
            if node.end is not None and 0 <= (self.chunks[last][0] if last < n else -1) < node.end:
                last = next((k for k in range(last, min(high, n)) if self.chunks[k][0] >= node.end), high)
            follows = nodes[i + 1] if i + 1 < len(nodes) else boundary
            self.level(node.children, first, last, follows)

    def infer(self, node: _Node) -> None:
        for child in node.children:
            self.infer(child)
        places, ends = ([x for x in xs if x is not None] for xs in zip(*((c.place, c.until) for c in node.children), strict=True)) if node.children else ([], [])
        if places and node.place is None:
            node.place = min(places)

    def first_child(self, node: _Node, start: int) -> int | None:
        """Where the text of a node's children begins: that of the first one in a chunk of its own, or of one whose heading is found in the parent's."""
        shared = False
        for child in node.children:
            if child.place is None or child.place >= len(self.chunks) or self.chunks[child.place][0] < 0:
                continue
            begin, end, _, only = self.chunks[child.place]
            if child.place != node.place:
                if not shared:
                    return begin if child.begin is None else child.begin
                continue
            shared, after = True, max(start, begin)
            tries = [(max(after, end - 1), None, SCORE)] if only else [(after, end, SCORE), (after, end, CHILD_SCORE)] if after < end else [(after, None, SCORE)]
            for low, high, least in tries:
                at = self.search(child, low, high, least)
                if at is not None:
                    return at
        if shared:
            for child in node.children:
                at = child.begin if child.begin is not None else self.chunks[child.place][0] if child.place is not None and child.place != node.place and child.place < len(self.chunks) else None
                if at is not None and at > start:
                    return at
        return None

    def spans(self, node: _Node, floor: int | None = None):
        """(node, start, end, end of its own text) in pre-order."""
        start = end = None
        chunk = self.chunks[node.place] if node.place is not None and node.place < len(self.chunks) else None
        if node.begin is not None:
            start = node.begin
        elif chunk is not None and chunk[0] >= 0:
            better = self.refined(node, node.place)
            start = chunk[0] if better is None else better
        if start is not None and floor is not None:
            start = max(start, floor)
        end = node.end if node.end is not None else None if node.until is None else self.next_start[min(node.until, len(self.chunks))]
        if start is not None and end is not None and end <= start:
            end = chunk[1] if chunk is not None and chunk[1] > start else None
        own = end
        if node.children and start is not None:
            own = self.first_child(node, start)
            own = own if own is not None and own > start else None
        yield node, start, end, own
        for child in node.children:
            yield from self.spans(child, start)


def bound_rows(nodes: DataFrame, placed: DataFrame, texts: DataFrame, node: tuple[str, ...] = (), chunk: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: version_id, ``bounds`` (structs of what ``section_bounds`` returns and the columns ``node`` of nodes, in order of idx) and ``chunks`` (structs that end with the columns ``chunk``, in order of pos).

    All that meets here is grouped by version_id alone, and of texts only candidates and lengths come: a text moves once, to its titles.
    Outlines, chunks' places and candidates go to Python many documents at once.
    """
    found = _met(nodes.select("version_id", F.col("idx").alias("section_id"), "title"), texts, CHILD_SCORE, True)
    found = found.groupBy("version_id").agg(F.collect_list(F.struct("section_id", "found")).alias("found"))
    own = F.struct(F.col("idx").cast("int").alias("idx"), F.col("level").cast("int").alias("level"), "title", "chunk_id", *node)
    only = F.col("only") if "only" in placed.columns else heading_only(F.col("text"))
    place = F.struct("pos", "id", "start", "end", (F.length("id") + len("<a id=''></a>")).alias("anchor"), only.alias("only"), *chunk)
    rows = nodes.groupBy("version_id").agg(F.sort_array(F.collect_list(own)).alias("nodes")).join(texts.select("version_id", F.length("text").alias("size")), "version_id")
    rows = rows.join(placed.groupBy("version_id").agg(F.sort_array(F.collect_list(place)).alias("chunks")), "version_id", "left").join(found, "version_id", "left")

    @F.arrow_udf("array<struct<first:int,until:int,child:int,start:int,end:int,own_end:int,score:double>>")
    def bounds(outlines: pa.Array, places: pa.Array, candidates: pa.Array, sizes: pa.Array) -> pa.Array:
        ends = lambda lists: np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
        values = lambda x: x.to_pylist() if x.null_count or pa.types.is_string(x.type) else x.to_numpy(zero_copy_only=False).tolist()
        column = lambda items, *names: [values(items.field(c)) for c in names]
        of_titles = candidates.flatten()
        of_found = of_titles.field("found")
        idx, level, chunk_id = column(outlines.flatten(), "idx", "level", "chunk_id")
        chunk_ids, *chunks = column(places.flatten(), "id", "start", "end", "anchor", "only")
        section, found = values(of_titles.field("section_id")), list(zip(*column(of_found.flatten(), "offset", "kind", "score"), strict=True))
        chunks, found_ends, out = list(zip(*chunks, strict=True)), ends(of_found), []
        at = [pairwise(ends(x)) for x in (outlines, places, candidates)]
        for (n, n_end), (c, c_end), (f, f_end), size in zip(*at, sizes.to_pylist(), strict=True):
            met: dict[int, list] = {}
            for k in range(f, f_end):
                met.setdefault(section[k], []).extend(found[found_ends[k] : found_ends[k + 1]])
            out += _bounds_of(level[n:n_end], chunk_id[n:n_end], [met.get(i, []) for i in idx[n:n_end]], chunk_ids[c:c_end], chunks[c:c_end], size)
        names = ("first", "until", "child", "start", "end", "own_end", "score")
        kinds = [pa.float64() if c == "score" else pa.int32() for c in names]
        items = [pa.array(v, kind) for v, kind in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends(outlines), pa.int32()), pa.StructArray.from_arrays(items, names))

    outline = F.transform("nodes", lambda n: F.struct(n["idx"].alias("idx"), n["level"].alias("level"), n["chunk_id"].alias("chunk_id")))
    at = F.transform("chunks", lambda c: F.struct(*(c[x].alias(x) for x in ("id", "start", "end", "anchor", "only"))))
    rows = rows.withColumn("bounds", bounds(outline, at, F.col("found"), F.col("size")))
    names, values = ("idx", "level", "title", "chunk_id", *node), ("first", "until", "child", "start", "end", "own_end", "score")
    both = F.zip_with("nodes", "bounds", lambda n, b: F.struct(*(n[c].alias(c) for c in names), *(b[c].alias(c) for c in values)))
    return rows.select("version_id", both.alias("bounds"), "chunks")


def _bounds_of(levels: list[int], asked: list[str | None], candidates: list[list[tuple]], ids: list[str], chunks: list[tuple], size: int | None) -> list[tuple]:
    """The bounds of one document's nodes, in their order: first, until, child, start, end, own end, score."""
    number = {i: k for k, i in reversed(list(enumerate(ids)))}
    doc = _Document(chunks, size)
    roots, open_ = [], []
    for level, chunk_id, found in zip(levels, asked, candidates, strict=True):
        node = _Node(level, None, found, asked=number.get(chunk_id))
        while open_ and open_[-1].level >= level:
            open_.pop()
        (open_[-1].children if open_ else roots).append(node)
        open_.append(node)
    doc.level(roots, 0, len(doc.chunks))
    out = []
    for root in roots:
        doc.infer(root)
        for node, start, end, own in doc.spans(root):
            child = next((c.place for c in node.children if c.place is not None), None)
            out.append((node.place, node.until, child, start, end, own, 1.0 if node.exact else None))
    return out


def section_bounds(nodes: DataFrame, placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Where every node of a table of contents begins and ends: version_id, idx, level, title, chunk_id, first, until, child (chunks: its first, the one behind its last, its first child's), start, end, own_end (characters), score.

    nodes: version_id, idx (pre-order), level, title, chunk_id; placed: chunks with start and end (``chunks.chunk_offsets``) and text, or ``only`` (``chunks.measured``). Siblings in one
    chunk are parted where the second one's heading stands behind the last split in that chunk, else in what follows up to the parent's end; siblings in
    different chunks where the heading stands in the second chunk; the last one ends at the heading of what follows its parent. A node that
    stands behind its children begins with them. ``own_end`` is where its children's text begins. Chunks outside of the parent's count as none, and the score
    is 1 where a chunk counts. A row is one document's outline, chunks' places and candidates; its text stays out.
    """
    return bound_rows(nodes, placed, texts).select("version_id", F.explode("bounds").alias("x")).select("version_id", "x.*")


def without_heading(text: Column, title: Column) -> Column:
    """A section's text behind its heading: the line whose first words are most like the title, if its Dice coefficient is 0.5 or more.

    A heading in the last three tenths of the text counts from 0.65 on. Of a line with a colon behind the title's words only the part up to the colon is the heading.
    """
    def best(lines: Column, a: Column) -> Column:
        most = F.greatest(2 * F.size(a), F.lit(10))
        score = lambda x: T.let(F.array_distinct(F.slice(_words_in_order(_without_tags(x)), 1, most)), lambda b: T.dice(a, b))
        return F.array_max(F.transform(lines, lambda x, k: F.struct(score(x).alias("score"), (-k).alias("back"))))

    def cut(text: Column, lines: Column, a: Column, best: Column) -> Column:
        k = -best["back"]
        line = F.element_at(lines, k + 1)
        behind = lambda before, clean: T.let(F.instr(clean, ":"), lambda colon: at_colon(before, clean, colon))

        def at_colon(before: Column, clean: Column, colon: Column) -> Column:
            end = F.least(before + F.length(line) + 1, F.length(text))
            named = F.size(F.array_intersect(T.words(F.substring(clean, F.lit(1), colon - 1)), a)) >= F.greatest(F.lit(1), F.floor(F.size(a) / 2))
            inline = (colon > 1) & (T.strip_text(F.substring(clean, colon + 1, F.length(clean))) != "") & named
            end = F.when(inline, F.least(end, before + F.instr(line, ":"))).otherwise(end)
            late = (before + F.length(line) + 1 > 0.70 * F.length(text)) & (best["score"] < 0.65)
            return F.when(F.coalesce(late, F.lit(True)), text).otherwise(F.substring(text, end + 1, F.length(text)))

        before = F.aggregate(F.slice(lines, 1, k), F.lit(0), lambda n, x: n + F.length(x) + 1)
        return F.when(F.coalesce((F.size(a) == 0) | (best["score"] < 0.5), F.lit(True)), text).otherwise(T.let(before, lambda before: T.let(bare_line(line), lambda clean: behind(before, clean))))

    found = lambda text, lines, a: T.let(best(lines, a), lambda best: cut(text, lines, a, best))
    return T.let(text, lambda text: T.let(F.split(text, "\n"), lambda lines: T.let(T.words(title), lambda a: found(text, lines, a))))
