"""Text columns: normalised search keys, cleaning, word overlap, e-mail addresses."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vietnamese vowels and tone marks, from which the table of accented letters is composed.
_VOWELS, _TONES = "aăâeêioôơuưy", ("̀", "̉", "̃", "́", "̣")


def accent_table() -> tuple[str, str]:
    """Accented lower-case Vietnamese letters and their plain letters, of equal length."""
    accented = [v for v in _VOWELS if v not in "aeiouy"] + [unicodedata.normalize("NFC", v + t) for v in _VOWELS for t in _TONES] + ["đ"]
    plain = ["d" if c == "đ" else unicodedata.normalize("NFD", c)[0] for c in accented]
    return "".join(accented), "".join(plain)


def search_key(column: Column) -> Column:
    """Lower case, Vietnamese accents off, everything but a-z and 0-9 removed; null is empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(column, F.lit(""))), *accent_table()), "[^a-z0-9]+", "")


def literal_search_key(text: str | None) -> str:
    """The same for a keyword on the driver; letters beyond the table lose their marks too."""
    text = unicodedata.normalize("NFD", (text or "").strip().lower().replace("đ", "d"))
    return "".join(c for c in text if unicodedata.category(c) != "Mn" and (c.isascii() and c.isalnum()))


#: The specialty of health stations (a fixed value), and its search key.
STATION_SPECIALTY = "Trạm y tế"
STATION_KEY = literal_search_key(STATION_SPECIALTY)


def specialty(column: Column) -> Column:
    """A specialty without white space at its ends; every spelling of the stations' one becomes that, blank is null."""
    text = F.nullif(strip_text(column), F.lit(""))
    return F.when(search_key(text) == STATION_KEY, F.lit(STATION_SPECIALTY)).otherwise(text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A column that ``use`` makes of a value which is computed once."""
    return F.transform(F.array(value), use)[0]


def strip_text(column: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def section_text(column: Column, page_break: str = r"<!--\s*PAGE(?:\s*|_)BREAK\s*-->") -> Column:
    """A section's text without page breaks, lines that are numbers, and runs of empty lines."""
    text = F.regexp_replace(strip_text(F.coalesce(column, F.lit(""))), f"(?i){page_break}", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*\d+[ \t]*$", "")
    return strip_text(F.regexp_replace(text, r"\n{3,}", "\n\n"))


#: A page break inside a comment: blanks between its words, an underscore, or nothing.
_BREAK = r"<!--\s*PAGE(?:\s*|_)BREAK\s*-->"
PAGE_BREAK = "<!-- PAGE_BREAK -->"


def clean_markup(column: Column) -> Column:
    """Without empty anchors and comments; page-break comments stay, in one spelling."""
    text = F.regexp_replace(column, r"(?i)<a\s[^>]*></a>", "")
    text = F.regexp_replace(text, rf"(?is)<!--(?!{_BREAK[4:]}).*?-->", "")
    return F.regexp_replace(text, f"(?i){_BREAK}", PAGE_BREAK)


def cleaning_audit(raw: Column) -> Column:
    """What ``clean_markup`` takes off: characters of anchors, of comments, of page breaks respelt; lengths expected and found; equal numbers of breaks."""
    lengths = lambda x, pattern: F.aggregate(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m))
    no_anchor = F.regexp_replace(raw, r"(?i)<a\s[^>]*></a>", "")
    anchors, comments = F.length(raw) - F.length(no_anchor), lengths(no_anchor, rf"(?is)<!--(?!{_BREAK[4:]}).*?-->")
    breaks = F.size(F.regexp_extract_all(raw, F.lit(f"(?i){_BREAK}"), F.lit(0)))
    respelt, clean = breaks * len(PAGE_BREAK) - lengths(raw, f"(?i){_BREAK}"), clean_markup(raw)
    expected = F.length(raw) - anchors - comments + respelt
    kept = F.size(F.regexp_extract_all(clean, F.lit(PAGE_BREAK), F.lit(0)))
    return F.struct(anchors.alias("anchors"), comments.alias("comments"), respelt.alias("respelt"), expected.alias("expected"), F.length(clean).alias("found"), (breaks == kept).alias("same_breaks"))


def words(column: Column) -> Column:
    """The distinct words of a text in lower case; letters, digits and underscores make words."""
    bare = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: w != ""))


def dice(left: Column, right: Column) -> Column:
    """Twice the common words over the sum of both; 0 if either is empty."""
    n = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / n)


def email(column: Column) -> Column:
    """Lower case, without ``mailto:``, white space and marks at the end."""
    text = F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(text, "^mailto:", ""), "^[;,.]+|[;,.]+$", "")


def moved_email(address: Column, from_domain: str, to_domain: str, from_prefix: str = "", to_prefix: str = "") -> Column:
    """A normalised address with another domain and another start of its name; null if it has not the domain and the start that it should, or is none."""
    clean = email(address)
    name = F.regexp_extract(clean, r"^(.+)@[^@]*$", 1)
    fits = (F.substring_index(clean, "@", -1) == from_domain) & (name != "") & name.startswith(from_prefix)
    moved = F.concat(F.lit(to_prefix), F.substring(name, len(from_prefix) + 1, 2**31 - 1), F.lit(f"@{to_domain}"))
    return F.when(fits & is_email(moved), moved)


def is_email(column: Column) -> Column:
    return column.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def page_count(column: Column, marker: str = "<!-- PAGE_BREAK -->") -> Column:
    """Markers and one more; 0 for an empty text."""
    pages = (F.length(column) - F.length(F.replace(column, F.lit(marker), F.lit("")))) / len(marker) + 1
    return F.when(F.coalesce(F.length(column), F.lit(0)) == 0, F.lit(0)).otherwise(pages).cast("long")


def node_id(path: Column) -> Column:
    """The first 12 hexadecimal digits of a path's SHA-1."""
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def path_key(path: Column, last: int = 1_000_000_000) -> Column:
    """A dotted path as integers that sort as they should; what is no number sorts last."""
    return F.transform(F.split(F.coalesce(path, F.lit("")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(last)))
