"""Fill-in-middle transformation: whole batches of texts are cut into prefix, middle and suffix by one numpy kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._text import small_batches, steps, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: those inside a character, ASCII letters, and those that begin another character.
_INSIDE, _LETTER, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = _INSIDE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), dtype=np.uint8)
_FORMS = pa.array(["plain", "spm", "psm"])
_PLAIN, _SPM, _PSM = range(3)


def _has_mark(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts contain one of the marks."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    if len(data) < 3:
        return out
    second = data[1:-1]
    at = np.flatnonzero((data[:-2] == _MARKS[0]) & (data[2:] == _MARKS[2]) & ((second == _MARKS[1]) | (second == _MARKS[4]) | (second == _MARKS[7])))
    text = np.searchsorted(offsets, at, side="right") - 1
    out[text[at + 3 <= offsets[text + 1]]] = True
    return out


def cut_texts(texts: pa.Array, h: np.ndarray, plain_from: int = 90, spm_below: int = 20) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of every text of a column, all rows together.

    ``h`` has four unsigned 32-bit numbers (as int64) for each row: the first two choose the cuts, the third (modulo 100)
    whether the text stays plain, the fourth whether the suffix comes first.
    """
    data, offsets = text_bytes(texts)
    rows, begin, end = len(offsets) - 1, offsets[:-1], offsets[1:]
    kind = _CLASS[data]
    # a token begins at every byte that begins a character, but not at a letter behind a letter of the same text
    edge = kind != _INSIDE
    edge[1:] &= (kind[1:] != _LETTER) | (kind[:-1] != _LETTER)
    full = begin[end > begin]
    edge[full] = True
    wide = np.int32 if len(data) < 1 << 31 else np.int64
    tokens, chars = (np.zeros(len(data) + 1, dtype=wide) for _ in range(2))
    np.cumsum(edge, out=tokens[1:], dtype=wide)
    np.cumsum(kind != _INSIDE, out=chars[1:], dtype=wide)
    base = tokens[begin].astype(np.int64)
    n = tokens[end] - base
    x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        """Bytes before the first ``k`` tokens end: where token k begins, or the end of the text."""
        return np.minimum(np.searchsorted(tokens, (base + k + 1).astype(wide), side="left") - 1, end)

    first, second = place(np.minimum(x, y)), place(np.maximum(x, y))
    plain = (end == begin) | _has_mark(data, offsets) | (h[:, 2] % 100 >= plain_from)
    form = np.where(plain, _PLAIN, np.where(h[:, 3] % 100 < spm_below, _SPM, _PSM))
    # pieces of each row in the order of its output, from the texts and the marks behind them
    marks = len(data)
    spans = {"P": (np.full(rows, marks), np.full(rows, 3)), "S": (np.full(rows, marks + 3), np.full(rows, 3)), "M": (np.full(rows, marks + 6), np.full(rows, 3)), "prefix": (begin, first - begin), "middle": (first, second - first), "suffix": (second, end - second), "text": (begin, end - begin), "": (begin, np.zeros(rows, np.int64))}
    order = {_PLAIN: ("text", "", "", "", "", ""), _PSM: ("P", "prefix", "S", "suffix", "M", "middle"), _SPM: ("S", "suffix", "P", "prefix", "M", "middle")}
    start, length = (np.zeros((rows, 6), dtype=np.int64) for _ in range(2))
    for f, names in order.items():
        own = form == f
        for k, name in enumerate(names):
            start[own, k], length[own, k] = spans[name][0][own], spans[name][1][own]
    ends = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(length.sum(axis=1), out=ends[1:])
    source = np.concatenate([data, _MARKS])
    flat, sizes = start.ravel(), length.ravel()
    behind = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    # copied run by run: rows are few beside their bytes
    for s, size, to in zip(flat[sizes > 0].tolist(), sizes[sizes > 0].tolist(), behind[sizes > 0].tolist(), strict=True):
        out[to - size : to] = source[s : s + size]
    output = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(out))
    return {
        "n": pa.array(n.astype(np.int64)), "form": _FORMS.take(pa.array(form)),
        "prefix_chars": pa.array((chars[first] - chars[begin]).astype(np.int64), mask=plain), "middle_chars": pa.array((chars[second] - chars[first]).astype(np.int64), mask=plain),
        "output": output.cast(pa.string()) if ends[-1] < 1 << 31 else output,
    }


def draws(seed: str, id_col: Column) -> Column:
    """Four unsigned 32-bit numbers from the sha256 of the seed and an id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Every text in fill-in-middle form: id, n, form, prefix_chars, middle_chars and output.

    Tokens are runs of ASCII letters and single other characters. Two draws from a hash of the id choose how many tokens
    prefix and middle end after; ``form`` is plain for texts that are empty, hold a mark, or whose third draw (modulo 100) is
    ``plain_from`` or more, and else spm, by a fourth draw under ``spm_below``, or psm. Null texts are empty; equal rows are
    cut alike; a null id is drawn for like an empty one; an empty table gives an empty result; other columns, whatever their
    names, are not read. No row is moved: a task cuts a few MB of text at once, and a longer text by itself.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), draws(seed, F.col(id_col)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                h = step.column(2).flatten().to_numpy(zero_copy_only=False).reshape(step.num_rows, 4)
                cut = cut_texts(step.column(1), h, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([step.column(0), *cut.values()], names=[id_col, *cut])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form: marks are in no text that was cut, so they part it."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
