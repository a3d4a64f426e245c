"""Fill-in-the-middle rewriting of whole texts, all rows of an Arrow batch at once.

A text is cut into units: a word with the white space before it, or white space that no word follows. In UTF-8 a unit
begins at the text's first byte and wherever a white-space byte follows another byte, so one table lookup and one
comparison of adjacent bytes give all boundaries of a batch. Their running count, taken anew from each row's first
byte, is sorted, and one binary search finds both cuts of every row.

Null text: empty. Null doc_id: the empty string in what is hashed. Rows that repeat an id, and extra columns whatever
their names, are rows like others; only the id and the text are read. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_steps
from .vector import SPACE

SEED = 42
#: Percentages: texts that are rewritten, and of those the ones with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_FORMS = pa.array([PLAIN, PSM, SPM])
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
_P, _S, _M = range(3)
#: The parts of an output by form: marks are numbered as in _MARKS, texts follow as 3 prefix, 4 middle, 5 suffix, 6 all.
_ORDER = np.array([[6, -1, -1, -1, -1, -1], [_P, 3, _S, 5, _M, 4], [_S, 5, _P, 3, _M, 4]])


def unit_cuts(buf: np.ndarray, off: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row, and the byte positions after a and after b units, for pick = [h1, h2] modulo units + 1, a <= b."""
    space = SPACE[buf]
    new = np.zeros(len(buf) + 1, np.int64)
    new[1:-1] = space[1:] & ~space[:-1]
    new[off[:-1]] = 0
    # seen[p]: boundaries before byte p. A row's k-th unit ends where the count since its first byte becomes k.
    seen = np.cumsum(new)
    start, end = off[:-1], off[1:]
    filled = end > start
    last = np.where(filled, seen[np.maximum(end - 1, start)], seen[start])
    units = np.where(filled, last - seen[start] + 1, 0)
    chosen = np.sort(pick % (units + 1), axis=0)
    at = np.searchsorted(seen, seen[start] + chosen)
    return units, *np.where(chosen == 0, start, np.where(chosen == units, end, at))


def has_marks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True for the rows that hold one of the three marks."""
    if len(buf) < 3:
        return np.zeros(len(off) - 1, bool)
    inner = np.zeros(256, bool)
    inner[_MARKS[1::3]] = True
    hit = np.flatnonzero((buf[:-2] == _MARKS[0]) & inner[buf[1:-1]] & (buf[2:] == _MARKS[2]))
    row = np.searchsorted(off, hit, "right") - 1
    out = np.zeros(len(off) - 1, bool)
    out[row[hit + 3 <= off[row + 1]]] = True
    return out


def assemble(buf: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray) -> pa.Array:
    """The outputs of all rows: copies of slices of the texts and of the marks."""
    n, marks = len(off) - 1, len(buf) + 3 * np.arange(3)
    zero, start, end = np.zeros(n, np.int64), off[:-1], off[1:]
    begin = np.stack([*(zero + m for m in marks), start, a, b, start])
    size = np.stack([*[zero + 3] * 3, a - start, b - a, end - b, end - start])
    part = _ORDER[form]
    rows = np.arange(n)[:, None]
    size, begin = np.where(part >= 0, size[part, rows], 0).ravel(), begin[part, rows].ravel()
    stop = np.cumsum(size)
    total = int(stop[-1]) if n else 0
    data = np.concatenate([buf, _MARKS])[np.repeat(begin - (stop - size), size) + np.arange(total)]
    offsets = np.concatenate([[0], stop[5::6]])
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def rewrite(buf: np.ndarray, off: np.ndarray, h: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all rows; h holds four unsigned numbers by row."""
    units, a, b = unit_cuts(buf, off, h[:2])
    plain = (np.diff(off) == 0) | has_marks(buf, off) | (h[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[3] % 100 < suffix_first, 2, 1))
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    counts = [pa.array(x, mask=plain) for x in (chars[a] - chars[off[:-1]], chars[b] - chars[a])]
    return [pa.array(units), _FORMS.take(pa.array(form)), *counts, assemble(buf, off, a, b, form)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row: half of the texts with their middle moved last.

    One pass without a shuffle; the four numbers that choose cuts and form come from the seed and the id alone, so a
    lost executor's rows come out the same again.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]

    def run(batches):
        for batch in batches:
            numbers = np.stack([batch.column(k).to_numpy() for k in range(2, 6)])
            for x, y, buf, off in text_steps(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *rewrite(buf, off, numbers[:, x:y], rate, suffix_first)], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    return rows.select("id", "text", *h).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone.

    A text with a mark in it is plain, and no mark begins inside another, so the first of each mark is the one put in.
    """

    def between(first: str, second: str) -> Column:
        return F.substr(F.substring_index(output, second, 1), F.lit(len(first) + 1))

    def after(mark: str) -> Column:
        return F.substr(output, F.locate(mark, output) + F.lit(len(mark)))

    def inside(first: str, second: str) -> Column:
        rest = after(first)
        return F.substring_index(rest, second, 1)

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), inside(SUFFIX, MIDDLE))
    spm = F.concat(inside(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle_report(docs: DataFrame) -> DataFrame:
    """The digests of output and of the text rebuilt from it, in place of both."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
