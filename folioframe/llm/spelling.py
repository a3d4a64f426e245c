"""Spelling variants: words one inserted, deleted or replaced letter apart, by a trie self-join with active-node sets.

The vocabulary (letters a-z and U+00C0 to U+00FF, one byte each in Latin-1) is dealt into tries by shared prefix. For a
word of L letters and one of L or L + 1, one edit apart, either the first half (by L) is the same in both, or all that
follows it is: so in each band L a word goes to the trie of its first half, holding what comes after, and to the trie of
its last half, holding what comes before. A trie with too many words is dealt again, by halves of what it holds, until
it is small; what holds a single letter is small in any case. A pair meets in exactly one trie, or is told apart there:
tries by last half emit only pairs whose first halves differ.

In a trie a node's active set are the nodes at distance one: siblings (a letter replaced) and children (a letter
inserted) begin it, and it moves down both subtrees by equal letters. A task takes many tries as one forest, level by
level, as numpy arrays of node pairs. Only pairs of ends are emitted, with the counts of both words, and are added up
by word before they are shuffled.

Null text: no words. Null doc_id: the empty string in what is hashed. Repeated rows count again; rows that repeat an id
choose the same letters. Ties are settled by code-point order. Empty tables, and tables without words that are frequent
enough, give no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, parallel_parts, release, text_steps
from .vector import LOWERED

MIN_CHARS, MIN_COUNT, FACTOR, EVERY = 6, 5, 5, 199
#: Words of one trie at most (one of a single letter left has at most 90 + 90 * 90), and of a task's forest on average.
TRIE_WORDS, FOREST_WORDS = 20_000, 40_000
#: Distinct words a counting task holds before it hands them on.
HELD_WORDS = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def letter_runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of letters of each row. U+00C0 to U+00FF are the byte 0xC3 and the one after it."""
    inside = np.zeros(len(buf) + 2, bool)
    lead = buf == _LEAD
    inside[1:-1] = _LETTER[buf] | lead
    inside[2:-1] |= lead[:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = inside[1:-1] & (~inside[:-2] | edge[:-1])
    end = inside[1:-1] & (~inside[2:] | edge[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def crc_runs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run's bytes, continued from `before`; all runs byte by byte together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, reg = starts[order], before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    ordered = -size[order]
    k = 0
    while n := int(np.searchsorted(ordered, -k, "left")):
        if n < 8 and k > 64:  # a few very long runs are left
            for j in range(n):
                rest = low[at[j] + k : at[j] + int(-ordered[j])].tobytes()
                reg[j] = np.uint32(zlib.crc32(rest, int(reg[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
            break
        reg[:n] = _CRC[(reg[:n] ^ low[at[:n] + k]) & np.uint32(0xFF)] ^ (reg[:n] >> np.uint32(8))
        k += 1
    out = np.empty(len(reg), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(buf: np.ndarray, off: np.ndarray, ids: list[str], min_chars: int = MIN_CHARS) -> pa.Array:
    """All words of the rows, repeats included: runs in lower case, every 199th without one letter, of enough letters."""
    low = LOWERED[buf]
    starts, ends = letter_runs(buf, off)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    size = chars[ends] - chars[starts]
    keep = size >= min_chars
    starts, ends, size = starts[keep], ends[keep], size[keep]
    if not len(starts):
        return pa.array([], pa.large_string())
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc_runs(low, starts, ends, seeds[np.searchsorted(off, starts, "right") - 1]).astype(np.int64)
    drop = np.flatnonzero(h % EVERY == 0)
    # a run that loses a letter is two slices: before it and after it
    place = h[drop] % size[drop]
    first = np.flatnonzero((buf & 0xC0) != 0x80)
    cut = first[chars[starts[drop]] + place]
    cut_end = cut + np.where(buf[cut] == _LEAD, 2, 1)
    begin, length = np.stack([starts, ends], axis=1), np.stack([ends - starts, np.zeros(len(starts), np.int64)], axis=1)
    length[drop, 0], begin[drop, 1], length[drop, 1] = cut - starts[drop], cut_end, ends[drop] - cut_end
    left = np.ones(len(starts), bool)
    left[drop] = size[drop] > min_chars
    begin, length = begin[left].ravel(), length[left].ravel()
    stop = np.cumsum(length)
    data = low[np.repeat(begin - (stop - length), length) + np.arange(stop[-1])] if len(stop) else low[:0]
    offsets = np.concatenate([[0], stop[1::2]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words by their number over all texts, where it is large enough. Tasks add up before the shuffle."""

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
            for x, y, buf, off in text_steps(batch.column(1)):
                counts = pc.value_counts(words_of(buf, off, ids[x:y], min_chars))
                t = pa.table({"word": counts.field(0), "n": counts.field(1)})
                held.append(t)
                size += len(t)
                if size > HELD_WORDS:
                    held = [added(held)]
                    size = len(held[0])
                    if size > HELD_WORDS // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from added(held).to_batches()

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda b: (pa.RecordBatch.from_arrays([x.column(0).cast(pa.string()), x.column(1)], ["word", "n"]) for x in run(b)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


#: A trie: its band, how many letters its words share at the ends, and which.
TRIE = ["band", "lo", "hi", "head", "tail"]


def _halves(lo: Column, hi: Column) -> Column:
    """The two tries of words that share lo first and hi last letters: half of what is left goes to either side."""
    rest = F.col("band") - lo - hi
    m = F.floor(rest / 2).cast("int")
    return F.array(F.struct((lo + m).alias("lo"), hi.alias("hi")), F.struct(lo.alias("lo"), (hi + rest - m).cast("int").alias("hi")))


def _keyed(parts: DataFrame) -> DataFrame:
    ends = {"head": F.expr("substr(word, 1, lo)"), "tail": F.expr("substr(word, char_length(word) - hi + 1, hi)")}
    return parts.select("word", "n", "band", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi")).withColumns(ends)


def dealt(words: DataFrame, trie_words: int | None = None) -> DataFrame:
    """word, n and the trie of each copy of a word; tries of too many words are dealt again, by halves.

    Every word is in two tries of band L and two of band L - 1; each round doubles the copies of hot tries alone, and
    there are as many rounds as halvings of the longest word, at most.
    """
    most, size = trie_words or TRIE_WORDS, F.char_length("word")
    bands = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("band"))
    copies = durable(_keyed(bands.select("*", F.explode(_halves(F.lit(0), F.lit(0))).alias("part"))))
    while True:
        hot = durable(copies.groupBy(*TRIE).count().filter((F.col("count") > most) & (F.col("band") - F.col("lo") - F.col("hi") >= 2)).drop("count"))
        if hot.isEmpty():
            release(hot)
            return copies
        split = copies.join(hot, TRIE, "left_semi").select("word", "n", "band", F.explode(_halves(F.col("lo"), F.col("hi"))).alias("part"))
        following = durable(copies.join(hot, TRIE, "left_anti").select("word", "n", *TRIE).unionByName(_keyed(split)))
        release(copies)
        release(hot)
        copies = following


@dataclass
class Level:
    """The nodes of one depth of a forest, in order of their parents and letters."""

    #: Node on the level above; the letter that leads here.
    parent: np.ndarray
    letter: np.ndarray
    #: The entry that ends here, or -1; whether entries of the smaller and of the larger length pass here.
    ended: np.ndarray
    short: np.ndarray
    long: np.ndarray
    #: Where the children of each node of the level above begin.
    first: np.ndarray


def forest(letters: np.ndarray, off: np.ndarray, trie: np.ndarray, short: np.ndarray) -> list[Level]:
    """The levels of the tries of sorted entries; the first level has a root for each trie."""
    size, live = np.diff(off), np.arange(len(trie))
    node, parent, letter, nodes = trie.astype(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    levels: list[Level] = []
    while len(live):
        depth = len(levels)
        new = np.ones(len(live), bool)
        letter = letters[off[live] + depth - 1].astype(np.int64) if depth else np.zeros(len(live), np.int64)
        new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
        here = np.cumsum(new) - 1
        parent, count = node[new], int(here[-1]) + 1
        marks = np.zeros((2, count), bool)
        marks[short[live].astype(int), here] = True
        ended = np.full(count, -1)
        over = size[live] == depth
        ended[here[over]] = live[over]
        levels.append(Level(parent, letter[new], ended, marks[1], marks[0], np.searchsorted(parent, np.arange(nodes + 1))))
        live, node, nodes = live[~over], here[~over], count
    return levels


def _down(pairs: np.ndarray, a: Level, b: Level) -> np.ndarray:
    """Children (in level a, in level b) of the nodes of each pair, by equal letters."""
    many = a.first[pairs[:, 0] + 1] - a.first[pairs[:, 0]]
    stop = np.cumsum(many)
    left = np.repeat(a.first[pairs[:, 0]] - (stop - many), many) + np.arange(stop[-1] if len(stop) else 0)
    key, edge = np.repeat(pairs[:, 1], many) * 256 + a.letter[left], b.parent * 256 + b.letter
    right = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
    same = edge[right] == key
    return np.stack([left[same], right[same]], axis=1)


def _siblings(level: Level, nodes: np.ndarray) -> np.ndarray:
    """All pairs, in order, of those of the nodes that share a parent; a parent has no more children than letters."""
    up = level.parent[nodes]
    after = np.searchsorted(up, up, "right") - np.arange(len(nodes)) - 1
    stop = np.cumsum(after)
    left = np.repeat(np.arange(len(nodes)), after)
    right = left + 1 + np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - after, after)
    return np.stack([nodes[left], nodes[right]], axis=1)


def near_ends(letters: np.ndarray, off: np.ndarray, trie: np.ndarray, short: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Pairs (short entry, other entry) of one trie that are one edit apart.

    Entries are distinct letter sequences, sorted, trie after trie. `short` marks those of the smaller length: a letter
    is replaced among them, and inserted into one of them to give one that is not. In `closed` tries a letter appended
    does not count: those pairs share what comes first, and meet elsewhere.
    """
    levels, found = forest(letters, off, trie, short), [np.zeros((0, 2), np.int64)]
    if not levels:
        return found[0]
    swap, grow = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    for depth in range(len(levels)):
        here = levels[depth]
        if depth:
            some = np.flatnonzero(here.short)
            swap = np.concatenate([_down(swap, here, here), _siblings(here, some)])
            swap = swap[here.short[swap[:, 0]] & here.short[swap[:, 1]]]
            ends = here.ended[swap]
            found.append(ends[(ends >= 0).all(axis=1)])
        if depth + 1 < len(levels):
            below = levels[depth + 1]
            child = np.flatnonzero(below.long & here.short[below.parent])
            moved = _down(grow, here, below) if depth else grow
            moved = moved[here.short[moved[:, 0]] & below.long[moved[:, 1]] & (below.parent[moved[:, 1]] != moved[:, 0])]
            grow = np.concatenate([moved, np.stack([below.parent[child], child], axis=1)])
            grow = grow[np.unique(grow[:, 0] * len(below.parent) + grow[:, 1], return_index=True)[1]]
            ends = np.stack([here.ended[grow[:, 0]], below.ended[grow[:, 1]]], axis=1)
            appended = closed[np.maximum(ends[:, 0], 0)] & (below.parent[grow[:, 1]] == grow[:, 0])
            found.append(ends[(ends >= 0).all(axis=1) & ~appended])
    pairs = np.concatenate(found)
    return pairs[short[pairs[:, 0]] & ((off[pairs[:, 0] + 1] - off[pairs[:, 0]] != off[pairs[:, 1] + 1] - off[pairs[:, 1]]) | short[pairs[:, 1]])]


def _latin(rest: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per letter, and offsets."""
    (_, _, buf, off), *_ = text_steps(rest, 1 << 60)
    keep = buf != _LEAD
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return np.where((buf & 0xC0) == 0x80, buf + np.uint8(0x40), buf)[keep], before[off]


def _near_in_forest(t: pa.Table) -> pa.Table:
    """For each word with near words in these tries: their number, and the one of largest n."""
    t = t.sort_by([("key", "ascending"), ("rest", "ascending")]).combine_chunks()
    key = t["key"].combine_chunks().dictionary_encode()
    key = (key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy().astype(np.int64)
    letters, off = _latin(t["rest"])
    pairs = near_ends(letters, off, key, np.diff(off) == t["room"].to_numpy(), t["closed"].to_numpy())
    both = np.concatenate([pairs, pairs[:, ::-1]])
    # by word, the largest n first, then the smallest word
    order = pc.sort_indices(t, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    both = both[np.lexsort([rank[both[:, 1]], both[:, 0]])]
    first = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]])) if len(both) else np.zeros(0, np.int64)
    own, best = pa.array(both[first, 0]), pa.array(both[first, 1])
    number = np.diff(np.concatenate([first, [len(both)]]))
    return pa.table({"word": t["word"].take(own), "n": t["n"].take(own), "n_near": pa.array(number, pa.int64()), "best": t["word"].take(best), "best_n": t["n"].take(best)})


def near_words(words: DataFrame, trie_words: int | None = None) -> DataFrame:
    """word, n, n_near, best, best_n of every word: how many are one edit apart, and the most frequent of them."""
    copies = dealt(words, trie_words)
    forests = max(parallel_parts(words), -(-copies.count() // FOREST_WORDS))
    entries = copies.select(
        "word", "n", F.concat_ws("|", *TRIE).alias("key"), F.expr("substr(word, lo + 1, char_length(word) - lo - hi)").alias("rest"), (F.col("band") - F.col("lo") - F.col("hi")).alias("room"), (F.col("hi") > 0).alias("closed")
    )
    dealt_out = entries.withColumn("forest", F.pmod(F.xxhash64("key"), F.lit(forests))).groupBy("forest")
    parts = dealt_out.applyInArrow(_near_in_forest, "word string, n long, n_near long, best string, best_n long")
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    found = parts.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("first"))
    return found.select("word", "n", "n_near", F.col("first.word").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form) links. Each round doubles how far a word sees; n grows along links, so there is no cycle."""
    links = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = durable(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(links)
        if following.filter("moved").isEmpty():
            return following.drop("moved")
        links = following


def variant_groups(docs: DataFrame, factor: int = FACTOR, trie_words: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of the texts."""
    words = durable(word_counts(docs))
    near = durable(near_words(words, trie_words))
    is_form = F.col("best_n") >= factor * F.col("n")
    formed = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
