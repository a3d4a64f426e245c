"""Benchmark passages in training texts, found by a generalised suffix automaton over words.

The automaton of the benchmark items has a state for every class of word sequences that end at the same places in the
items. A text is streamed through it word by word; the state and the length tell the longest sequence ending here that
some item holds. Where that length reaches the window, the last ten words are a passage of an item.

A word that no item holds always leads back to the start, so only runs of known words, at least as long as the shortest
window, are streamed, many side by side as lanes of a numpy step. Long runs are cut into lanes that overlap by a window
less one word, which is all that windows need to know of what came before.

Items are dealt into blocks of a bounded number of words, each with an automaton of its own, built in a task and sent
to the executors by itself. With one block the texts are never shuffled; with more, each is a further pass over the
texts, and passages found are joined by id and digest of the text.

Null or empty text: no words, no passages. Null id: kept, and never mixed with another text's rows. Repeated rows: one
result each. An item without an id counts under the empty string; items that share an id count once; an item without
words never occurs. Empty tables give no rows, or rows without passages. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold_ascii, mix64, text_steps
from .vector import LOWERED, row_sums, span_hashes

WINDOW = 10
#: Words of the items of one automaton (some 60 MB as arrays).
BLOCK_WORDS = 1 << 20
#: Words of a run that are streamed as one lane.
LANE = 256
#: The word pattern for the benchmark's own words; texts use the same classes by byte.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FILTER_BITS = 20
SPANS = "array<struct<word:bigint,word_end:bigint,char:bigint,char_end:bigint>>"


def word_spans(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered bytes, and word offsets by row."""
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    start = inside[1:-1] & (~inside[:-2] | edge[:-1])
    end = inside[1:-1] & (~inside[2:] | edge[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., size[i] numbers of each i."""
    stop = np.cumsum(size)
    return np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


@dataclass
class Automaton:
    """Arrays of a generalised suffix automaton of items; state 0 is the start."""

    window: int
    shortest: int
    #: By state: length of its longest sequence, suffix link, the state at or above it that holds the last `window`
    #: words of a match (or -1), and the nearest at or above it that is a whole short item (or -1).
    length: np.ndarray
    link: np.ndarray
    passage: np.ndarray
    short: np.ndarray
    #: Transitions: state * words + word, in order, and where they lead.
    keys: np.ndarray
    to: np.ndarray
    #: Items by state: those whose window or whole text the state is.
    item_off: np.ndarray
    item_rank: np.ndarray
    #: Ids of items in code-point order.
    ids: list[str]
    #: Words by hash, with their bytes.
    hashes: np.ndarray
    word_off: np.ndarray
    word_bytes: np.ndarray
    repeats: int
    seen: np.ndarray = field(repr=False)

    @property
    def words(self) -> int:
        return len(self.hashes)


def build(items: list[tuple[str, list[str], bool]], window: int = WINDOW) -> Automaton:
    """The automaton of (id, words, whole) items; a whole item of fewer words than the window is a window itself."""
    vocabulary = sorted({w for _, words, _ in items for w in words})
    coded = [w.encode() for w in vocabulary]
    off = np.concatenate([[0], np.cumsum([len(w) for w in coded])]).astype(np.int64)
    data = np.frombuffer(b"".join(coded), np.uint8)
    h = span_hashes(data, off[:-1], off[1:]) if coded else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    number = {vocabulary[j]: i for i, j in enumerate(order.tolist())}
    size = np.diff(off)[order]

    following: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    for _, words, _ in items:
        last = 0
        for w in (number[x] for x in words):
            if (q := following[last].get(w)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = _split(following, length, link, last, w, q)
                continue
            cur = len(length)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in following[p]:
                following[p][w] = cur
                p = link[p]
            if p >= 0:
                q = following[p][w]
                link[cur] = q if length[q] == length[p] + 1 else _split(following, length, link, p, w, q)
            last = cur

    n, v = len(length), len(vocabulary)
    long_, up = np.array(length, np.int64), np.array(link, np.int64)
    key = np.array([s * v + w for s, x in enumerate(following) for w in x], np.int64)
    to = np.array([t for x in following for t in x.values()], np.int64)
    sort = np.argsort(key)
    repeats = int(np.unique(h, return_counts=True)[1].max()) if v else 0
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[h >> np.uint64(64 - FILTER_BITS)] = True
    ids = sorted({i for i, _, _ in items})
    words_by_hash = [coded[j] for j in order.tolist()]
    out = Automaton(
        window, min((len(w) if whole and len(w) < window else window for _, w, whole in items), default=window), long_, up, np.full(n, -1), np.full(n, -1), key[sort], to[sort],
        np.zeros(n + 1, np.int64), np.zeros(0, np.int64), ids, h[order], np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.frombuffer(b"".join(words_by_hash), np.uint8), repeats, seen,
    )
    _mark(out, [np.array([number[x] for x in w], np.int64) for _, w, _ in items], [whole for _, _, whole in items], np.searchsorted(np.array(ids, object), np.array([i for i, _, _ in items], object)) if items else np.zeros(0, np.int64))
    return out


def _split(following: list[dict[int, int]], length: list[int], link: list[int], p: int, w: int, q: int) -> int:
    """A state for the sequences of q that p's reach; q keeps its longer ones."""
    copy = len(length)
    following.append(dict(following[q]))
    length.append(length[p] + 1)
    link.append(link[q])
    link[q] = copy
    while p >= 0 and following[p].get(w) == q:
        following[p][w] = copy
        p = link[p]
    return copy


def _mark(a: Automaton, items: list[np.ndarray], whole: list[bool], rank: np.ndarray) -> None:
    """Fills passage, short and the items by state. A state comes after its link in order of length."""
    ordered = np.argsort(a.length, kind="stable")
    own = np.zeros(len(a.length), bool)
    ends: list[tuple[int, int]] = []
    for words, complete, r in zip(items, whole, rank.tolist(), strict=True):
        if complete and 0 < len(words) < a.window:
            state = 0
            for w in words.tolist():
                state = int(a.to[np.searchsorted(a.keys, state * a.words + w)])
            own[state] = True
            ends.append((state, r))
    for s in ordered.tolist():
        above = a.link[s]
        if above >= 0:
            a.passage[s] = s if a.length[above] < a.window <= a.length[s] else a.passage[above]
            a.short[s] = s if own[s] else a.short[above]
    lane_items = [i for i, w in enumerate(items) if len(w) >= a.window]
    if lane_items:
        sizes = np.array([len(items[i]) for i in lane_items])
        flat = np.concatenate([items[i] for i in lane_items])
        first = np.cumsum(sizes) - sizes
        for k, (lane, state, long_) in _stream(a, flat, *_lanes(first, sizes, a.window)):
            at = a.passage[state[long_ >= a.window]]
            where = lane[long_ >= a.window] + k
            ends += zip(at.tolist(), rank[np.array(lane_items)[np.searchsorted(first, where, "right") - 1]].tolist(), strict=True)
    pairs = np.unique(np.array(ends, np.int64).reshape(-1, 2), axis=0)
    a.item_off = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(a.length)))])
    a.item_rank = pairs[:, 1].copy()


def _lanes(first: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into lanes of up to LANE words and the window - 1 words before them; the longest first."""
    parts = -(-size // LANE)
    run = np.repeat(np.arange(len(size)), parts)
    at = _ragged(np.zeros(len(size), np.int64), parts) * LANE
    begin = first[run] + np.maximum(at - (window - 1), 0)
    end = first[run] + np.minimum(at + LANE, size[run])
    order = np.argsort(begin - end, kind="stable")
    return begin[order], (end - begin)[order]


def _stream(a: Automaton, words: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Steps all lanes word by word: yields k, (lane starts, states, matched lengths) after each lane's word k."""
    state, long_ = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
    for k, n in enumerate(alive):
        word = words[begin[:n] + k]
        todo = np.arange(n)
        while len(todo):
            key = state[todo] * a.words + word[todo]
            at = np.minimum(np.searchsorted(a.keys, key), len(a.keys) - 1)
            found = a.keys[at] == key
            go = todo[found]
            state[go] = a.to[at[found]]
            long_[go] += 1
            todo = todo[~found]
            back = a.link[state[todo]]
            state[todo], long_[todo] = np.maximum(back, 0), np.where(back < 0, 0, a.length[back])
            todo = todo[back >= 0]
        yield k, (begin[:n], state[:n], long_[:n])


def known_words(a: Automaton, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each word, or -1. Numbers are proposed by hash; `proven` compares bytes."""
    h = span_hashes(low, starts, ends)
    out = np.full(len(h), -1, np.int64)
    maybe = np.flatnonzero(a.seen[h >> np.uint64(64 - FILTER_BITS)])
    at = np.minimum(np.searchsorted(a.hashes, h[maybe]), a.words - 1)
    same = a.hashes[at] == h[maybe]
    out[maybe[same]] = at[same]
    return out


def proven(a: Automaton, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray, which: np.ndarray) -> None:
    """Compares the bytes of `which` words with the words of their numbers; sets the right number, or -1."""
    proposed = number[which].copy()
    number[which] = -1
    for k in range(a.repeats):
        left = number[which] < 0
        w = proposed[left] + k
        ok = (w < a.words) & (a.hashes[np.minimum(w, a.words - 1)] == a.hashes[proposed[left]])
        index, w = which[left][ok], w[ok]
        size = ends[index] - starts[index]
        equal = size == a.word_off[w + 1] - a.word_off[w]
        index, w, size = index[equal], w[equal], size[equal]
        differ = low[_ragged(starts[index], size)] != a.word_bytes[_ragged(a.word_off[w], size)]
        wrong = row_sums(differ, np.concatenate([[0], np.cumsum(size)])) > 0
        number[index[~wrong]] = w[~wrong]


def _runs(known: np.ndarray, woff: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of maximal runs of known words inside a row, of at least `least`."""
    edge = np.zeros(len(known) + 1, bool)
    edge[woff] = True
    inside = np.zeros(len(known) + 2, bool)
    inside[1:-1] = known
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    size = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1 - first
    return first[size >= least], size[size >= least]


def passages(a: Automaton, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; (row, first word, end, first char, end) of maximal runs of hit words; (row, rank of item)."""
    low = LOWERED[buf]
    starts, ends, woff = word_spans(low, off)
    count, nothing = np.diff(woff), (np.zeros((0, 5), np.int64), np.zeros((0, 2), np.int64))
    if not a.words or not len(starts):
        return count, *nothing
    number = known_words(a, low, starts, ends)
    first, size = _runs(number >= 0, woff, a.shortest)
    if not len(first):
        return count, *nothing
    proven(a, low, starts, ends, number, _ragged(first, size))
    usable = np.zeros(len(number), bool)
    usable[_ragged(first, size)] = True
    first, size = _runs(usable & (number >= 0), woff, a.shortest)
    end, long_, state = [], [], []
    for k, (lane, s, n) in _stream(a, number, *_lanes(first, size, a.window)):
        hit = np.flatnonzero(n >= a.window)
        end.append(lane[hit] + k + 1)
        long_.append(np.full(len(hit), a.window))
        state.append(a.passage[s[hit]])
        # whole short items: the state's own only if all of it is matched, those above it always
        t = np.where(n >= a.length[s], a.short[s], a.short[np.maximum(a.link[s], 0)])
        at = np.arange(len(s))[t >= 0]
        t = t[at]
        while len(at):
            end.append(lane[at] + k + 1)
            long_.append(a.length[t])
            state.append(t)
            t = a.short[np.maximum(a.link[t], 0)]
            at, t = at[t >= 0], t[t >= 0]
    if not (end and sum(map(len, end))):
        return count, *nothing
    end, long_, state = np.concatenate(end), np.concatenate(long_), np.concatenate(state)
    step = np.bincount(end - long_, minlength=len(number) + 1) - np.bincount(end, minlength=len(number) + 1)
    first, size = _runs(np.cumsum(step[:-1]) > 0, woff, 1)
    row = np.searchsorted(woff, first, "right") - 1
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    zero = chars[off[row]]
    spans = np.stack([row, first - woff[row], first + size - woff[row], chars[starts[first]] - zero, chars[ends[first + size - 1]] - zero], axis=1)
    seen = np.unique(np.stack([np.searchsorted(woff, end - 1, "right") - 1, state], axis=1), axis=0)
    many = a.item_off[seen[:, 1] + 1] - a.item_off[seen[:, 1]]
    items = np.stack([np.repeat(seen[:, 0], many), a.item_rank[_ragged(a.item_off[seen[:, 1]], many)]], axis=1)
    return count, spans, np.unique(items, axis=0)


def item_pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int | None = None) -> DataFrame:
    """item, words, whole: the words of each item; long items in pieces that overlap by a window less one word."""
    step = max(window, (block_words or BLOCK_WORDS) // 4)
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(fold_ascii(F.col(text_col).cast("string")), F.lit(WORD_PATTERN), 0).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window - 1), F.lit(1)), F.lit(step))
    cut = words.filter(F.size("words") > 0).select("item", "words", (F.size("words") < window).alias("whole"), F.explode(starts).alias("start"))
    return cut.select("item", F.expr(f"slice(words, start, {step + window - 1})").alias("words"), "whole")


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int | None = None) -> DataFrame:
    """block, automaton (binary): one row for each block of items, built in a task each."""
    most = block_words or BLOCK_WORDS
    pieces = durable(item_pieces(benchmark, id_col, text_col, window, most))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    # blocks are dealt by hash and so vary a little; half the bound on average
    blocks = max(1, -(-2 * total // most)) if total > most else 1
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def make(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["item"].to_pylist(), t["words"].to_pylist(), t["whole"].to_pylist(), strict=True))
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "automaton": pa.array([pickle.dumps(build(rows, window))], pa.binary())})

    return durable(dealt.groupBy("block").applyInArrow(make, "block int, automaton binary"))


def _scan(docs: DataFrame, blob: bytes, id_col: str, text_col: str, keep_text: bool, hits_only: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    spans_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("word", "word_end", "char", "char_end")]))
    names = ["doc_id", "text", "digest", "n_words", "spans", "items"]

    def run(batches):
        a = pickle.loads(shared.value)
        ids = pa.array(a.ids, pa.string())
        for batch in batches:
            for x, y, buf, off in text_steps(batch.column(1)):
                count, spans, items = passages(a, buf, off)
                n = y - x
                at = lambda rows: pa.array(np.searchsorted(rows[:, 0], np.arange(n + 1)).astype(np.int32))
                span = pa.StructArray.from_arrays([pa.array(spans[:, c]) for c in range(1, 5)], fields=list(spans_type.value_type))
                raw = buf.tobytes()
                digest = [hashlib.sha256(raw[off[i] : off[i + 1]]).digest() for i in range(n)] if not keep_text else [None] * n
                text = batch.column(1).slice(x, n) if keep_text else pa.nulls(n, pa.string())
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(x, n), text, pa.array(digest, pa.binary()), pa.array(count), pa.ListArray.from_arrays(at(spans), span), pa.ListArray.from_arrays(at(items), ids.take(pa.array(items[:, 1])))], names)
                yield out.filter(pa.compute.greater(pa.compute.list_value_length(out.column(4)), 0)) if hits_only else out

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id long, text string, digest binary, n_words long, spans {SPANS}, items array<string>")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int | None = None) -> DataFrame:
    """doc_id, text, n_words, spans (maximal runs of hit words, by word and by code point), items of every row."""
    table = automata(benchmark, window=window, block_words=block_words)
    numbers = sorted(r[0] for r in table.select("block").collect())
    blob = lambda b: bytes(table.filter(F.col("block") == b).first()["automaton"])
    if len(numbers) < 2:
        only = blob(numbers[0]) if numbers else pickle.dumps(build([], window))
        return _scan(docs, only, id_col, text_col, True, False).drop("digest")
    hits = None
    for b in numbers:
        found = durable(_scan(docs, blob(b), id_col, text_col, False, True).select("doc_id", "digest", F.lit(b).alias("block"), "spans", "items"))
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.dropDuplicates(["doc_id", "digest", "block"]).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), _merged("spans").alias("spans"), "items")
    none = build([], window)
    rows = _scan(docs, pickle.dumps(none), id_col, text_col, True, False).select("doc_id", "text", "n_words")
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)) == F.col("hit_digest")), "left")
    return joined.select("doc_id", "text", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(spans: str):
    """Overlapping or adjacent spans as one, in order."""
    first = "named_struct('done', CAST(array() AS {t}), 'last', CAST(NULL AS {s}))"
    step = """CASE WHEN a.last IS NULL THEN named_struct('done', a.done, 'last', x)
        WHEN x.word <= a.last.word_end THEN named_struct('done', a.done, 'last', named_struct('word', a.last.word, 'word_end', greatest(a.last.word_end, x.word_end), 'char', a.last.char, 'char_end', greatest(a.last.char_end, x.char_end)))
        ELSE named_struct('done', array_append(a.done, a.last), 'last', x) END"""
    start = first.format(t=SPANS, s=SPANS[len("array<") : -1])
    return F.expr(f"aggregate(array_sort({spans}), {start}, (a, x) -> {step}, a -> CASE WHEN a.last IS NULL THEN a.done ELSE array_append(a.done, a.last) END)")


def hit_words(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.word_end - s.word)")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (the most consecutive hit words) by row."""
    found = find_passages(docs, benchmark, window=window, block_words=block_words)
    longest = F.expr("coalesce(array_max(transform(spans, s -> s.word_end - s.word)), 0L)")
    items = F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256)
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), longest.alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_words: int = WINDOW, most_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_removed: spans of at least `least_words` hit words are cut out; rows with a larger share of hit
    words than `most_coverage` are left out. Rows without passages keep their text, null included."""
    found = find_passages(docs, benchmark, window=window).filter(hit_words() <= F.lit(most_coverage) * F.col("n_words"))
    cut = found.withColumn("cut", F.expr(f"filter(spans, s -> s.word_end - s.word >= {int(least_words)})"))
    kept = F.expr(
        """aggregate(cut, named_struct('text', '', 'at', 0L), (a, s) -> named_struct('text', concat(a.text, substr(text, CAST(a.at + 1 AS INT), CAST(s.char - a.at AS INT))), 'at', s.char_end),
        a -> concat(a.text, substr(text, CAST(a.at + 1 AS INT))))"""
    )
    return cut.select("doc_id", F.when(F.size("cut") > 0, kept).otherwise(F.col("text")).alias("text"), hit_words("cut").alias("n_removed"))
