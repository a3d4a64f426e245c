"""Near-duplicate documents: an exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

1. Texts become sets of hashed 5-word shingles. Equal sets form one class; only classes are joined.
2. Every set is cut into segments of the hashed universe, as many as its size band needs, and indexed under each
   non-empty segment (small sets also under segments less one element). Signatures travel as packed arrays.
3. Signatures of few sets give candidate pairs with the number of signatures they share. A set's allocation says how
   many a linked pair must share, so most chance pairs end here; the rest are verified on the whole sets.
4. Signatures of many sets cost too much to use. A set that can afford to leave out all of its frequent signatures does
   so and loses nothing. Sets that cannot (large families of near copies, mostly) are gathered into families by the
   frequent signatures they share. There they are compared with the family's hub, and those that are not linked to it
   with all others, in blocks of bounded size by products of incidence matrices.
5. Verified links are joined up into components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix64, parallel_parts, release, text_steps
from .components import components, forest
from .exact_dedup import MAX_BROADCAST_IDS
from .setjoin_core import band, linked, signatures
from .vector import LOWERED, shingles, span_hashes, words

SHINGLE = 5
#: Signatures shared by more sets than this are frequent. Nothing is dropped by it: see step 4 above.
FREQUENT = 8
#: Signatures per reducing task, and elements per block of a family.
PART_SIGNATURES, BLOCK_ELEMENTS = 1_000_000, 200_000
#: Hubs' sets up to this size in all are broadcast; beyond it they are joined.
MAX_HUB_BYTES = 16 << 20
#: Bytes of text per vectorised step, and entries that a task holds before it passes them on.
STEP, HELD = 1 << 20, 400_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within a text, and their offsets. A-Z are lower-cased."""
    buf = LOWERED[buf]
    starts, ends, woff = words(buf, off)
    h, soff = shingles(span_hashes(buf, starts, ends), woff, size)
    for a, b in zip(soff[:-1].tolist(), soff[1:].tolist(), strict=True):
        h[a:b].sort()
    row = np.repeat(np.arange(len(soff) - 1), np.diff(soff))
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(soff) - 1))]).astype(np.int64)


#: Rounds of new node digests, should two different sets have one; each has odds of n^2 / 2^65 for n sets.
MAX_SALTS = 16


def set_digests(h: np.ndarray, off: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever its order; the first, the node's, by a salt."""
    out = []
    for salt in (0x1D8E4E27C47D124F ^ salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1, 0xEB44ACCAB455D165):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h ^ np.uint64(salt)), out=total[1:])
        out.append(mix64(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _keys(salt: int):
    def run(batches):
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1), STEP):
                h, soff = shingle_sets(buf, off)
                one, two = set_digests(h, soff, salt)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(np.diff(soff)), pa.array(one), pa.array(two)], ["doc_id", "n", "d1", "d2"])

    return run


def set_classes(texts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, n, d1, d2 of every row; n, d1, d2, rep of every distinct set; and the salt with which no two sets share d1.

    Sets are told apart by both digests, while the graph's nodes are d1 alone, so d1 is made anew until it is unique.
    """
    for salt in range(MAX_SALTS):
        keys = durable(texts.mapInArrow(_keys(salt), "doc_id long, n long, d1 long, d2 long"))
        classes = durable(keys.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
        if classes.groupBy("d1").count().filter("count > 1").isEmpty():
            return keys, classes, salt
        release(keys)
        release(classes)
    raise ValueError(f"node digests clash with {MAX_SALTS} salts")


_ENTRY = np.dtype([("sig", "<u8"), ("id", "<i8"), ("need", "<i2"), ("flag", "<u2")])
_PROBE, _LESS, _SMALL = 1, 2, 4


def _entries(h: np.ndarray, off: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Index entries of sets in their own band, and probes into the band below where that can hold linked sets."""
    n = np.diff(off)
    out = []
    own = np.flatnonzero(n > 0)
    j = band(n)
    low = own[(j[own] > 0) & (band((3 * n[own] + 3) // 4) < j[own])]
    for rows, shift, flag in ((own, 0, 0), (low, 1, _PROBE)):
        if not len(rows):
            continue
        mine = np.zeros(len(n), bool)
        mine[rows] = True
        sig, who, less, need = signatures(h[np.repeat(mine, n)], np.concatenate([[0], np.cumsum(n[rows])]), j[rows] - shift)
        e = np.zeros(len(sig), _ENTRY)
        e["sig"], e["id"], e["need"] = sig, ids[rows][who], np.minimum(need, 32767)[who]  # less than a set has is safe
        e["flag"] = flag | np.where(less, _LESS, 0)
        twos = np.zeros(len(rows), bool)
        twos[np.unique(who[less])] = True
        e["flag"] |= np.where(twos[who], _SMALL, 0).astype(np.uint16)
        out.append(e)
    return np.concatenate(out) if out else np.zeros(0, _ENTRY)


def _index(parts: int, salt: int = 0):
    """Packed entries by reducing part. Sets met before in the task are indexed once."""

    def run(batches):
        held, size, seen = [], 0, set()
        for b in batches:
            for _, _, buf, off in text_steps(b.column(0), STEP):
                h, soff = shingle_sets(buf, off)
                ids, _ = set_digests(h, soff, salt)
                fresh = np.array([i not in seen and not seen.add(i) for i in ids.tolist()])
                if len(seen) > 100_000:
                    seen.clear()
                if fresh.any():
                    h = h[np.repeat(fresh, np.diff(soff))]
                    soff = np.concatenate([[0], np.cumsum(np.diff(soff)[fresh])])
                    held.append(_entries(h, soff, ids[fresh]))
                    size += len(held[-1])
                if size >= HELD:
                    yield from pack(held)
                    held, size = [], 0
        if size:
            yield from pack(held)

    def pack(held):
        e = np.concatenate(held)
        part = ((e["sig"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(at[1:], len(e))
        yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([e[a:z].tobytes() for a, z in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())], ["part", "entries"])

    return run


_PAIR, _FREQUENT, _SHORT = 0, 1, 2


def _candidates(batches):
    """Of a part's signatures: candidate pairs with what they share, frequent entries, and sets short of units."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held.setdefault(p, []).append(np.frombuffer(x.as_buffer(), _ENTRY))
    for p in sorted(held):
        e = np.concatenate(held.pop(p))
        e = e[np.lexsort((e["flag"], e["id"], e["sig"]))]
        keep = np.ones(len(e), bool)
        keep[1:] = (e["sig"][1:] != e["sig"][:-1]) | (e["id"][1:] != e["id"][:-1])  # one entry a set, the whole segment's first
        e = e[keep]
        at = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]]))
        count = np.diff(np.append(at, len(e)))
        yield from _frequent(e[np.repeat(count > FREQUENT, count)])
        if len(short := np.unique(e["id"][e["need"] <= 0])):
            yield from _rows(_SHORT, short, short, *[np.zeros(len(short), np.int64)] * 3)
        found = []
        for c in range(2, FREQUENT + 1):
            first = at[count == c]
            for x in range(c):
                for y in range(x + 1, c):
                    found.append((first + x, first + y))
        if not found:
            continue
        a, b = e[np.concatenate([f[0] for f in found])], e[np.concatenate([f[1] for f in found])]
        ok = ((a["flag"] & b["flag"] & (_PROBE | _LESS)) == 0) & (a["id"] != b["id"])
        a, b = a[ok], b[ok]
        swap = a["id"] > b["id"]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.lexsort((b["id"], a["id"]))
        a, b = a[order], b[order]
        if not len(a):
            continue
        run = np.flatnonzero(np.concatenate([[True], (a["id"][1:] != a["id"][:-1]) | (b["id"][1:] != b["id"][:-1])]))
        shared = np.diff(np.append(run, len(a)))
        need = [np.where(x["flag"] & _SMALL, 1, x["need"])[run] for x in (a, b)]
        yield from _rows(_PAIR, a["id"][run], b["id"][run], shared, need[0], need[1])


def _frequent(e):
    """Entries under frequent signatures: signature, set, units that leaving it out costs, allocation, space."""
    cost = np.where(((e["flag"] & _SMALL) != 0) & ((e["flag"] & _LESS) == 0), 2, 1)
    yield from _rows(_FREQUENT, e["sig"].view(np.int64), e["id"], cost, e["need"], e["flag"] & _PROBE)


def _rows(kind, a, b, n, x, y):
    for s in range(0, len(a), 50_000):
        z = slice(s, s + 50_000)
        cols = [np.full(len(a[z]), kind, np.int32), a[z].astype(np.int64), b[z].astype(np.int64), n[z].astype(np.int32), x[z].astype(np.int32), y[z].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["kind", "a", "b", "n", "x", "y"])


def _set_rows(salt: int):
    def run(batches):
        for b in batches:
            for _, _, buf, off in text_steps(b.column(0), STEP):
                h, soff = shingle_sets(buf, off)
                one, _ = set_digests(h, soff, salt)
                blobs = pa.array([h[s:t].tobytes() for s, t in zip(soff[:-1].tolist(), soff[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(one), blobs], ["id", "hashes"])

    return run


def _verify(batches):
    for b in batches:
        a_id, b_id, keep = b.column(0).to_numpy(), b.column(2).to_numpy(), np.zeros(len(b), bool)
        for r, (x, y) in enumerate(zip(b.column(1), b.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            keep[r] = linked(np.isin(x, y, assume_unique=True, kind="sort").sum(), len(x), len(y))
        yield pa.RecordBatch.from_arrays([pa.array(a_id[keep]), pa.array(b_id[keep])], ["a", "b"])


def block_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between left and right (numbers into sets), from a product of incidences."""
    n = np.array([len(s) for s in sets])
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    often = np.bincount(code, minlength=len(value)) > 1
    number = np.cumsum(often) - 1
    code, row = number[code[often[code]]], row[often[code]]
    inter = np.zeros((len(left), len(right)), np.float32)
    where = np.full((2, len(sets)), -1)
    where[0, left], where[1, right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for s in range(0, int(often.sum()), 4096):
        a, z = np.searchsorted(code, [s, s + 4096])
        mats = []
        for side, size in ((0, len(left)), (1, len(right))):
            m, r = np.zeros((size, 4096), np.float32), where[side, row[a:z]]
            m[r[r >= 0], code[a:z][r >= 0] - s] = 1
            mats.append(m)
        inter += mats[0] @ mats[1].T
    x, y = np.nonzero(linked(np.rint(inter).astype(np.int64), n[left][:, None], n[right][None, :]))
    a, b = ids[left[x]], ids[right[y]]
    if not len(a):
        return a, b
    return forest(a, b)


def _family_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of one pair (or within its one block)."""
    pdf = pdf.sort_values("id")
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    mine, first, second = pdf["block"].to_numpy(), pdf["first"].iloc[0], pdf["second"].iloc[0]
    a, b = block_links(pdf["id"].to_numpy(), sets, np.flatnonzero(mine == first), np.flatnonzero(mine == second))
    return pd.DataFrame({"a": a, "b": b})


def _star(poor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """poor with `star`: whether a set is linked to its family's hub, the set of about median size; and these links."""
    middle = poor.groupBy("family").agg(F.percentile_approx("n", 0.5).alias("middle"))
    hub = durable(poor.select("family", "id", "n").join(middle, "family").groupBy("family").agg(F.min(F.struct(F.abs(F.col("n") - F.col("middle")).alias("off"), "id"))["id"].alias("hub")))
    hubs = durable(poor.join(hub.select(F.col("hub").alias("id")), "id", "left_semi").select("family", F.col("id").alias("b"), F.col("hashes").alias("hub_set"), F.col("n").alias("hub_n")))
    small = (hubs.agg(F.sum(F.length("hub_set"))).first()[0] or 0) <= MAX_HUB_BYTES
    near = poor.join(F.broadcast(hubs) if small else hubs, "family").filter((F.col("n") * 4 >= F.col("hub_n") * 3) & (F.col("hub_n") * 4 >= F.col("n") * 3))
    links = durable(near.select(F.col("id").alias("a"), F.col("hashes").alias("a_set"), "b", "hub_set").mapInArrow(_verify, "a long, b long"))
    return poor.join(links.select(F.col("a").alias("id"), F.lit(True).alias("star")), "id", "left").withColumn("star", F.coalesce("star", F.lit(False))), links


def _family_links(poor: DataFrame) -> DataFrame:
    """a, b: links among the sets (id, hashes, n, family) of each family that join up its components.

    Every set is compared with its family's hub first. Sets linked to the hub are of one component, so they need not be
    compared with each other; all other pairs are, in blocks of about BLOCK_ELEMENTS.
    """
    poor, stars = _star(poor)
    stratum = F.struct("star", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.15))).cast("int").alias("size"))
    poor = durable(poor.withColumn("stratum", stratum))
    sizes = poor.groupBy("family", "stratum").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"), F.min("n").alias("least"), F.max("n").alias("most"))
    placed = poor.join(sizes.select("family", "stratum", "blocks"), ["family", "stratum"]).withColumn("block", F.struct("stratum", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k")))
    x, y = sizes.alias("x"), sizes.alias("y")
    open_ = ~(F.col("x.stratum.star") & F.col("y.stratum.star"))
    alike = (F.col("x.most") * 4 >= F.col("y.least") * 3) & (F.col("y.most") * 4 >= F.col("x.least") * 3)
    near = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.stratum") <= F.col("y.stratum")) & open_ & alike)
    blocks = lambda side, name: F.transform(F.sequence(F.lit(0), F.col(f"{side}.blocks") - 1), lambda k: F.struct(F.col(f"{side}.stratum").alias("stratum"), k.alias("k")))
    pairs = near.select(F.col("x.family").alias("family"), F.explode(blocks("x", "first")).alias("first"), blocks("y", "second").alias("others")).select("family", "first", F.explode("others").alias("second"))
    pairs = pairs.filter((F.col("first.stratum") < F.col("second.stratum")) | (F.col("first.k") <= F.col("second.k")))
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("first", "second"))))
    dealt = placed.join(ends, ["family", "block"]).select(F.to_json("block").alias("block"), F.to_json("first").alias("first"), F.to_json("second").alias("second"), "family", "id", "hashes")
    return stars.union(dealt.groupBy("family", "first", "second").applyInPandas(_family_block, "a long, b long"))


def _short_links(texts: DataFrame, short: DataFrame, salt: int = 0) -> list[DataFrame]:
    """Links of sets that the pigeonhole cannot serve (a few in a billion) with all sets, a bounded block at a time."""
    out = []
    rows = short.orderBy("id").toLocalIterator()
    block: list = []
    size = 0

    def scan(block):
        def run(batches):
            index = {}
            for k, r in enumerate(block):
                for h in np.frombuffer(r["hashes"], np.uint64).tolist():
                    index.setdefault(h, []).append(k)
            known = np.array(sorted(index), np.uint64)
            for b in batches:
                for _, _, buf, off in text_steps(b.column(0), STEP):
                    h, soff = shingle_sets(buf, off)
                    one, _ = set_digests(h, soff, salt)
                    hit = np.flatnonzero(np.isin(h, known))
                    row = np.searchsorted(soff, hit, "right") - 1
                    inter: dict[tuple[int, int], int] = {}
                    for r, x in zip(row.tolist(), h[hit].tolist(), strict=True):
                        for k in index[x]:
                            inter[r, k] = inter.get((r, k), 0) + 1
                    ok = [(r, k) for (r, k), i in inter.items() if linked(np.int64(i), soff[r + 1] - soff[r], len(block[k]["hashes"]) // 8)]
                    yield pa.RecordBatch.from_arrays([pa.array(one[[r for r, _ in ok]] if ok else [], pa.int64()), pa.array([block[k]["id"] for _, k in ok], pa.int64())], ["a", "b"])

        return texts.mapInArrow(run, "a long, b long")

    for r in rows:
        block.append(r)
        size += len(r["hashes"])
        if size > 8 << 20:
            out.append(durable(scan(block)))
            block, size = [], 0
    if block:
        out.append(durable(scan(block)))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable over links of similarity 3/4 or more.

    Null and empty texts, and texts of separators only, have no shingles and are alone. A text of one to four words is
    one shingle. Equal sets are one node of the graph, and rows that repeat an id with different texts are different
    nodes. A row with a null id links like any other; it has its component's smallest id (null if all ids there are).
    Only id and text are read, so other columns cannot clash.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys, classes, salt = set_classes(texts)
    total = keys.agg(F.sum("n")).first()[0] or 0
    parts = max(parallel_parts(docs), -(-total // (2 * PART_SIGNATURES)))
    found = durable(
        texts.select("text").mapInArrow(_index(parts, salt), "part long, entries binary")
        .repartition(parts, "part")
        .mapInArrow(_candidates, "kind int, a long, b long, n int, x int, y int")
    )
    frequent = found.filter(F.col("kind") == _FREQUENT).select(F.col("a").alias("sig"), F.col("b").alias("id"), F.col("n").alias("cost"), F.col("x").alias("need"), F.col("y").alias("space"))
    lost = frequent.groupBy("id", "space").agg(F.sum("cost").alias("lost"), F.max("need").alias("need"))
    lost = durable(lost.groupBy("id").agg(F.sum("lost").alias("lost"), F.max(F.col("lost") >= F.col("need")).alias("poor")))
    pairs = found.filter(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("shared"), F.max("x").alias("need_a"), F.max("y").alias("need_b"))
    for side in ("a", "b"):
        pairs = pairs.join(lost.select(F.col("id").alias(side), F.col("lost").alias(f"lost_{side}")), side, "left")
    enough = [F.col("shared") >= F.col(f"need_{s}") - F.coalesce(f"lost_{s}", F.lit(0)) for s in "ab"]
    pairs = durable(pairs.filter(enough[0] & enough[1]).select("a", "b"))
    poor = lost.filter("poor").select("id")
    members = frequent.join(poor, "id", "left_semi")
    stars = members.join(members.groupBy("sig").agg(F.min("id").alias("hub")), "sig").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    families = durable(components(stars))

    # whole sets, of one row for each class that is in question; rows without an id are looked at as well
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(families.select("node")).union(found.filter(F.col("kind") == _SHORT).select("a")).distinct())
    reps = durable(classes.filter("rep IS NOT NULL").join(wanted, classes["d1"] == wanted["id"], "left_semi").select("rep"))
    few = reps.count() <= MAX_BROADCAST_IDS
    some = texts.join(F.broadcast(reps) if few else reps, texts["doc_id"] == reps["rep"], "left_semi").select("text")
    if not classes.filter("rep IS NULL").isEmpty():
        some = some.union(texts.filter("doc_id IS NULL").select("text"))
    sets = durable(some.mapInArrow(_set_rows(salt), "id long, hashes binary").join(wanted, "id", "left_semi").dropDuplicates(["id"]))
    side = lambda s: sets.select(F.col("id").alias(s), F.col("hashes").alias(f"{s}_set"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "a_set", "b", "b_set").mapInArrow(_verify, "a long, b long")
    relatives = sets.join(families.select(F.col("node").alias("id"), F.col("label").alias("family")), "id").withColumn("n", (F.length("hashes") / 8).cast("long"))
    links = checked.union(_family_links(durable(relatives)))
    short = durable(found.filter(F.col("kind") == _SHORT).select(F.col("a").alias("id")).distinct())
    if not short.isEmpty():  # links of these to any row of the corpus come from a scan
        for more in _short_links(texts.select("text"), durable(sets.join(short, "id", "left_semi")), salt):
            links = links.union(more)
    # the graph's nodes are the classes, whether or not any row of theirs has an id
    label = durable(components(links))
    named = classes.join(label, classes["d1"] == label["node"], "left").select("n", "d1", "d2", "rep", F.coalesce("label", "d1").alias("label"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component"))
    out = keys.join(named.join(lowest, "label").select("n", "d1", "d2", "component"), ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest id.

    Rows that repeat an id go together, if none of them is to stay; a row without an id stays.
    """
    from .exact_dedup import drop_ids

    found = durable(near_duplicates(docs, id_col, text_col))
    go = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.coalesce("component_id", "doc_id")).alias("go"))
    return drop_ids(docs, go.filter("go").select("doc_id"), id_col)
