"""Best-fit packing of token sequences by the sum-of-squares rule.

Texts are tokenised once into small piece records (no ids are moved). Full pieces fill a sequence each. The rest are
dealt at random into groups of a fixed size, and each group is packed by itself, longest first: a piece goes where the
sum over gaps of (open bins with that gap) squared becomes smallest. Group size does not depend on the input, so any
number of groups run side by side, and only a group's last few bins stay open.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Shared
from .common import durable, text_steps

CAPACITY = 2048
END_ID = 0
#: What opening a bin adds to the sum of squares: with the longest pieces first it keeps early bins from being wasted.
NEW_BIN = 30
#: Pieces packed together: a few MB of records in one task.
GROUP_PIECES = 50_000


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with end_id behind them, cut at capacity."""
    codec = Shared(docs.sparkSession, vocabulary, "word")
    end = np.array([end_id], np.uint32)

    def run(batches):
        c = codec()
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1)):
                got, doc, piece, start, length, crc = c.encode(buf, off), [], [], [], [], []
                for r in range(e - a):
                    ids = np.concatenate([got.ids[got.off[r] : got.off[r + 1]], end]).astype("<u4")
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        doc.append(a + r)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                cols = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    open_[g] bins have g left. Putting s into a bin with gap g changes the sum of squares by
    2 (open_[g - s] - open_[g]) + 2; by 1 less where the bin becomes full, as a closed bin counts as nothing, and by 1
    less for a new bin, as no gap loses one, but a new bin is charged NEW_BIN. Ties go to the smallest remaining gap;
    within a gap, to the latest bin.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made, never = 0, 4 * (len(lengths) + 1) + 2 * NEW_BIN
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (open_[: capacity + 1 - s] - open_[s:])
        change[0] -= 1
        change[-1] += NEW_BIN - 1
        change[:-1] += np.where(open_[s:capacity], 0, never)
        left = int(change.argmin())
        gap = left + s
        if gap == capacity:
            b = made
            made += 1
        else:
            b = bins[gap].pop()
            open_[gap] -= 1
        which[i], offset[i] = b, capacity - gap
        if left:
            bins[left].append(b)
            open_[left] += 1
    return which, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset: every sequence gapless, none over capacity.

    Sequence ids are unique but not consecutive: the group's number times 2^32 and the bin's number in the group.
    Pieces that repeat (doc_id, piece) are packed one by one; an empty table gives an empty one.
    """
    pieces = durable(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [f.name for f in pieces.schema]

    def run(batches):
        held: dict[int, list[pd.DataFrame]] = {}
        for pdf in batches:
            for g, part in pdf.groupby("__group"):
                held.setdefault(int(g), []).append(part)
        for g, parts in held.items():
            pdf = pd.concat(parts).sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            which, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
            yield pdf[names].assign(sequence_id=which + (np.int64(g) << 32), offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.repartition(groups, "__group").mapInPandas(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty: one id."""
    return pack(token_pieces(docs, vocabulary, id_col, text_col))


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>. Documents are tokenised again and sent to their
    sequences, at most CAPACITY ids each; doc_id must be unique here."""
    codec = Shared(docs.sparkSession, vocabulary, "word")

    def run(batches):
        c = codec()
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1)):
                got = c.encode(buf, off)
                rows = [[*got.ids[s:t].tolist(), end_id] for s, t in zip(got.off[:-1], got.off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    ids = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start") + 1, F.col("length").cast("int")).alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
