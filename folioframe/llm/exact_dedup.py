"""Exact duplicates by two passes over Bloom filters of text hashes.

Pass one builds, block by block, a filter of the hashes seen at all and one of the hashes seen again. Pass two tests
every row against the second: a row that fails is certainly alone and passes straight through; only the rest are
grouped, on the SHA-256 of the whole normalised text. A filter can only err towards more rows being grouped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from .common import durable, fold_ascii, parallel_parts, shared_folder

#: A block is one reducer's unit of filter.
BLOCK_BITS = 1 << 16
BITS_PER_ROW = 16
#: The largest filter that is sent to every executor (32 MiB). Larger tables are filtered slice by slice.
MAX_FILTER_BITS = 1 << 28
#: Groups of more rows than HOT_ROWS are joined by broadcast while there are at most MAX_HOT_GROUPS (about 10 MB).
HOT_ROWS, MAX_HOT_GROUPS = 1000, 100_000
#: Dropped ids up to this count are broadcast (8 MB of longs); beyond it the join shuffles.
MAX_BROADCAST_IDS = 1_000_000


def filter_bits(rows: int, per_row: int = BITS_PER_ROW) -> int:
    return max(BLOCK_BITS, 1 << (max(1, rows) * per_row - 1).bit_length())


def positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and the two bit positions inside it, from disjoint parts of the hash."""
    u = h.astype(np.int64).view(np.uint64)
    block = (u >> np.uint64(32)) % np.uint64(bits // BLOCK_BITS)
    return block.astype(np.int64), (u & np.uint64(0xFFFF)).astype(np.int64), ((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)


def _sketch(bits: int):
    """One row per task and block: the bit positions of the task's hashes, and of those it saw twice."""

    def run(batches):
        seen: dict[int, int] = {}
        for pdf in batches:
            values, counts = np.unique(pdf["h"].to_numpy(np.int64), return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist(), strict=True):
                seen[v] = min(2, seen.get(v, 0) + c)
            if len(seen) >= 500_000:
                yield from flush(seen)
                seen = {}
        if seen:
            yield from flush(seen)

    def flush(seen):
        h = np.fromiter(seen.keys(), np.int64, len(seen))
        twice = np.fromiter(seen.values(), np.int64, len(seen)) > 1
        block, p, q = positions(h, bits)
        order = np.argsort(block, kind="stable")
        block, p, q, twice = block[order], p[order], q[order], twice[order]
        ids, first = np.unique(block, return_index=True)
        rows = []
        for b, s, e in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
            pair = np.stack([p[s:e], q[s:e]], 1).astype(np.uint16)
            rows.append((b, pair.tobytes(), pair[twice[s:e]].tobytes()))
        yield pd.DataFrame(rows, columns=["block", "once", "twice"])

    return run


def _merge(batches):
    """Per block, in any order of its tasks' rows: bits seen again are those set by two rows, or twice within one."""
    state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for b, once, twice in zip(pdf["block"].tolist(), pdf["once"], pdf["twice"], strict=True):
            if b not in state:
                state[b] = (np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool))
            have, again = state[b]
            pos = np.frombuffer(once, np.uint16).reshape(-1, 2)
            hit = have[pos[:, 0]] & have[pos[:, 1]]
            again[pos[hit].ravel()] = True
            again[np.frombuffer(twice, np.uint16)] = True
            have[pos.ravel()] = True
    rows = [(b, zlib.compress(np.packbits(again).tobytes(), 1)) for b, (_, again) in state.items() if again.any()]
    yield pd.DataFrame(rows, columns=["block", "bits"])


def _flagged(keys: DataFrame, bits: int) -> DataFrame:
    """keys with maybe_repeated, from one filter of so many bits."""
    merged = (
        keys.select("h")
        .mapInPandas(_sketch(bits), "block long, once binary, twice binary")
        .repartition(parallel_parts(keys), "block")
        .mapInPandas(_merge, "block long, bits binary")
        .collect()
    )  # at most bits / 8 bytes, which the caller bounds
    shared = keys.sparkSession.sparkContext.broadcast({r["block"]: bytes(r["bits"]) for r in merged})
    opened: dict[int, np.ndarray] = {}

    def test(h: pd.Series) -> pd.Series:
        if not opened:
            opened.update({b: np.frombuffer(zlib.decompress(z), np.uint8) for b, z in shared.value.items()})  # a byte for 8 bits
        block, p, q = positions(h.to_numpy(np.int64), bits)
        out = np.zeros(len(h), bool)
        order = np.argsort(block, kind="stable")
        ids, first = np.unique(block[order], return_index=True)
        for b, s, e in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
            if (bit := opened.get(b)) is not None:
                i = order[s:e]
                out[i] = (bit[p[i] >> 3] >> (7 - (p[i] & 7))) & (bit[q[i] >> 3] >> (7 - (q[i] & 7))) & 1
        return pd.Series(out)

    return keys.withColumn("maybe_repeated", F.pandas_udf(test, "boolean")("h"))


def repeated_flag(keys: DataFrame, rows: int, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """keys (h long, ...) with maybe_repeated boolean: false only where h is certain to occur once.

    A table that would need a filter of more than max_bits is dealt into slices by hash, written apart without a
    shuffle, and every slice goes through its two passes by a filter of its own.
    """
    bits = filter_bits(rows)
    if bits <= max_bits:
        return durable(_flagged(keys, bits))
    spark, slices = keys.sparkSession, -(-bits // max_bits)
    folder = shared_folder(spark, "slices")
    keys.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(slices)).cast("int")).write.partitionBy("slice").parquet(f"{folder}/keys")
    schema = StructType([*keys.schema.fields, StructField("slice", IntegerType())])
    whole = spark.read.schema(schema).parquet(f"{folder}/keys")
    for k in range(slices):
        _flagged(whole.filter(F.col("slice") == k).drop("slice"), max(max_bits, BLOCK_BITS)).write.mode("overwrite").parquet(f"{folder}/flagged/slice={k}")
    return spark.read.schema(StructType([*keys.schema.fields, StructField("maybe_repeated", BooleanType())])).parquet(f"{folder}/flagged")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normal forms are (default: A-Z lower-cased; null counts as empty). The largest id of a
    group stays. Rows that repeat an id share its fate; a null id stays only if its whole group has no other id.
    Other columns of docs are ignored, so their names cannot clash; an empty table gives an empty result.
    """
    normal = fold_ascii(F.col(text_col)) if normal is None else normal
    keys = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), normal.alias("t")).select("doc_id", F.xxhash64("t").alias("h"), F.sha2(F.col("t"), 256).alias("text_sha256")))
    flagged = repeated_flag(keys, keys.count(), max_bits)
    alone = flagged.filter(~F.col("maybe_repeated")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    rest = flagged.filter("maybe_repeated").select("doc_id", "text_sha256")
    groups = durable(rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    hot = groups.filter(F.col("group_size") > HOT_ROWS)
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if 0 < hot.count() <= MAX_HOT_GROUPS:  # rows of large groups never meet in one task
        grouped = rest.join(F.broadcast(hot), "text_sha256").select(columns)
        cold = rest.join(F.broadcast(hot), "text_sha256", "left_anti").join(groups.filter(F.col("group_size") <= HOT_ROWS), "text_sha256").select(columns)
        grouped = grouped.unionByName(cold)
    else:
        grouped = rest.join(groups, "text_sha256").select(columns)
    return alone.unionByName(grouped).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in dropped (doc_id): by broadcast while the ids are few, else by a shuffle."""
    n = dropped.count()
    ids = dropped.select(F.col("doc_id").alias("__drop_id"))
    return docs.join(F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids, docs[id_col] == F.col("__drop_id"), "left_anti")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose text equals that of a row with a larger id.

    Rows that repeat an id go together, if none of them is to stay; a row without an id stays.
    """
    groups = durable(duplicate_groups(docs, id_col, text_col))
    return drop_ids(docs, groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id"), id_col)
