"""Token ids in files of their own format, in ascending document order.

Documents are dealt by ranges of their ids; each range becomes one file: a head, the documents' ids and lengths, and
all their token ids as one coded stream of independent, checksummed blocks. A file is written under a temporary name and
moved into place, so a task that runs twice leaves one whole file. Files are read through Spark's own binary source.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Shared
from .common import STEP_BYTES, parallel_parts, shared_folder, text_steps
from .range_coder import decode_ids, encode_ids

HEAD = b"TOKFILE1"
END_ID = 2
#: Text of an even id range; a file holds at most twice that and one document.
FILE_BYTES = 32 << 20
#: Files whose starts (a name and a number each) are broadcast; beyond it they are joined.
MAX_BROADCAST_FILES = 100_000


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, missing: np.ndarray | None = None) -> bytes:
    """missing marks documents without an id (stored apart; their doc_id entry is ignored)."""
    missing = np.zeros(len(doc_ids), bool) if missing is None else missing
    index = zlib.compress(np.diff(doc_ids.astype(np.int64), prepend=np.int64(0)).astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + np.packbits(missing).tobytes(), 1)
    return HEAD + struct.pack("<QI", len(doc_ids), len(index)) + index + struct.pack("<I", zlib.crc32(index)) + encode_ids(ids)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths, token ids and which documents have no id; ValueError if anything is damaged."""
    if data[: len(HEAD)] != HEAD:
        raise ValueError("not a token file")
    n, size = struct.unpack_from("<QI", data, len(HEAD))
    at = len(HEAD) + 12
    index = data[at : at + size]
    if struct.unpack_from("<I", data, at + size)[0] != zlib.crc32(index):
        raise ValueError("the document index is damaged")
    raw = zlib.decompress(index)
    ids, lengths = np.frombuffer(raw, "<i8", 2 * n).reshape(2, n)
    missing = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n).astype(bool)
    return np.cumsum(ids), lengths, decode_ids(data[at + size + 4 :]), missing


def _text_bytes(rows: DataFrame) -> int:
    """About how many bytes the texts have: from the files' sizes where the plan knows them, else by adding them up.
    Files are bounded as they are written, so this decides on the number of tasks alone."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes_: int = FILE_BYTES) -> DataFrame:
    """Writes part-<range>-<number>.tok files into folder and returns file, documents, ids for each (in document order).

    folder is a URI that every executor can write. There are as many id ranges as keep an even share of the text
    at about FILE_BYTES, and a range that holds more than twice that (a much repeated id, null ids) goes on in another
    file, so no task ever holds more than a file's ids and one document. Documents with equal ids are ordered by their text's hash; null ids
    come first. An empty table gives no files.
    """
    codec = Shared(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = max(parallel_parts(docs), _text_bytes(rows) // file_bytes_)
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        from pyarrow import fs

        c = codec()
        system, path = fs.FileSystem.from_uri(folder)
        held, size, number = [], 0, 0

        def flush(part: int):
            data = file_bytes(*(np.concatenate(x) for x in zip(*held, strict=True)))
            system.create_dir(path, recursive=True)
            name = f"part-{part:08d}-{number:06d}.tok"
            own = f"{path}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write(data)
            system.move(own, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "documents": [sum(len(x[0]) for x in held)], "ids": [sum(len(x[2]) for x in held)]})

        part = 0
        for b in batches:
            part = b.column(0)[0].as_py() if len(b) else part
            for a, e, buf, off in text_steps(b.column(2), min(STEP_BYTES, file_bytes_)):
                got = c.encode(buf, off)
                col = b.column(1).slice(a, e - a)
                # the end id behind every document
                held.append((col.fill_null(0).to_numpy(), np.diff(got.off) + 1, np.insert(got.ids, got.off[1:], end_id).astype(np.uint32), col.is_null().to_numpy(zero_copy_only=False)))
                size += len(buf)
                if size >= 2 * file_bytes_:
                    yield flush(part)
                    held, size, number = [], 0, number + 1
        if held:
            yield flush(part)

    return dealt.mapInArrow(run, "file string, documents long, ids long")


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """file, place, doc_id and start in the file of every document, with its ids, or their number and CRC-32 alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder).select(F.regexp_extract("path", r"(part-\d+-\d+\.tok)$", 1).alias("file"), "content")

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, lengths, ids, missing = read_file(data.as_py())
                ends = np.concatenate([[0], np.cumsum(lengths)])
                for a in range(0, len(doc_ids), 2000):
                    z = min(a + 2000, len(doc_ids))
                    cols = [pa.array([file] * (z - a), pa.string()), pa.array(np.arange(a, z)), pa.array(doc_ids[a:z], mask=missing[a:z]), pa.array(ends[a:z])]
                    if digest:
                        crc = [zlib.crc32(ids[s:t].astype("<u4").tobytes()) for s, t in zip(ends[a:z].tolist(), ends[a + 1 : z + 1].tolist(), strict=True)]
                        cols += [pa.array(lengths[a:z]), pa.array(crc, pa.int64())]
                        names = ["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"]
                    else:
                        cols.append(pa.ListArray.from_arrays((ends[a : z + 1] - ends[a]).astype(np.int32), pa.array(ids[ends[a] : ends[z]].astype(np.int32))))
                        names = ["file", "place", "doc_id", "start", "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    more = "n_tokens long, ids_crc32 long" if digest else "ids array<int>"
    return files.mapInArrow(run, f"file string, place long, doc_id long, start long, {more}")


def token_file_report(docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written to folder (a new shared one) and read."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    made = write_token_files(docs, vocabulary, folder, id_col, text_col).collect()  # a row per file
    if not made:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before, at = [], 0
    for r in sorted(made, key=lambda r: r["file"]):
        before.append((r["file"], at))
        at += r["ids"]
    starts = spark.createDataFrame(before, "file string, before long")
    rows = read_token_files(spark, folder, digest=True).join(F.broadcast(starts) if len(before) <= MAX_BROADCAST_FILES else starts, "file")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
