"""Language identification by string kernels.

A text's blended spectrum is the set of its hashed n-grams of 1 to 4 bytes (letters folded, words padded); the kernel
is the normalised count of shared n-grams. A bounded, per-language sample of the labelled rows gives landmarks (Nystrom) and
training rows for one-versus-rest kernel ridge regression; every text is then scored by batched matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix64, text_steps

DIM = 1 << 13
#: Bounds of the sample that the model is fitted on: rows in all, and rows a language; landmarks in all.
MAX_TRAIN, TRAIN_PER_LANG, MAX_LANDMARKS = 4000, 400, 128
#: Rows whose spectra are held at a time (16 KiB each and more).
STEP_ROWS = 1024
RIDGE = 1e-2
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~_LETTER] = 32
_ANY_LETTER = regex.compile(r"\p{L}")


def spectrum(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x DIM of 0/1: which hashed n-grams of 1 to 4 bytes (a run of non-letters reads as one space) occur."""
    rows = len(off) - 1
    out = np.zeros((rows, DIM), np.uint8)
    f = _FOLD[buf]
    if len(f) > 1:  # É and the like fold with their lower case: in UTF-8, C3 80-9E to C3 A0-BE
        high = (f[1:] >= 0x80) & (f[1:] <= 0x9E) & (buf[:-1] == 0xC3)
        f[1:][high] += 32
    keep = np.ones(len(f), bool)
    keep[1:] = ~((f[1:] == 32) & (f[:-1] == 32))
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))[keep]
    f = f[keep].astype(np.uint32)
    gram = np.zeros(len(f), np.uint32)
    for n in range(1, 5):
        m = len(f) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(256) + f[n - 1 :] if n > 1 else f
        inside = row[:m] == row[n - 1 :]
        h = gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA77 & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - 13)
        out[row[:m][inside], h[inside]] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    size = np.sqrt(x.sum(1, keepdims=True))
    return x / np.maximum(size, 1)


@dataclass(frozen=True)
class KernelModel:
    langs: list[str]
    landmarks: np.ndarray  # DIM x landmarks, unit columns
    weights: np.ndarray  # landmarks x languages

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share (0 to 1) of the softmax over one-versus-rest outputs."""
        z = (_unit(x) @ self.landmarks) @ self.weights
        p = np.exp(4 * (z - z.max(1, keepdims=True)))
        best = z.argmax(1)
        return best, p[np.arange(len(z)), best] / p.sum(1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """Learns from at most about MAX_TRAIN rows that are not held out, chosen by a hash of the id, evenly by language; of more
    languages than that, from about one row each. Every language is learned and has a landmark at least.

    Rows that repeat an id count once. None if no row has a language. Ties between languages fall to the first in alphabetical order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    quota = min(TRAIN_PER_LANG, max(1, MAX_TRAIN // len(counts)))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, quota / c)) for lang, c in sorted(counts.items())], "lang string, share double")
    u = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # a language of few rows gives its first one at least
    first = rows.groupBy("lang").agg(F.min("doc_id").alias("first")).join(F.broadcast(shares), "lang")
    # a repeated row counts once, so that a much repeated id cannot swell the sample
    chosen = rows.join(F.broadcast(first), "lang").filter((u < F.col("share")) | (F.col("doc_id") == F.col("first"))).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")

    def sample(batches):
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1)):
                packed = np.packbits(spectrum(buf, off), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array([r.tobytes() for r in packed], pa.binary()), b.column(2).slice(a, e - a)], ["doc_id", "bits", "lang"])

    got = chosen.mapInArrow(sample, "doc_id long, bits binary, lang string").collect()  # bounded: about MAX_TRAIN rows of DIM bits
    got.sort(key=lambda r: (int(mix64(np.array([r["doc_id"]], np.int64).view(np.uint64))[0]), r["doc_id"]))
    langs = sorted(counts)
    place = {lang: i for i, lang in enumerate(langs)}
    y = np.array([place[r["lang"]] for r in got])
    if not len(y):
        return None
    x = _unit(np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in got]))
    per = max(1, MAX_LANDMARKS // len(langs))
    marks = np.concatenate([np.flatnonzero(y == c)[:per] for c in range(len(langs))])
    land = x[marks].T.copy()
    k = x @ land
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    scale = 1 / np.maximum(np.bincount(y, minlength=len(langs)), 1)[y]  # every language weighs the same
    kw = k * scale[:, None]
    lhs = kw.T @ k + RIDGE * (x[marks] @ land) * scale.mean() + 1e-6 * np.eye(len(marks))
    return KernelModel(langs, land, np.linalg.solve(lhs.astype(float), kw.T.astype(float) @ target).astype(np.float32))


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. A null text, or one with no letter, is 'und' with score 0;
    so is every text if there is nothing to learn from. Whole texts are read; other columns are ignored."""
    model = fit(docs, id_col, text_col, lang_col)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for a, e, buf, off in text_steps(texts, 1 << 20):
                pred, score = np.full(e - a, UNKNOWN, object), np.zeros(e - a)
                solid = np.array([bool(t) and _ANY_LETTER.search(t) is not None for t in texts.slice(a, e - a).to_pylist()])
                if model is not None and solid.any():
                    for r in range(0, e - a, STEP_ROWS):
                        z = slice(r, min(r + STEP_ROWS, e - a))
                        cut = off[r : z.stop + 1]
                        best, s = model.score(spectrum(buf[cut[0] : cut[-1]], cut - cut[0]))
                        pred[z], score[z] = np.array(model.langs, object)[best], s
                    pred[~solid], score[~solid] = UNKNOWN, 0
                yield pa.RecordBatch.from_arrays([ids.slice(a, e - a), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
