"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics. Per class, counts, sums and outer products are added up
over every labelled row (partial sums by task, so the driver sees two small matrices whatever the size); the
covariances are shrunk towards their pooled diagonal and factored once. A score is the logistic of the difference of
the classes' Gaussian log densities, from triangular solves with the cached Cholesky factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out, text_steps
from .vector import row_sums, span_hashes, words

FEATURES = (
    "mean_word", "upper", "digit", "symbol", "bar", "line_rate", "distinct_words", "same_as_last",
    "symbol_end", "upper_words", "sentence_ends", "long_words", "bigram_repeats", "vowel_free",
)
THRESHOLD = 0.3
PRIOR_WORDS = 20.0

_CLASS = {k: np.zeros(256, bool) for k in ("upper", "digit", "symbol", "bar", "newline", "stop", "lower")}
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
for _c in b"#$%&*<>=_^~@{}[]\\/+`!":
    _CLASS["symbol"][_c] = True
_CLASS["bar"][ord("|")] = True
_CLASS["newline"][10] = True
for _c in b".!?":
    _CLASS["stop"][_c] = True
_CLASS["lower"][97:123] = True
_VOWEL = np.zeros(256, bool)
for _c in b"aeiouyAEIOUY":
    _VOWEL[_c] = True
_VOWEL[0xC3:] = True  # a word of letters beyond ASCII is not known to lack vowels


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has those of an ordinary text."""
    cls = {k: row_sums(lut[buf], off) for k, lut in _CLASS.items()}
    big = _CLASS["upper"][buf]
    if len(buf):
        big[1:] |= (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[:-1] == 0xC3)
    upper = row_sums(big, off)
    ws, we, woff = words(buf, off)
    k = np.diff(woff)
    length = we - ws
    h = span_hashes(buf, ws, we)
    row = np.repeat(np.arange(len(k)), k)
    first = np.zeros(len(h), bool)
    first[woff[:-1][k > 0]] = True
    prev = np.roll(h, 1)
    same = (h == prev) & ~first
    salt = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    pair = np.where(first, np.uint64(0), h * np.uint64(31) + prev)

    def distinct(x: np.ndarray) -> np.ndarray:
        x = x + salt
        order = np.argsort(x, kind="stable")
        new = np.ones(len(x), bool)
        s = x[order]
        new[1:] = s[1:] != s[:-1]
        return np.bincount(row[order][new], minlength=len(k)).astype(float)

    last = buf[np.maximum(we - 1, 0)] if len(we) else np.zeros(0, np.uint8)
    cum = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(big, out=cum[1:])
    ups = cum[we] - cum[ws]
    np.cumsum(_VOWEL[buf], out=cum[1:])
    vow = cum[we] - cum[ws]
    # rates are drawn towards an ordinary text's by PRIOR_WORDS of it, so that a few odd words don't damn a short text
    kp, np_ = k + PRIOR_WORDS, np.diff(off) + 6.0 * PRIOR_WORDS
    cols = [
        np.log((row_sums(length, woff) + 5.0 * PRIOR_WORDS) / kp),
        np.sqrt((upper + 0.1 * PRIOR_WORDS) / np_),
        np.sqrt(cls["digit"] / (np_ + 100)),
        np.sqrt(cls["symbol"] / np_),
        np.sqrt(cls["bar"] / np_),
        np.sqrt((cls["newline"] + 0.02 * PRIOR_WORDS) / kp),
        np.sqrt((distinct(h) + 0.9 * PRIOR_WORDS) / kp),
        np.sqrt(row_sums(same, woff) / kp),
        np.sqrt(row_sums(_CLASS["symbol"][last], woff) / kp),
        np.sqrt(row_sums((ups >= 2) & (2 * ups >= length), woff) / kp),
        np.sqrt((cls["stop"] + 0.08 * PRIOR_WORDS) / kp),
        np.sqrt((row_sums(length > 12, woff) + 0.02 * PRIOR_WORDS) / kp),
        np.sqrt(np.maximum(0, k - distinct(pair)) / kp),
        np.sqrt((row_sums(vow == 0, woff) + 0.05 * PRIOR_WORDS) / kp),
    ]
    return np.stack(cols, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x array<double>: FEATURES of each whole text (null counts as empty)."""

    def run(batches):
        for b in batches:
            for a, e, buf, off in text_steps(b.column(1)):
                x = features(buf, off)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), flat], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def inverse_lower(lower: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix by forward substitution."""
    out = np.eye(len(lower))
    for i in range(len(lower)):
        out[i] = (out[i] - lower[i, :i] @ out[:i]) / lower[i, i]
    return out


@dataclass(frozen=True)
class Discriminant:
    """Fitted classes: means, inverse lower Cholesky factors (solved for once), log determinants, log priors."""

    mean: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logp = []
        for c in (0, 1):
            z = self.whiten[c] @ (x - self.mean[c]).T
            logp.append(self.prior[c] - 0.5 * (np.square(z).sum(0) + self.logdet[c]))
        return 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -50, 50)))


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrinkage: float = 0.1) -> Discriminant | float:
    """Fits on every labelled row that is not held out. With one class or none, returns that class's rate (0.5 if none).

    Rows with a null id or label are ignored; a document labelled more than once counts once, by its larger label.
    """
    d = len(FEATURES)
    marks = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))

    def sums(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for pdf in batches:
            x, y = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, d)), pdf["y"].to_numpy()
            for c in (0, 1):
                part = x[y == c]
                acc[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        import pandas as pd

        yield pd.DataFrame({"v": [acc.ravel().tolist()]})

    rows = statistics.join(marks, "doc_id").select("x", "y").mapInPandas(sums, "v array<double>")
    size = 2 * (1 + d + d * d)
    total = rows.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # `size` rows
    acc = np.zeros(size)
    for r in total:
        acc[r["i"]] = r["v"]
    acc = acc.reshape(2, -1)
    n = acc[:, 0]
    if min(n) < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    mean = acc[:, 1 : 1 + d] / n[:, None]
    cov = acc[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.diag(np.maximum(np.einsum("c,cii->i", n, cov) / n.sum(), 1e-4))
    cov = (1 - shrinkage) * cov + shrinkage * pooled + 1e-6 * np.eye(d)
    chol = np.linalg.cholesky(cov)
    return Discriminant(mean, np.stack([inverse_lower(c) for c in chol]), 2 * np.log(np.einsum("cii->ci", chol)).sum(1), np.log(n / n.sum()))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs: score near 1 where label 1 is likelier.

    An empty or null text has an ordinary text's vector and is scored like any other; tables of no rows give no rows; rows
    that repeat an id are scored one by one. Only id and text are read, so other columns cannot clash.
    """
    stats = durable(document_statistics(docs, id_col, text_col))
    model = fit(stats, labels)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, len(FEATURES)))
            score = np.full(len(b), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
