"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is seen in two views: its lower-cased words, and the form of each word (length, letters, digits,
marks, whether it repeats the word before). One-, two- and three-word runs of either view are hashed into
2**bits weights. A view's value of a run is its share among the view's runs of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.words import U64, Words, raw_bytes, salted

BITS = 18
RUNS = (("word", 1), ("word", 2), ("form", 1), ("form", 2), ("form", 3))
SCALE = 8.0
LETTER, DIGIT, UPPER, OTHER = 1, 2, 4, 8
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(97, 123), *range(128, 256)]] = LETTER
KIND[[*range(65, 91)]] = LETTER | UPPER
KIND[[*range(48, 58)]] = DIGIT


def _joined(h: np.ndarray, k: int) -> np.ndarray:
    out = h
    for step in range(1, k):
        out = salted(out[:-1] * U64(3) + h[step:], step)
    return out


def features(texts: pa.Array | pa.ChunkedArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight places, values and the text of each run of all texts; texts without words have none."""
    words = Words(texts, fold=True)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    surface = words.hashes()
    raw, _ = raw_bytes(texts)
    kinds = np.bitwise_or.reduceat(KIND[raw], np.c_[words.starts, words.ends].ravel()[:-1])[::2]
    last = raw[words.ends - 1]
    mark = np.where(KIND[last] == OTHER, last, 0).astype(np.uint64)
    size = np.minimum(words.ends - words.starts, 24).astype(np.uint64)
    owner = words.text_of_word()
    again = np.zeros(n, np.uint64)
    again[1:] = (surface[1:] == surface[:-1]) & (owner[1:] == owner[:-1])
    form = kinds.astype(np.uint64) | (mark << U64(8)) | ((size // U64(3)) << U64(16)) | (again << U64(24))
    view = {"word": surface, "form": salted(form, 77)}
    places, values, owners = [], [], []
    for salt, (name, k) in enumerate(RUNS):
        if n < k:
            continue
        h = salted(_joined(view[name], k), 100 + salt)
        inside = owner[: n - k + 1] == owner[k - 1 :]
        of = owner[: n - k + 1][inside]
        runs = np.maximum(1, words.counts - k + 1)
        places.append((h[inside] >> U64(64 - bits)).astype(np.int64))
        values.append(SCALE / runs[of])
        owners.append(of)
    return np.concatenate(places), np.concatenate(values), np.concatenate(owners)


@dataclass
class QualityModel:
    """weights of 2**bits places; bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        places, values, owner = features(texts, self.bits)
        z = self.bias + np.bincount(owner, self.weights[places] * values, minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Follow the regularised leader over the rows in order, `epochs` times; weights and bias."""
    rows = []
    for first in range(0, len(texts), 128):
        part = texts.slice(first, 128)
        places, values, owner = features(part, bits)
        order = np.argsort(owner, kind="stable")
        places, values = places[order], values[order]
        ends = np.searchsorted(owner[order], np.arange(len(part) + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            at, inverse = np.unique(places[a:b], return_inverse=True)
            rows.append((at.astype(np.int32), np.bincount(inverse, values[a:b], minlength=len(at)).astype(np.float32)))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def lead(at: np.ndarray) -> np.ndarray:
        held = z[at]
        return np.where(np.abs(held) > l1, -(held - np.sign(held) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    bias = 1 << bits
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = lead(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = lead(np.arange(bias + 1))
    return w[:bias], float(w[bias])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 12_000,
    learners: int = 8,
    bits: int = BITS,
) -> QualityModel:
    """Fit on at most `sample` labelled documents, those with the smallest md5 of their id.

    The sample is dealt over `learners` tasks; each follows its own leader and the weights are averaged. What
    reaches the driver is `learners` weight vectors of 2**bits places, whatever the size of the tables.
    Rows with a null id or label are left out. Without labelled rows all weights are 0 and scores 0.5.
    """
    turn = F.md5(F.col("id").cast("string"))
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    picked = named.orderBy(turn, "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    texts = texts.withColumn("learner", F.pmod(F.crc32(turn), F.lit(learners)).cast("int")).withColumn("turn", turn)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "text"], kind="stable", na_position="first")
        w, bias = fit(pa.array(pdf["text"], pa.string(), from_pandas=True), pdf["y"].to_numpy(), bits)
        return pd.DataFrame({"rows": [len(pdf)], "bias": [bias], "weights": [w.astype(np.float32).tobytes()]})

    found = texts.groupBy("learner").applyInPandas(learn, "rows long, bias double, weights binary").collect()
    if not found:
        return QualityModel(np.zeros(1 << bits), 0.0, bits)
    found.sort(key=lambda r: (r["rows"], r["bias"]))
    share = np.array([r["rows"] for r in found], float)
    share /= share.sum()
    weights = sum(s * np.frombuffer(r["weights"], np.float32) for s, r in zip(share, found))
    return QualityModel(weights.astype(np.float32), float(share @ [r["bias"] for r in found]), bits)


def with_score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score", piece: int = 2 << 20) -> DataFrame:
    """The documents with one more column `out`: the probability of label 1, for null and empty texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts):
        _, offsets = raw_bytes(texts)
        parts, at = [np.zeros(0)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
            parts.append(shared.value.scores(texts.slice(at, to - at)))
            at = to
        return pa.array(np.concatenate(parts))

    return docs.withColumn(out, score(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
