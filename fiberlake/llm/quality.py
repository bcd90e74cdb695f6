"""Quality classifier: Bradley-Terry pairwise ranking.

A document's latent score is linear in features of its whole text. Preference pairs (a document labelled 1 over one
labelled 0) are fitted by logistic loss on feature differences, so no intercept is learnt; the threshold is the quantile
of the training scores that separates the classes best, and the score returned is a logistic of the distance to it,
fixed so that the threshold maps to 0.7.

Features are shares of byte classes, of neighbouring classes, of repeated words, and word lengths: language, source and
ids are no inputs. Null counts as empty text. Labels other than 0 and 1 and labels without documents are left out;
without labels of both classes every score is 0.5. The fit uses at most SAMPLE labelled rows of each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm import tokens
from fiberlake.llm.labelled import sample
from fiberlake.llm.linear import best_cut, bradley_terry, sigmoid

SAMPLE, PAIRS, THRESHOLD = 4_000, 20_000, 0.7


def _classes() -> np.ndarray:
    """Byte class: blank, newline, a-z, A-Z, digit, each common kind of sign, other sign, beyond ASCII, control."""
    kinds = {" \t\x0b\x0c\r": 0, "\n": 1, "abcdefghijklmnopqrstuvwxyz": 2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 3, "0123456789": 4, ".,": 5, ";:?'\"()-": 6, "!": 7, "|": 8, "#$%&*": 9, "<>{}[]/\\=_+~^@`": 10}
    out = np.full(256, 12, np.uint8)
    out[128:] = 11
    for chars, k in kinds.items():
        out[list(chars.encode())] = k
    return out


CLASSES, KINDS = _classes(), 13


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text."""
    out = np.zeros((len(texts), KINDS + KINDS * KINDS + 8))
    ends = tokens.separators(False)
    for lo, hi in tokens.slices(texts):
        hashes, counts, _ = tokens.words(texts[lo:hi], ends)
        at = 0
        for i, c in zip(range(lo, hi), counts):
            h = hashes[at : at + c]
            at += c
            if not texts[i]:
                continue
            kind = CLASSES[np.frombuffer(texts[i], np.uint8)].astype(np.int64)
            n = len(kind)
            out[i, :KINDS] = np.bincount(kind, minlength=KINDS) / n
            if n > 1:
                out[i, KINDS : KINDS + KINDS * KINDS] = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS) / (n - 1)
            rest = out[i, KINDS + KINDS * KINDS :]
            rest[0] = np.log1p(n) / 10
            if c:
                rest[1] = n / c / 20
                rest[2] = len(np.unique(h)) / c
                for j in (1, 2, 3):
                    rest[2 + j] = (h[j:] == h[:-j]).mean() if c > j else 0
                rest[6] = np.log1p(c) / 10
            rest[7] = 1
    return out


class Model:
    def __init__(self, mean, scale, weights, threshold, slope):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def score(self, x: np.ndarray) -> np.ndarray:
        latent = ((x - self.mean) / self.scale) @ self.weights
        return sigmoid(self.slope * (latent - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD)))


def fit(x: np.ndarray, y: np.ndarray) -> Model | None:
    if len(np.unique(y)) < 2:
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / scale
    w = bradley_terry(z, y, PAIRS)
    s = z @ w
    return Model(mean, scale, w, best_cut(s, y), 4 / max(1e-6, s.std()))


def train(documents: DataFrame, labels: DataFrame, training: Column, most: int = SAMPLE) -> Model | None:

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [r.astype(np.float32).tobytes() for r in features(tokens.as_bytes(pdf["text"]))], "y": pdf["y"].array})

    rows = sample(documents, labels, "quality", training, most).mapInPandas(run, "x binary, y int").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.x)))
    if not rows:
        return None
    return fit(np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float64), np.array([r.y for r in rows]))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """document (a struct of the documents' columns) and score double."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(features(tokens.as_bytes(texts))))

    return documents.select(F.struct("*").alias("document"), scored("text").alias("score"))
