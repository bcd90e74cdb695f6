"""Quality features and scores recomputed character by character, and Bradley-Terry held against its own gradient."""

import math
from collections import Counter

import numpy as np
import pytest

from fiberlake.llm import labelled, linear, quality
from tests.llm import brute


def kind(b):
    c = chr(b)
    groups = [" \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", ";:?'\"()-", "!", "|", "#$%&*", "<>{}[]/\\=_+~^@`"]
    return 11 if b >= 128 else next((k for k, g in enumerate(groups) if c in g), 12)


def plain_features(text):
    raw = (text or "").encode()
    kinds, words = [kind(b) for b in raw], brute.WORD.findall((text or "").translate(brute.LOWER))
    out = [0.0] * (13 + 169 + 8)
    if not raw:
        return out
    for k, c in Counter(kinds).items():
        out[k] = c / len(raw)
    for (a, b), c in Counter(zip(kinds, kinds[1:])).items():
        out[13 + 13 * a + b] = c / (len(raw) - 1)
    n = len(words)
    rest = [math.log1p(len(raw)) / 10, 0, 0, 0, 0, 0, 0, 1]
    if n:
        rest[1:3] = [len(raw) / n / 20, len(set(words)) / n]
        rest[3:6] = [sum(words[i] == words[i + j] for i in range(n - j)) / (n - j) if n > j else 0 for j in (1, 2, 3)]
        rest[6] = math.log1p(n) / 10
    return out[:182] + rest


@pytest.mark.parametrize("text", ["", " ", "a", "A a a A", "É, 3%!\n|x| (y)\x00", "w " * 50 + "\tend"])
def test_features_of_odd_texts(text):
    assert np.allclose(quality.features([text.encode()])[0], plain_features(text), atol=1e-12)


def test_scores_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"), ~labelled.held_out(4, 2))
    for r in quality.score(docs, model).collect():
        z = (np.array(plain_features(r.document.text)) - model.mean) / model.scale
        want = 1 / (1 + math.exp(-max(-40, min(40, model.slope * (float(z @ model.weights) - model.threshold) + math.log(0.7 / 0.3)))))
        assert r.score == pytest.approx(want, abs=1e-9)


def test_bradley_terry_learns_the_better_side():
    """Preference follows one feature of three; the weights order unseen pairs, and exchanging the labels turns them round."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 1] + 0.1 * rng.normal(size=600) > 0).astype(int)
    w = linear.bradley_terry(x, y, 5_000)
    assert w[1] > 3 * max(abs(w[0]), abs(w[2]))
    fresh = rng.normal(size=(400, 3))
    better = fresh[:200, 1] > fresh[200:, 1]
    assert (((fresh[:200] - fresh[200:]) @ w > 0) == better).mean() > 0.95
    assert linear.bradley_terry(x, 1 - y, 5_000)[1] < 0
