from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from cartloom.operators import text as TX
from tests.conftest import keyed

NAMES = [
    (1, "Red apple, red Apple"),
    (2, "The green apple"),
    (3, None),
    (4, "Crème brûlée x 2 of the best_of"),
    (5, "red bread and butter"),
    (6, "bread butter butter"),
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "product_id int, product_name string")


def brute(max_terms):
    words = {
        1: ["red", "apple", "red", "apple"],
        2: ["green", "apple"],
        3: [],
        4: ["crème", "brûlée", "best_of"],
        5: ["red", "bread", "butter"],
        6: ["bread", "butter", "butter"],
    }
    totals = Counter(w for ws in words.values() for w in ws)
    vocabulary = sorted(sorted(totals, key=lambda w: (-totals[w], w))[:max_terms])
    df = {w: sum(w in ws for ws in words.values()) for w in vocabulary}
    matrix = np.zeros((len(words), len(vocabulary)))
    for i, ws in enumerate(words.values()):
        for j, w in enumerate(vocabulary):
            matrix[i, j] = ws.count(w) * (math.log((1 + len(words)) / (1 + df[w])) + 1)
        norm = np.linalg.norm(matrix[i])
        matrix[i] /= norm if norm else 1.0
    return vocabulary, matrix


@pytest.mark.parametrize("max_terms", [3, 1000])
def test_tfidf(names, max_terms):
    vocabulary, matrix = brute(max_terms)
    got = {k: r["weight"] for k, r in keyed(TX.tfidf(names, max_terms=max_terms), "product_id", "term").items()}
    want = {
        (i + 1, w): matrix[i, j] for i in range(6) for j, w in enumerate(vocabulary) if matrix[i, j]
    }
    assert got == pytest.approx(want)


def test_svd_matches_a_dense_one(names):
    _, matrix = brute(1000)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    got = keyed(TX.text_features(names, n_components=3), "product_id")
    ours = np.array([[got[i][f"text_svd_{c}"] for c in range(3)] for i in range(1, 7)])
    theirs = u[:, :3] * s[:3]
    for c in range(3):
        big = np.abs(vt[c]).argmax()
        assert ours[:, c] == pytest.approx(theirs[:, c] * np.sign(vt[c][big]), abs=1e-8)


def test_too_many_components(names):
    with pytest.raises(ValueError):
        TX.text_features(names, n_components=50)


def test_words_only_from_stop_list(spark):
    df = spark.createDataFrame([(1, "the of and")], "product_id int, product_name string")
    with pytest.raises(ValueError):
        TX.tfidf(df).count()
