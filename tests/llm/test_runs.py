from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cartloom.llm import queries, runs
from tests.llm.conftest import SCHEMA, prose


def plain_runs(words: list[str], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Every period tried at every place."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s < max(least, times * q):
                continue
            if not any(all(words[x] == words[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text: str | None) -> tuple:
    """The contract's row, step by step."""
    words = [w for w in runs.WORD.findall(text or "")]
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    return (
        key,
        len(found),
        *(top or (None, None, None)),
        1000 * top[1] // top[2] if top else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def made_words(r: random.Random) -> list[str]:
    letters, out = r.choice([1, 2, 3, 20]), []
    for _ in range(r.randint(0, 6)):
        part = [chr(97 + r.randrange(letters)) for _ in range(r.randint(1, 12))]
        out += (part * r.randint(1, 30))[: r.randint(1, 150)] if r.random() < 0.5 else part
    return out


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(80):
        texts = [made_words(r) for _ in range(r.randint(1, 6))]
        for words, found in zip(texts, runs.find_runs(texts)):
            assert found == plain_runs(words)


def test_other_bounds():
    r = random.Random(2)
    for _ in range(60):
        words = made_words(r)
        assert runs.find_runs([words], least=6, times=2) == [plain_runs(words, 6, 2)]


def test_suffix_array_and_lcp():
    r = random.Random(3)
    words = np.array([r.randrange(2) + 1 for _ in range(300)] + [0])
    levels = runs.suffix_ranks(words)
    order = np.argsort(levels[-1], kind="stable")
    suffixes = [tuple(words[i:]) for i in range(len(words))]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    for k, shared in enumerate(runs.lcp_table(levels, order)[1:], 1):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert shared == next((x for x, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def test_tandems_are_squares_that_end_their_runs():
    words = np.array([1, 2, 1, 2, 1, 3, 3, 3, 0])
    levels = runs.suffix_ranks(words)
    order = np.argsort(levels[-1], kind="stable")
    starts, periods = runs.branching_tandems(words, order, runs.lcp_table(levels, order))
    assert sorted(zip(starts.tolist(), periods.tolist())) == [(1, 2), (6, 1)]


def test_long_text_of_one_word():
    assert runs.find_runs([["x"] * 100_000, [], ["y"] * 23]) == [[(0, 100_000, 1)], [], []]


def test_query_equals_plain_code(spark, docs, texts, nothing, tmp_path):
    r = random.Random(5)
    rows = [(i, " \n".join(made_words(r)), "en", "a", 1) for i in range(100, 180)]
    rows += [(None, "a b " * 40, None, None, None), (7777, prose(1, 30) + " é" * 50 + "\tz", None, "a", None)]
    table = docs.union(spark.createDataFrame(rows, SCHEMA))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    expected = [plain_row(k, t) for k, t, *_ in map(tuple, table.collect())]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert sum(x[1] for x in expected) > 20
    assert runs.digests(nothing).count() == 0


def test_interface(spark, docs):
    clash = docs.withColumnRenamed("n_chars", "runs").withColumn("collapsed", F.lit(1))
    out = runs.periodic_runs(clash)
    assert out.columns == ["doc_id", "lang", "source", "n_words", "n_runs", "runs", "collapsed"]
    table = spark.createDataFrame([(1, "b " + "a c " * 30 + "d")], "doc_id long, text string")
    row = runs.periodic_runs(table).first()
    assert (row.n_words, row.n_runs, row.collapsed) == (62, 1, "b a c d")
    assert tuple(row.runs[0]) == (1, 60, 2)
