from __future__ import annotations

import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.llm import packing
from cartloom.llm.bytebpe import ByteBpe
from cartloom.llm.common import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(PATH, limit=50)  # small, so that the cache empties often


def test_ids_equal_the_library(bpe, texts):
    for _, t in texts:
        assert list(array("I", bpe.ids(t))) == bpe.tokenizer.encode(t, add_special_tokens=False).ids


def test_ids_of_random_texts(bpe):
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "'", "1", "²", "_", "!", "\x1c", "　", "<|endoftext|>", "😀", "\r\n", "don't", "\x85", ".\nNew", "\nx"]
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert list(array("I", bpe.ids(t))) == bpe.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def places(table):
    out = {}
    for length, first, count, sequence, each, offset in table.itertuples(index=False):
        for i in range(count):
            out[length, first + i] = (sequence + i // each, offset + i % each * length)
    return out


@pytest.mark.parametrize("capacity,top,n", [(1024, 1024, 4000), (30, 30, 500), (10, 10, 40), (7, 7, 1), (100, 34, 300)])
def test_plan_is_whole_and_gapless(capacity, top, n):
    r = random.Random(capacity)
    histogram = {}
    for _ in range(n):
        length = min(top, max(1, int(r.lognormvariate(np.log(top / 4), 1))))
        histogram[length] = histogram.get(length, 0) + 1
    got = places(packing.plan(histogram, capacity))
    assert set(got) == {(k, i) for k, c in histogram.items() for i in range(c)}
    sequences = {}
    for (length, _), (s, offset) in got.items():
        sequences.setdefault(s, []).append((offset, length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    bound = -(-sum(k * c for k, c in histogram.items()) // capacity)
    assert len(sequences) <= max(1.1 * bound, bound + 3)


def test_configurations_reach_the_optimum():
    found = packing.configurations([6, 4, 3], [10, 10, 20], 10)
    assert sum(x for _, x in found) == pytest.approx(10 + 20 / 3, abs=1e-6)


def test_pack_documents(docs, texts, bpe):
    rows = packing.pack_documents(docs, PATH, 2, 64).collect()
    expected = []
    for key, t in texts:
        ids = [*array("I", bpe.ids(t)), 2]
        first = len(ids) % 64 or 64
        bounds = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected.append((key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64


def test_sequences_hold_the_ids(docs):
    pieces = packing.cut(docs.withColumn("piece", F.lit("clash")), PATH, 2, 256)
    assert {"lang", "source", "n_chars"} <= set(pieces.columns)
    packed = packing.pack(packing.staged(pieces, "test"), 256, ["doc_id", "piece"], rows_per_salt=3)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_empty(nothing):
    assert packing.pack_documents(nothing, PATH, 2, 64).count() == 0


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> int:
    """Sequences of the textbook rule: longest first, each to the fullest sequence it fits."""
    from bisect import bisect_left, insort

    rooms: list[int] = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            at = bisect_left(rooms, n)
            room = rooms.pop(at) if at < len(rooms) else capacity
            insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_never_worse_than_best_fit_decreasing(seed):
    r = random.Random(seed)
    top = r.choice([64, 128, 1024])
    low = r.choice([1, top // 5, top // 3])
    histogram = {n: r.randint(1, 30) for n in r.sample(range(max(1, low), top + 1), r.randint(1, top - low))}
    table = packing.best_plan(histogram, top)
    used = set()
    for row in table.itertuples():
        used |= set(range(row.sequence, row.sequence + row.count // row.each))
    assert len(used) <= best_fit_decreasing(histogram, top)


def test_digests_equal_the_ids(docs):
    whole = packing.cut(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), 2, 64)
    thin = packing.cut(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), 2, 64, digest=True)
    expected = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in whole.collect()]
    assert sorted(map(tuple, thin.collect())) == sorted(expected)
