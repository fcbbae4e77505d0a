from __future__ import annotations

import hashlib
import random
import string

import pytest
import xxhash

from cartloom.llm import components, exactdedup, simhash, substringdedup
from tests.llm.conftest import SCHEMA, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_exact(docs, texts):
    groups = {}
    for key, t in texts:
        groups.setdefault(t.translate(LOWER), []).append(key)
    expected = sorted(
        (k, max(g), len(g), k == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g
    )
    got = exactdedup.duplicates(docs, bucket_rows=1)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == expected


def test_exact_without_broadcast(docs, nothing, monkeypatch):
    first = sorted(map(tuple, exactdedup.duplicates(docs).collect()))
    monkeypatch.setattr(exactdedup, "BROADCAST_HASHES", 0)
    assert sorted(map(tuple, exactdedup.duplicates(docs).collect())) == first
    assert exactdedup.duplicates(nothing).count() == 0


def test_null_keys(spark):
    got = exactdedup.duplicates(spark.createDataFrame([(None, "a"), (3, "A"), (None, "b")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got.collect()) == [(0, 0, 1, True), (0, 3, 2, False), (3, 3, 2, True)]


def test_directory_doubles_only_where_overfull():
    assert exactdedup.build_directory({0: 3}, 5, 4) == [0]
    assert exactdedup.build_directory({0: 4, 8: 4}, 5, 4) == [0, 1]
    # the first eighth is overfull, the second half never splits
    assert exactdedup.build_directory({0: 4, 1: 3, 12: 2}, 5, 4) == [0, 1] + [2] * 2 + [3] * 4 + [4] * 8
    deep = exactdedup.build_directory({5: 100}, 5, 4)
    assert len(deep) == 16 and deep == sorted(deep)


def plain_simhash(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(keys, linked):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(docs, texts, nothing):
    prints = {k: plain_simhash(t) for k, t in texts}
    expected = groups_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{p:016x}", expected[k]) for k, p in prints.items()}
    assert expected[2] == expected[1]  # empty texts link
    assert simhash.near_duplicates(nothing).count() == 0


def clusters(seed: int, n: int) -> list[int]:
    r, out = random.Random(seed), set()
    bases = [r.getrandbits(64) for _ in range(n // 8 + 1)]
    while len(out) < n:
        x = r.choice(bases)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count() <= 3


@pytest.mark.parametrize("n", [6, 60, 900])
def test_leaf_search(n):
    fps = clusters(n, n)
    own, guests = fps[: n * 2 // 3], fps[n * 2 // 3 :]
    mine = set(own)
    expected = groups_of(fps, lambda a, b: (a in mine or b in mine) and near(a, b))
    found = simhash.leaf_links(own, guests)
    got = groups_of(fps, lambda a, b, s=set(found): (a, b) in s or (b, a) in s)
    assert got == expected


@pytest.mark.parametrize("leaf", [2, 20])
def test_trees_split_over_jobs(spark, leaf):
    fps = clusters(9, 300)
    same = (fps[0] & 0xFFFF) | 1 << 40
    fps = sorted({*fps, *[same ^ (i << 20) for i in range(60)]})  # one root with many members
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), leaf)
    found = {r.v: r.root for r in components.components(links).collect()}
    expected = groups_of(fps, near)
    assert {f: found.get(f, f) for f in fps} == expected


def test_components_of_a_long_chain(spark):
    r = random.Random(1)
    order = list(range(60))
    r.shuffle(order)
    links = list(zip(order, order[1:])) + [(100, 101), (200, 200)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.v: x.root for x in got} == {**{i: 0 for i in range(60)}, 100: 100, 101: 100, 200: 200}


def plain_removal(texts: list[bytes], length: int):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)


def check_removal(spark, rows, **options):
    length = options.get("length", 400)
    got = substringdedup.remove(spark.createDataFrame(rows, SCHEMA), **options).collect()
    expected = plain_removal([(r[1] or "").encode() for r in rows], length)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        (row[0], *e) for row, e in zip(rows, expected)
    )


def test_substrings(spark, nothing):
    from tests.llm.conftest import rows_of_documents

    check_removal(spark, rows_of_documents())
    assert substringdedup.remove(nothing).count() == 0
    passage = prose(77, 100)
    odd = [(None, passage, None, None, None)] * 2 + [(5, prose(78, 30) + passage + prose(79, 30), None, None, None)]
    kept = {r.doc_id: r.n_removed for r in substringdedup.remove(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert kept[5] == len(passage) and kept[None] == len(passage)


@pytest.mark.parametrize("most", [1, 8192])
def test_substrings_with_small_alphabet(spark, most):
    r = random.Random(6)
    passage = "".join(r.choice("ab") for _ in range(500))
    rows = []
    for i in range(40):
        own = "".join(r.choice("abé") for _ in range(r.randint(0, 300)))
        cut = r.randint(0, 300)
        middle = list(passage[cut : cut + r.randint(0, 400)])
        if middle and i % 3 == 0:
            middle[r.randrange(len(middle))] = "X"
        rows.append((i, own + "".join(middle) + own[::-1], None, None, None))
    rows += [(90, "ab" * 400, None, None, None), (91, "q" * 300, None, None, None), (92, prose(5, 60) * 2, None, None, None)]
    check_removal(spark, rows, length=128, most=most)


def test_pieces_of_a_long_text(monkeypatch):
    r = random.Random(8)
    body = bytes(r.choice(b"abc") for _ in range(5000))
    whole = [(a, lo, hi, k) for _, a, lo, hi, k, _ in substringdedup.anchors([body], 128)]
    monkeypatch.setattr(substringdedup, "CHUNK", 700)
    pieces = [(a, lo, hi, k) for _, a, lo, hi, k, _ in substringdedup.anchors([body, body], 128)]
    starts = {s: (a, k) for a, lo, hi, k in whole for s in range(lo, hi + 1)}
    for part in (pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :]):
        assert {s: (a, k) for a, lo, hi, k in part for s in range(lo, hi + 1)} == starts
