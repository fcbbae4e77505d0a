from __future__ import annotations

import hashlib
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cartloom.llm import piecebpe, tokenfile
from cartloom.llm.bytebpe import ByteBpe
from cartloom.llm.common import new_path, tokenizer_file

MODEL, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    return piecebpe.PieceBpe(MODEL, limit=200)


def test_ids_equal_the_library(pieces, texts):
    for _, t in texts:
        ids = list(array("I", pieces.ids(t)))
        assert ids == pieces.library.encode(t), repr(t[:80])
        assert pieces.decode(ids) == pieces.library.decode(ids)


def test_ids_of_random_texts(pieces):
    parts = [" ", "  ", "\n", "a", "B", "é", "the", "ing", "1", "_", "▁", "<s>", "　", "😀", "     ", "\x00", "aaaa", "日本", "<0x0A>"]
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert list(array("I", pieces.ids(t))) == pieces.library.encode(t), repr(t)


def test_ids_of_random_words(pieces):
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice("aeiourstlnmdh") for _ in range(r.randint(1, 30)))
        assert list(array("I", pieces.ids(t))) == pieces.library.encode(t), t


def test_digests(docs, texts, nothing, pieces):
    expected = []
    for key, t in texts:
        ids = pieces.library.encode(t)
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((key, len(ids), sha, hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest()))
    got = piecebpe.digests(docs.select("doc_id", "text"), MODEL).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert piecebpe.encode(docs.withColumnRenamed("n_chars", "ids"), MODEL).columns == ["doc_id", "lang", "source", "ids", "decoded"]
    assert piecebpe.digests(nothing, MODEL).count() == 0


@pytest.mark.parametrize("n,top,block", [(0, 5, 64), (1, 5, 64), (5000, 50000, 256), (3000, 1 << 30, 100), (4096, 3, 2048)])
def test_chunks_round_trip(n, top, block):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    chunk = tokenfile.write_chunk([7, 9], [n // 2, n - n // 2], ids, block)
    keys, lengths, back = tokenfile.read_chunk(chunk)
    assert keys == [7, 9] and lengths == [n // 2, n - n // 2] and (back == ids).all()


def test_repeating_ids_take_few_bits():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 50), 200).astype("<u4")
    assert len(tokenfile.write_chunk([1], [len(ids)], ids)) * 8 / len(ids) < 2


def skewed(n: int, seed: int) -> np.ndarray:
    """Ids of unequal shares, a tenth of which follow the one before by rule."""
    r = np.random.default_rng(seed)
    ids = np.minimum(r.zipf(1.3, n), 50000)
    ids[9::10] = ids[8::10][: len(ids[9::10])] * 7 % 50001
    return ids.astype("<u4")


@pytest.mark.parametrize("block", [1, 37, 65536])
def test_blocks_of_any_length(block):
    ids = skewed(300 if block == 1 else 20000, 3)
    ids[-len(ids) // 3 :] = 9
    assert (tokenfile.read_chunk(tokenfile.write_chunk([1], [len(ids)], ids, block))[2] == ids).all()


def test_blocks_beyond_those_coded_at_once(monkeypatch):
    ids = skewed(10000, 4)
    monkeypatch.setattr(tokenfile, "ABREAST", 1)
    chunk = tokenfile.write_chunk([1], [len(ids)], ids)
    assert (tokenfile.read_chunk(chunk)[2] == ids).all()
    assert (tokenfile.read_chunk(chunk, [4, 1])[2] == np.concatenate((ids[8192:], ids[2048:4096]))).all()


def test_below_order_0_and_a_general_compressor():
    """On the whole texts of a table, against the entropy of their ids and zlib of the same blocks."""
    bpe = ByteBpe(BYTES)
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])
    ids = np.frombuffer(b"".join(bpe.ids(t.as_py() or "") + bytes(4) for t in table["text"]), "<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = 8 * len(tokenfile.write_chunk([1], [len(ids)], ids)) / len(ids)
    blocks = range(0, len(ids), tokenfile.BLOCK)
    general = 8 * sum(len(zlib.compress(ids[i : i + tokenfile.BLOCK].astype("<u2").tobytes(), 9)) for i in blocks) / len(ids)
    assert ids.max() < 1 << 16 and bits < 0.95 * -(share * np.log2(share)).sum() and bits < 0.8 * general


def test_tables_round_alike_everywhere():
    """No entry is so near to a half that another machine's logarithm could round it otherwise."""
    p = np.arange(4096) + 0.5
    for x in (256 * np.log(p / (4096 - p)), tokenfile._ONE / (1 + np.exp(-np.arange(-2400, 2401) / 256))):
        assert np.abs(np.abs(x - np.floor(x)) - 0.5).min() > 1e-8


def test_null_keys(spark):
    assert tokenfile.read_chunk(tokenfile.write_chunk([None, 3], [1, 1], np.array([5, 6], "<u4")))[0] == [None, 3]
    table = spark.createDataFrame([(None, "a b"), (4, None), (-1, "c"), (None, "d")], "doc_id long, text string")
    got = tokenfile.round_trip(table, BYTES, 0).collect()
    assert sorted((r.doc_id for r in got), key=lambda k: (k is not None, k)) == [None, None, -1, 4]
    assert sorted(r.start for r in got)[0] == 0 and {r.start for r in got if r.doc_id is None} < {0, 2, 3}


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(2).integers(0, 50000, 1000).astype("<u4")
    chunk = tokenfile.write_chunk([1], [1000], ids, 100)
    assert (tokenfile.read_chunk(chunk, [3, 9])[2] == np.concatenate((ids[300:400], ids[900:]))).all()
    hurt = bytearray(chunk)
    hurt[-20] ^= 4
    assert (tokenfile.read_chunk(bytes(hurt), [0])[2] == ids[:100]).all()
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.read_chunk(bytes(hurt))
    with pytest.raises(ValueError, match="not a chunk"):
        tokenfile.read_chunk(b"XXXX" + chunk[4:])


def test_many_texts_equal_the_library(texts):
    parts = [" ", " ", "  ", "\n", "\u3000", "the", "Ing", "é", "a.", "x's", "12", "***", "<|endoftext|>", "日本", "😀", "!?\nb,", "_", "\x00"]
    r = random.Random(7)
    whole = [t for _, t in texts] + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    bpe = ByteBpe(BYTES, limit=5)
    for lo in range(0, len(whole), 700):
        some = whole[lo : lo + 700]
        ids, sizes = bpe.many(pa.array(some), 77)
        assert len(sizes) == len(some) and sizes.sum() == len(ids)
        for t, part in zip(some, np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == [*bpe.tokenizer.encode(t, add_special_tokens=False).ids, 77], repr(t[:80])
    assert [len(x) for x in bpe.many(pa.array([], pa.string()), 0)] == [0, 0]


def test_words_are_encoded_once(monkeypatch):
    """Whatever punctuation follows them, in whatever batch; a word in use outlives a full cache."""
    bpe, seen = ByteBpe(BYTES, limit=60), []
    plain = bpe._encoded
    monkeypatch.setattr(bpe, "_encoded", lambda token: seen.append(token) or plain(token))
    for i in range(30):
        bpe.many(pa.array([f"so river river. river, river!!\nriver {chr(97 + i % 26) * (i + 3)}"]), 0)
    assert seen.count("Ġriver") == 1 and seen.count("river") == 1


@pytest.mark.parametrize("kind", ["one", "rare", "rising", "noise"])
def test_extreme_ids_round_trip(kind):
    r = np.random.default_rng(5)
    ids = {
        "one": np.full(70000, 3),
        "rare": np.where(r.random(70000) < 0.0005, r.integers(0, 50000, 70000), 9),
        "rising": np.arange(70000),
        "noise": r.integers(0, 1 << 32, 70000),
    }[kind].astype("<u4")
    assert (tokenfile.read_chunk(tokenfile.write_chunk([1], [len(ids)], ids, 512))[2] == ids).all()


def test_files(spark, docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(tokenfile, "CHUNK", 1000)
    bpe, at, expected = ByteBpe(BYTES), 0, []
    for key, t in sorted(texts, key=lambda r: r[0]):
        ids = bpe.ids(t) + bytes(4)
        expected.append((key, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = tokenfile.round_trip(docs, BYTES, 0).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == expected
    assert tokenfile.round_trip(nothing, BYTES, 0).count() == 0
    target = new_path(spark, "files")
    tokenfile.write(docs, BYTES, target, 0)
    assert spark.read.parquet(target).agg({"n_ids": "sum"}).first()[0] == at
