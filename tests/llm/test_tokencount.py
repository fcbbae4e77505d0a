from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartloom.llm import queries, tokencount
from cartloom.llm.common import tokenizer_file
from cartloom.llm.piecebpe import SPACE
from tests.llm.conftest import SCHEMA

MODEL = tokenizer_file("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "a", "B", "é", "the", "ing", "1", "_", "▁", "<s>", "　", "😀", " " * 17, "\x00", "aaaa", "日本", "<0x0A>"]


@pytest.fixture(scope="module")
def machine():
    return tokencount.Transducer(MODEL, limit=2000)


def made_texts(seed: int, n: int):
    r = random.Random(seed)
    for k in range(n):
        letters = [PARTS, list("aeiourstlnmdh"), list("ae "), ["x"], [" "], list("0123")][k % 6]
        yield "".join(r.choice(letters) for _ in range(r.randint(0, 40)))


def test_counts_equal_the_library(machine, texts):
    library = machine.vocabulary.library
    for text in [t for _, t in texts] + list(made_texts(1, 3000)):
        symbols = tokencount.symbols_of(text)
        n = len(library.encode(text))
        assert machine.read(machine.empty, symbols)[1] == n, repr(text)
        assert machine.run(machine.states[machine.empty], symbols)[1] == n, repr(text)


def test_every_prefix_is_counted(machine):
    text = "The naïve  reader's rationale,   unbelievably 日本 tokenization 😀ing   "
    at, total = machine.empty, 0
    for k, symbol in enumerate(tokencount.symbols_of(text), 1):
        at, more = machine.read(at, symbol)
        total += more
        if k > 1:
            assert total == len(machine.vocabulary.library.encode(text[: k - 1])), text[: k - 1]


def test_pairs_by_their_rims_equal_merging(machine):
    r, piece = random.Random(3), machine.vocabulary
    ids = [i for i, t in piece.text.items() if i in machine.rims and SPACE not in t[1:]]
    for _ in range(20_000):
        a, b = r.choice(ids), r.choice(ids)
        if piece.text[b][0] != SPACE:
            merged = piece.merge(piece.text[a] + piece.text[b])
            assert machine._merged_apart(a, b) == (merged == [a, b]), (piece.text[a], piece.text[b])


def test_maps_compose(machine):
    """A text read in two chunks gives the states and counts of one."""
    r = random.Random(4)
    for text in made_texts(5, 600):
        symbols = tokencount.symbols_of(text)
        if symbols:
            k = r.randrange(len(symbols))
            whole = machine.run(machine.states[machine.empty], symbols)
            state, n = machine.run(machine.states[machine.empty], symbols[:k])
            state, more = machine.run(state, symbols[k:])
            assert (state, n + more) == whole


def test_scan_equals_going_through():
    r = random.Random(6)
    for _ in range(300):
        n, names = r.randint(1, 20), "abcd"
        maps = [{a: (r.choice(names), r.randint(-3, 9)) for a in names if r.random() < 0.9 or k == 0} for k in range(n)]
        expected, at, total = [], "a", 0
        for m in maps:
            if at is None or at not in m:
                at = None
            else:
                at, more = m[at]
                total += more
            expected.append(None if at is None else (at, total))
        assert tokencount.scan(maps, "a") == expected


def test_guesses_meet_the_state(machine):
    """From a space on the guess is certain and single."""
    before = "some words before " + "x" * 30
    states = machine.guesses(tokencount.symbols_of(before)[-40:])
    assert states == [machine.run(machine.states[machine.empty], tokencount.symbols_of(before))[0]]
    missed = 0
    for text in made_texts(7, 600):
        symbols = tokencount.symbols_of(text * 9)
        if len(symbols) > 70:
            true = machine.run(machine.states[machine.empty], symbols)[0]
            missed += true not in machine.guesses(symbols[-64:])
    assert missed < 60  # the rest is found by the scan


@pytest.mark.parametrize("chunk", [20, 64, 1000])
def test_long_texts(spark, docs, texts, machine, chunk):
    rows = [(k, t * 5, "en", "a", 1) for k, t in enumerate(made_texts(8, 60), 1000)]
    rows += [(2000, "x" * 5000, None, None, None), (2001, " " * 3000, None, None, None), (2002, "0123456789" * 300, None, None, None)]
    table = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = tokencount.token_counts(table.select("doc_id", "text"), MODEL, most=100, chunk=chunk)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = []
    for key, text, *_ in table.collect():
        n = len(machine.vocabulary.library.encode(text or ""))
        expected.append((key, len((text or "").encode()), n, n > 100))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_a_missed_guess_is_found_by_the_scan(machine):
    """Maps that hold no right state are filled one after the other."""
    r = random.Random(9)
    text = "".join(r.choice("aeiourstlnmdh ") for _ in range(90))
    maps = []
    symbols = tokencount.symbols_of(text)
    for lo in range(0, len(symbols), 30):
        entered = machine.states[machine.empty] if not lo else machine.spaces(1)
        left, n = machine.run(entered, symbols[lo : lo + 30])
        maps.append({repr(entered): (repr(left), n)})
    for _ in range(len(maps)):
        after = tokencount.scan(maps, repr(machine.states[machine.empty]))
        if None not in after:
            break
        k = after.index(None)
        state = tokencount._state(after[k - 1][0])
        left, n = machine.run(state, symbols[30 * k : 30 * k + 30])
        maps[k][repr(state)] = (repr(left), n)
    assert after[-1][1] == len(machine.vocabulary.library.encode(text))


def test_query(spark, docs, nothing, machine, tmp_path):
    rows = [(None, "null key", None, None, None), (2000, "word " * 9000, None, None, None)]
    table = docs.union(spark.createDataFrame(rows, SCHEMA))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_token_counts"](spark, str(tmp_path))
    expected = []
    for key, text, *_ in table.collect():
        n = len(machine.vocabulary.library.encode(text or ""))
        expected.append((key, len((text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    clash = docs.withColumnRenamed("n_chars", "n_tokens").withColumn("row", F.lit(1))
    assert tokencount.token_counts(clash, MODEL).columns == ["doc_id", "lang", "source", "row", "n_bytes", "n_tokens"]
    assert tokencount.token_counts(nothing, MODEL).count() == 0
