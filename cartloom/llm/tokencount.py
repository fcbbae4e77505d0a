"""Token counts by a compiled finite-state transducer.

The merges of a vocabulary define, for every text, how many tokens each of its prefixes has. A
deterministic transducer reads a text symbol by symbol and adds up the numbers on its
transitions; the sum is the number of tokens of what was read. A transition may
carry a negative number, since a symbol can merge tokens before it.

**States.** After some symbols a state holds the longest suffix of them that begins a token (a node of
the automaton over the vocabulary) and, for each place in that suffix at which a token may still begin,
the last token of the prefix up to there and its count relative to now. The next symbol ends one
of the tokens that begin at these places: the one that may stand next to the last token of its
prefix. Counts are relative and the suffix is no longer than a token, so the states are finite; they
and their transitions are compiled when a text first meets them and at most ``limit`` are kept.

**Spaces.** No piece holds a space after another symbol and the pieces of spaces have the worst score, so a
space after anything else leads to one and the same state, and a run of spaces is known by its length up
to the period of its counts. Both are checked when a vocabulary is compiled.

**Chunks.** A text is cut into chunks of symbols. A chunk's map takes the state it is entered in to
the state it is left in and the number of tokens between. Which states those are is read
from the symbols before the chunk: from a space they are certain; without one, a guess is made from each
place a token may begin at. Maps are composed by a parallel prefix scan (doubling) for each text. Where
a guess missed, the state that the scan arrived with is added to the map of that chunk, until no
map lacks one; so the result never rests on a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import staged
from cartloom.llm.piecebpe import SPACE, PieceBpe

#: Symbols of a chunk, and of what is read before one to guess its state.
CHUNK, BEFORE = 1 << 15, 64
#: Last tokens that stand for none: the start of a part, and symbols written as bytes.
START, BYTES = -2, -1

#: A state: the suffix; for each place in it (last token, count relative to now) or None; after spaces
#: also their number.
State = tuple


class Transducer:
    """Transitions of a SentencePiece BPE vocabulary with byte fallback, compiled when needed."""

    def __init__(self, path: str, limit: int = 300_000):
        self.vocabulary = PieceBpe(path)
        piece = self.vocabulary
        self.usable = {t: i for t, i in piece.id.items() if [i] == piece.merge(t)}
        self.begins = {t[:k] for t in self.usable for k in range(len(t))}
        self.longest = max(map(len, self.usable))
        self._check_spaces()
        self.rims = {i: self._rim(t) for t, i in self.usable.items()}
        self.pairs: dict[int, bool] = {}
        self.shapes: dict[str, tuple[int, list[int], list[tuple[int, int]]]] = {}
        self.limit = limit
        self.words: dict[str, tuple[int, int]] = {}
        self._clear()

    def _check_spaces(self) -> None:
        """The counts of runs of spaces and the period in which they repeat."""
        piece = self.vocabulary
        spaces = {t for t in piece.id if set(t) == {SPACE}}
        worst = min(piece.score.values())
        others = [t for t in piece.id if t not in spaces]
        if any(SPACE in t[1:] or piece.score[t] <= worst for t in others):
            raise ValueError("a piece holds a space after another symbol, or is worse than pieces of spaces")
        self.turn = max(map(len, spaces))
        counts = [len(piece.merge(SPACE * k)) for k in range(4 * self.turn + 1)]
        #: by run length: what its last space adds
        self.added = [0] + [b - a for a, b in zip(counts, counts[1:])]
        again = self.added[self.turn + 1 : 2 * self.turn + 1]
        if any(self.added[k : k + self.turn] != again for k in range(self.turn + 1, 3 * self.turn, self.turn)):
            raise ValueError("counts of spaces do not repeat")

    def _clear(self) -> None:
        self.numbers: dict[State, int] = {}
        self.states: list[State] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.words.clear()
        self.empty = self.number(("", ((START, 0),)))
        self.space = self.number(self.spaces(1))

    def number(self, state: State) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
        return at

    def spaces(self, k: int) -> State:
        """The state after ``k`` spaces; the last of them may still join what follows."""
        if k > 2 * self.turn:
            k = self.turn + 1 + (k - self.turn - 1) % self.turn
        return (SPACE, ((START, -self.added[k]), (self.usable[SPACE], 0)), k)

    def _rim(self, text: str) -> tuple[list, list] | None:
        """The first and the last symbol of ``text`` while it is merged, each with the cost of the merge
        that ends it; None if the costs do not rise, so that they don't tell the order."""
        cost, symbols = self.vocabulary.score, list(text)
        first, last, worst = [], [], -float("inf")
        while len(symbols) > 1:
            offers = [(-cost[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in cost]
            if not offers or min(offers)[0] < worst:
                return None
            worst, k = min(offers)
            if k == 0:
                first.append((symbols[0], worst))
            if k == len(symbols) - 2:
                last.append((symbols[-1], worst))
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        never = float("inf")
        return [*first, (text, never)], [*last, (text, never)]

    def _fits(self, before: int, token: int) -> bool:
        """Whether the text of the two tokens is merged to these two: no symbol at the end of the one
        and at the start of the other is merged while both are there."""
        if before < 0:
            return True
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._merged_apart(before, token)
        return known

    def _merged_apart(self, before: int, token: int) -> bool:
        text, left, right = self.vocabulary.text, self.rims[before], self.rims[token]
        if left is None or right is None:
            return self.vocabulary.merge(text[before] + text[token]) == [before, token]
        cost, a, b = self.vocabulary.score, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[1][a], right[0][b]
            across = cost.get(x + y)
            # of equal costs the leftmost pair goes first: the one inside the left token
            if across is not None and (-across < x_ends and -across <= y_ends):
                return False
            if min(x_ends, y_ends) == float("inf"):
                return True
            if x_ends <= y_ends:
                a += 1
            else:
                b += 1

    def _shape(self, whole: str) -> tuple[int, list[int], list[tuple[int, int]]]:
        """For a suffix with the next symbol: how long the next suffix is, the places in it at which no
        token may still begin, and the tokens that end here by the place they begin at."""
        kept = len(whole)
        while whole[len(whole) - kept :] not in self.begins:
            kept -= 1
        after = whole[len(whole) - kept :]
        idle = [j for j in range(kept + 1) if after[j:] not in self.begins]
        ends = [(j, self.usable[whole[j:]]) for j in range(len(whole)) if whole[j:] in self.usable]
        return kept, idle, ends

    def step(self, state: State, symbol: str) -> tuple[State, int]:
        """The state after one more symbol, and how many tokens more there are."""
        suffix, places, *run = state
        if symbol == SPACE:
            after = self.spaces(run[0] + 1 if run else 1)
            return after, self.added[after[2]]
        whole = suffix + symbol
        shape = self.shapes.get(whole)
        if shape is None:
            shape = self.shapes[whole] = self._shape(whole)
        kept, idle, ends = shape
        for j, token in ends:
            place = places[j]
            if place is not None and self._fits(place[0], token):
                last, count = token, place[1] + 1
                break
        else:
            if symbol in self.usable:
                raise AssertionError(f"no token ends with {symbol!r} after {suffix!r}")
            last, count = BYTES, len(symbol.encode())
        shifted = [p and (p[0], p[1] - count) for p in places[len(places) - kept :]] if kept else []
        shifted.append((last, 0))
        for j in idle:
            shifted[j] = None
        return (whole[len(whole) - kept :], tuple(shifted)), count

    def read(self, at: int, symbols: str) -> tuple[int, int]:
        """Number of the state after ``symbols`` from state number ``at``, and tokens added."""
        table, total = self.next, 0
        for symbol in symbols:
            found = table[at].get(symbol)
            if found is None:
                state, count = self.step(self.states[at], symbol)
                found = table[at][symbol] = (self.number(state), count)
            at = found[0]
            total += found[1]
        return at, total

    def run(self, state: State, symbols: str) -> tuple[State, int]:
        """As ``read``, part by part: what a word after a single space adds is remembered."""
        if len(self.states) > self.limit or len(self.shapes) > self.limit:
            self.shapes.clear()
            self._clear()
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.pairs) > 2 * self.limit:
            self.pairs.clear()
        head, *words = symbols.split(SPACE)
        at, total = self.read(self.number(state), head)
        spaces = len(self.states[at]) > 2  # a space now makes a run of them
        known, last = self.words, len(words) - 1
        for k, word in enumerate(words):
            found = known.get(word)
            if spaces or not word:
                at, count = self.read(at, SPACE + word)
            elif found is not None:
                at, count = found
            else:
                at, count = self.read(self.space, word)
                count += self.added[1]
                if len(word) < 64 and k < last:
                    known[word] = at, count
            total += count
            spaces = not word
        return self.states[at], total

    def guesses(self, before: str) -> list[State]:
        """States in which a chunk after the symbols ``before`` may be entered."""
        word = before.rpartition(SPACE)[2]
        spaced = before[: len(before) - len(word)]
        spaces = len(spaced) - len(spaced.rstrip(SPACE))
        if spaces and spaces < len(spaced):  # their number is certain
            return [self.run(self.spaces(spaces), word)[0]]
        if spaces:
            return list({self.run(self.spaces(k), word)[0]: None for k in range(1, 2 * self.turn + 1)})
        found = {}
        for k in range(min(self.longest, len(before))):
            found[self.run(("", ((BYTES, 0),)), before[k:])[0]] = None
        return list(found)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer per Python worker and vocabulary, kept over its tasks."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def symbols_of(text: str) -> str:
    """What the transducer reads: a space first, unless the text is empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def scan(maps: list[dict[str, tuple[str, int]]], start: str) -> list[tuple[str, int] | None]:
    """The state and sum after each map when the first is entered in ``start``; None where a map
    lacks the state it is entered in. Maps are composed in pairs at doubling distance."""
    numbers: dict[str, int] = {start: 0}
    for m in maps:
        for a, (b, _) in m.items():
            numbers.setdefault(a, len(numbers))
            numbers.setdefault(b, len(numbers))
    names = list(numbers)
    # row: a chunk's map as its entered states, left states and sums, None spelled -1
    width = max((len(m) for m in maps), default=0)
    entered = np.full((len(maps), width), -1, np.int64)
    left, sums = entered.copy(), np.zeros((len(maps), width), np.int64)
    for k, m in enumerate(maps):
        for j, (a, (b, count)) in enumerate(m.items()):
            entered[k, j], left[k, j], sums[k, j] = numbers[a], numbers[b], count
    far = 1
    first_entered = entered.copy()
    while far < len(maps):
        # map of the chunks up to k - far, then the map of those after it up to k
        came = left[:-far]
        hits = (came[:, :, None] == first_entered[far:][:, None, :]) & (came >= 0)[:, :, None]
        column = hits.argmax(axis=2)
        known = hits.any(axis=2)
        rows = np.arange(far, len(maps))[:, None]
        new_left = np.where(known, left[rows, column], -1)
        new_sums = sums[:-far] + np.where(known, sums[rows, column], 0)
        first_entered = np.concatenate((first_entered[:far], first_entered[:-far]))
        left = np.concatenate((left[:far], new_left))
        sums = np.concatenate((sums[:far], new_sums))
        far *= 2
    out: list[tuple[str, int] | None] = []
    own = np.flatnonzero(entered[0] == 0) if len(maps) and width else []
    for k in range(len(maps)):
        if len(own) and left[k, own[0]] >= 0:
            out.append((names[left[k, own[0]]], int(sums[k, own[0]])))
        else:
            out.append(None)
    return out


def token_counts(
    docs: DataFrame, path: str, text: str = "text", most: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_bytes`` (UTF-8) and ``n_tokens`` of each text as
    the library of the vocabulary at ``path`` counts them without begin and end ids, and
    ``over_limit`` (more than ``most`` tokens) if that is given. Columns of these names are
    replaced; a null text counts as empty. Rows keep their number, repeated ones too.

    Texts of one chunk are counted where they are read. Longer ones are cut, their chunks dealt to
    all tasks, and the maps composed; a text has at most 2^31 / ``chunk`` of them.
    """
    new = ["n_bytes", "n_tokens"] + (["over_limit"] if most is not None else [])
    kept = [c for c in docs.columns if c != text and c not in new]
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*kept, body.alias("__text"), F.octet_length(body).cast("long").alias("n_bytes"))
    short = _whole(source.filter(F.length("__text") < chunk), path)
    long = _by_chunks(source.filter(F.length("__text") >= chunk), path, chunk)
    out = short.unionByName(long)
    if most is not None:
        out = out.withColumn("over_limit", F.col("n_tokens") > most)
    return out.select(*kept, *new)


def _whole(source: DataFrame, path: str) -> DataFrame:
    at = source.columns.index("__text")
    schema = source.withColumn("__text", F.lit(0).cast("long")).withColumnRenamed("__text", "n_tokens").schema

    def count(parts):
        import pyarrow as pa

        machine = transducer(path)
        for batch in parts:
            totals = []
            for value in batch.column(at):
                state = machine.states[machine.empty]
                totals.append(machine.run(state, symbols_of(value.as_py()))[1])
            columns = list(batch.columns)
            columns[at] = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(count, schema)


def _by_chunks(source: DataFrame, path: str, chunk: int) -> DataFrame:
    spark = source.sparkSession
    rows = staged(source.withColumn("__row", F.expr("uuid()")), "long-texts")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row, text in zip(part["__row"], part["__text"]):
                whole = symbols_of(text)
                for k, lo in enumerate(range(0, len(whole), chunk)):
                    before, symbols = whole[max(0, lo - BEFORE) : lo], whole[lo : lo + chunk]
                    yield pd.DataFrame({"row": [row], "chunk": [k], "before": [before], "symbols": [symbols]})

    chunks = rows.select("__row", "__text").mapInPandas(cut, "row string, chunk long, before string, symbols string")
    # the text now lies in the chunks, dealt evenly however long one text is
    chunks = staged(chunks.repartition("row", "chunk"), "chunks")
    entries = "row string, chunk long, entered string, left string, tokens long"

    def guess(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for part in parts:
            for row, k, before, symbols in part.itertuples(index=False):
                states = machine.guesses(before) if k else [machine.states[machine.empty]]
                yield _entries(machine, row, k, symbols, states)

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)
        for part in parts:
            for row, k, symbols, entered in part.itertuples(index=False):
                yield _entries(machine, row, k, symbols, [_state(entered)])

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        """The sum of a text, or the first chunk that lacks a state, with that state."""
        maps: list[dict[str, tuple[str, int]]] = [{} for _ in range(int(part["chunk"].max()) + 1)]
        for k, a, b, n in zip(part["chunk"], part["entered"], part["left"], part["tokens"]):
            maps[k][a] = (b, int(n))
        start = repr(("", ((START, 0),)))
        after = scan(maps, start)
        lacks = next((k for k, x in enumerate(after) if x is None), None)
        row = part["row"].iloc[0]
        if lacks is None:
            return pd.DataFrame({"row": [row], "chunk": [-1], "entered": [None], "tokens": [after[-1][1]]})
        return pd.DataFrame({"row": [row], "chunk": [lacks], "entered": [after[lacks - 1][0]], "tokens": [0]})

    maps = staged(chunks.mapInPandas(guess, entries), "chunk-maps")
    while True:
        sums = maps.groupBy("row").applyInPandas(compose, "row string, chunk long, entered string, tokens long")
        sums = staged(sums, "text-sums")
        open_chunks = sums.filter("chunk >= 0").select("row", "chunk", "entered")
        if open_chunks.isEmpty():
            break
        found = chunks.join(open_chunks, ["row", "chunk"]).select("row", "chunk", "symbols", "entered")
        maps = staged(maps.unionByName(found.mapInPandas(add, entries)), "chunk-maps")
    totals = sums.select(F.col("row").alias("__row"), F.col("tokens").alias("n_tokens"))
    return rows.drop("__text").join(totals, "__row").drop("__row")


def _entries(machine: Transducer, row: str, chunk: int, symbols: str, states: list[State]) -> pd.DataFrame:
    made = [(row, chunk, repr(s), *_left(machine.run(s, symbols))) for s in states]
    return pd.DataFrame(made, columns=["row", "chunk", "entered", "left", "tokens"])


def _left(after: tuple[State, int]) -> tuple[str, int]:
    return repr(after[0]), after[1]


def _state(spelled: str) -> State:
    from ast import literal_eval

    return literal_eval(spelled)
