"""SentencePiece BPE ids by a prefix table, and decoding.

Every prefix of a text has one encoding, so it has one last token. Going from left to right,
an automaton over the vocabulary lists the tokens that end at each position; the right one is
the token that may stand next to the last token of the prefix before it, which a table of
pairs tells (a pair is compatible if encoding its joined text gives the pair again). The
ids are then read backwards from the end.

Each run of spaces starts a new part, since no piece holds a space after another character,
so parts are encoded alone and remembered. Parts that begin with two or more spaces are
merged step by step instead: the pieces of spaces share one score, and for them the order
of merges depends on the position, which pairs can't tell.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # stands for a space in the vocabulary
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceBpe:
    """``ids(text)``: the ids as unsigned 32-bit bytes, equal to those of the library without
    begin or end ids. At most ``limit`` words and pairs are remembered; a full cache is
    emptied, which only costs time."""

    def __init__(self, path: str, limit: int = 500_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for i, t in self.text.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.size = {i: len(t) for i, t in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            if [i] == self.merge(t):  # else no text is encoded with it
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.limit = limit
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes | None] = {}

    def merge(self, part: str) -> list[int]:
        """Ids by merging step by step: the best scored pair first, the leftmost of equals."""
        symbol: list[str | None] = list(part)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                both = symbol[a] + symbol[b]
                score = self.score.get(both)
                if score is not None:
                    heapq.heappush(heap, (-score, a, b, both))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if symbol[a] is None or symbol[b] is None or symbol[a] + symbol[b] != both:
                continue
            symbol[a], symbol[b] = both, None
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for s in symbol:
            if s is not None:
                out += [self.id[s]] if s in self.id else self._fallback(s)
        return out

    def _fallback(self, chars: str) -> list[int]:
        return [self.bytes[b] for b in chars.encode()]

    def _pair(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return known

    def part(self, part: str) -> list[int]:
        """The ids of one part, spaces written as in the vocabulary."""
        if part.startswith(SPACE * 2):
            return self.merge(part)
        n, pairs, pair, none = len(part), self.pairs.get, self._pair, -1
        last = [none] * (n + 1)
        for end, (token, size) in self.automaton.iter(part):
            end += 1
            if last[end] != none:
                continue
            start = end - size
            if start:
                before = last[start]
                if before == none:
                    if part[start - 1] in self.id:
                        continue  # else it is a character without a piece, joined to none
                else:
                    known = pairs(before << 32 | token)
                    if not (pair(before, token) if known is None else known):
                        continue
            last[end] = token
        out: list[int] = []
        at = n
        while at:
            token = last[at]
            if token == none:
                out += reversed(self._fallback(part[at - 1]))
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        out.reverse()
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        known = self.words
        try:
            return b"".join([known[p] for p in parts])
        except (KeyError, TypeError):
            pass
        if len(known) > self.limit or len(self.pairs) > 4 * self.limit:
            known.clear()
            self.pairs.clear()
        for p in parts:
            if p not in known:
                alone = p and p[0] != SPACE and p[-1] != SPACE
                known[p] = array("I", self.part(SPACE + p)).tobytes() if alone else None
        if None in [known[p] for p in parts]:  # spaces in a row are one part
            whole = SPACE + text.replace(" ", SPACE)
            return b"".join([array("I", self.part(p)).tobytes() for p in _PART.findall(whole)])
        return b"".join([known[p] for p in parts])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, PieceBpe] = {}


def encoder(path: str) -> PieceBpe:
    """One encoder per Python worker and model, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = PieceBpe(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids`` (array of int) and ``decoded``, the
    text that the ids stand for; columns of these names are replaced. Null counts as empty."""
    return _each(docs, path, text, "ids array<int>, decoded string", lambda ids, decoded: (ids, decoded))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """As ``encode``, with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas)
    and ``decoded_sha256`` in place of the ids and the decoded text, which stay in the task."""
    decimal = [str(i) for i in range(1 << 16)]

    def digest(ids: list[int], decoded: str):
        joined = ",".join([decimal[i] if i < 65536 else str(i) for i in ids])
        return (
            len(ids),
            hashlib.sha256(joined.encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )

    return _each(docs, path, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _each(docs: DataFrame, path: str, text: str, columns: str, make) -> DataFrame:
    new = [c.split(" ")[0] for c in columns.split(", ")]
    kept = [c for c in docs.columns if c != text and c not in new]
    types = [c.split(" ")[1] for c in columns.split(", ")]
    source = docs.select(*kept, F.col(text).alias("__text"))
    schema = docs.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(new, types)]).schema

    def run(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe, arrow = encoder(path), to_arrow_schema(schema)
        for batch in parts:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                made = []
                for value in piece.column(len(kept)).to_pylist():
                    ids = array("I", bpe.ids(value or "")).tolist()
                    made.append(make(ids, bpe.decode(ids)))
                columns = [pa.array(c, arrow.field(n).type) for n, c in zip(new, zip(*made))]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *columns], names=[*kept, *new])

    return source.mapInArrow(run, schema)
