"""Byte-level BPE ids of whole texts through the tokenizers library, with a cache by word.

The pre-tokenizer never lets a token cross from a non-space character to the white space
after it, so a text may be cut before every such white space and its parts encoded alone.
"""

from __future__ import annotations

import re
import string
from array import array

import numpy as np

from cartloom.llm.common import single_thread

#: Unicode White_Space without the ASCII space.
OTHER_SPACE = "\t-\r\x85\xa0  -     　"
#: Characters whose run after letters is one pre-token.
_TAIL = string.punctuation
_CHUNK = re.compile(f"[ {OTHER_SPACE}]*[^ {OTHER_SPACE}]+|[ {OTHER_SPACE}]+")


class ByteBpe:
    """``ids(text)``: the ids as little-endian unsigned 32-bit bytes.

    At most ``limit`` words and a quarter as many tokens of words with marks are remembered; a
    full cache is emptied, which only costs time.
    """

    def __init__(self, path: str, limit: int = 350_000):
        single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: no added token can lie in letters or digits with punctuation behind them
        self.plain_tails = not any("\n" in a or not a.rstrip(_TAIL) or a.rstrip(_TAIL).isalnum() for a in self.added)
        self.limit = limit
        self.after_space: dict[str, bytes | bool] = {}
        self.spaces = {c for c in map(chr, range(0x3001)) if re.match(f"[{OTHER_SPACE}]", c)}
        self.tokens: dict[str, bytes] = {}
        #: words of letters after a space and without one, as ``many`` met them lately, and before that
        self.spaced: list[dict[str, bytes]] = [{}, {}]
        self.bare: list[dict[str, bytes]] = [{}, {}]
        #: byte -> the character that stands for it in the vocabulary
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        head, *parts = text.split(" ")
        known = self.after_space
        found = list(map(known.get, parts))
        if None in found:
            if len(known) > self.limit:
                known.clear()
            if len(self.tokens) > self.limit // 4:
                self.tokens.clear()
            for k, p in enumerate(parts):
                if found[k] is None:
                    if p not in known:
                        # False: the next part is not cut off from this one by a token border
                        known[p] = self._chunk(" " + p) if p and p[-1] not in self.spaces else False
                    found[k] = known[p]
        if head[-1:] not in self.spaces:
            try:
                return self._chunk(head) + b"".join(found)
            except TypeError:
                pass
        return b"".join([self._chunk(c) for c in _CHUNK.findall(text)])

    def many(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts without nulls, each followed by ``end``, and their number for each text.

        Every distinct part between spaces is looked up once. Two generations of up to ``limit`` words of
        letters, and a quarter as many without a space, are remembered; words in use stay when the older one goes.
        """
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        distinct, part = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        count = pc.list_value_length(split).to_numpy().astype(np.int64)
        begin = np.cumsum(count) - count
        if len(self.tokens) > self.limit // 4:
            self.tokens.clear()
        found = list(map(self.spaced[0].get, distinct))
        cut_off = np.ones(len(distinct), bool)
        tails = self.tokens
        for k in [k for k, ids in enumerate(found) if ids is None]:
            word = distinct[k]
            letters = word.rstrip(_TAIL)
            ids, tail = self.spaced[0].get(letters), word[len(letters) :]
            if ids is not None and tail in tails and self.plain_tails:
                found[k] = ids + tails[tail]
            else:
                cut_off[k] = word != "" and word[-1] not in self.spaces
                found[k] = self._word(word, True) if cut_off[k] else b""
        # the first part has no space before it; a text whose parts are no chunks by themselves is cut again
        first = part[begin]
        wrong = np.concatenate(([0], np.cumsum(~cut_off[part])))
        again = wrong[begin + count] - wrong[begin + 1] > 0
        for k, i in enumerate(first.tolist()):
            if again[k] or distinct[i][-1:] in self.spaces:
                again[k] = True
                found.append(b"".join([self._chunk(c) for c in _CHUNK.findall(texts[k].as_py())]))
            else:
                found.append(self._word(distinct[i], False))
        found += [b"", int(end).to_bytes(4, "little")]
        part[np.repeat(again, count)] = len(found) - 2
        part[begin] = len(distinct) + np.arange(len(first))
        part = np.insert(part, begin + count, len(found) - 1)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        place = np.cumsum(size) - size
        sizes = size[part]
        past = np.cumsum(sizes)
        at = np.repeat(place[part] - past + sizes, sizes)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(found), "<u4")[at], np.add.reduceat(sizes, begin + np.arange(len(begin)))

    def _word(self, word: str, after_space: bool) -> bytes:
        """Ids of a chunk that does not end with white space."""
        recent, older = caches = self.spaced if after_space else self.bare
        ids = recent.get(word)
        if ids is None:
            if not word.isalpha():
                return self._mixed_word(word, after_space)
            ids = older.get(word)
            if ids is None:
                token = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
                ids = self._encoded(self.table[32] + token if after_space else token)
            if len(recent) >= (self.limit if after_space else self.limit // 4):
                caches[:] = recent, older = {}, recent
            recent[word] = ids
        return ids

    def _mixed_word(self, word: str, after_space: bool) -> bytes:
        letters = word.rstrip(_TAIL)
        if self.plain_tails and letters.isalpha():
            return self._word(letters, after_space) + self._token(word[len(letters) :])
        first, *lines = word.split("\n")
        if lines and self.plain_tails and all([x.rstrip(_TAIL).isalnum() for x in (first, *lines)]):
            # a lone line break between two characters that are not white space is a token
            return self._token("\u010a").join([self._word(first, after_space), *[self._word(x, False) for x in lines]])
        return self._chunk(" " + word if after_space else word)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            if word.isascii():  # letters stand for themselves
                token = chunk if word is chunk else self.table[32] + word
            else:
                token = chunk.encode().decode("latin-1").translate(self.table)
            known = self.tokens.get(token)  # a new one is remembered as a word already
            return self._encoded(token) if known is None else known
        if len(word) > 1 and word[-1] in ".,!?;:|" and word[:-1].isalpha():
            head = chunk[:-1].encode().decode("latin-1").translate(self.table)
            return self._token(head) + self._token(chunk[-1])
        lines = word.split("\n")
        if len(lines) > 1 and all(x.isalnum() or x[-1:] in ".,!?;:" and x[:-1].isalnum() for x in lines):
            # a lone line break between two characters that are not white space is a token
            parts = [self._chunk(chunk[: len(chunk) - len(word)] + lines[0]), *map(self._chunk, lines[1:])]
            return self._token("\u010a").join(parts)
        if any(a in chunk for a in self.added):
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join([self._token(t) for t, _ in self.split(chunk)])

    def _token(self, token: str) -> bytes:
        ids = self.tokens.get(token)
        if ids is None:
            ids = self._encoded(token)
            if len(token) < 64:
                self.tokens[token] = ids
        return ids

    def _encoded(self, token: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(token)]).tobytes()


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder per Python worker and vocabulary, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]
