"""Token ids in files, compressed by an adaptive context-mixing range coder.

A file holds chunks, records of consecutive whole documents. The ids of a chunk are cut into
blocks of equal length which are coded independently: each starts from fresh models and has a
checksum, so one damaged block loses no other and one block can be read alone. Coder and
decoder step through many blocks of a chunk at once, an id of each per step, in arrays.

The head of a chunk lists its distinct ids with their counts. Three orders predict the next id:
order 2 the id that last followed the two before, order 1 the one that last followed the one
before, order 0 every id by its share in the chunk. The guess of the highest order that has
one is accepted or refused by a binary decision; its probability is mixed in the logistic domain
from a trust in orders 2 and 1, learned in this block by how often guesses held and whether they agree,
and the share of the guess itself, with a weight that follows its errors. If it is refused, the id is
coded by its share. All arithmetic is in integers, so every machine decodes alike.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.bytebpe import encoder
from cartloom.llm.common import new_path

MAGIC = b"CMX3"
BLOCK = 2048
#: Ids of a chunk, about: a document that is longer is a chunk by itself.
CHUNK = 4096 * BLOCK
#: Blocks that are coded at once; the models of these are in memory together.
ABREAST = 4096
#: Bytes of texts that are tokenized at once, about.
SLICE = 1 << 23
_COLUMNS = "part int, ahead long, n_ids long, chunk binary"
_HEAD = struct.Struct("<4sQIIII")  # magic, ids, ids of a block, documents, bytes of the tables of documents and ids
_ORDER1, _ORDER2 = 11, 12  # bits of the tables of guesses of a block
_ONE = 1 << 16  # a probability of one
_LEAST = 48
_SHORT = 1 << 46  # a span below it is lengthened by a word
_RATE_TRUST, _RATE_WEIGHT = 2, 15  # of learning, as shifts

#: ln(p / (1 - p)) in 1/256 for probabilities in 1/4096, and the way back in 1/65536.
_STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int64)
_SQUASH = np.array([min(max(round(_ONE / (1 + math.exp(-i / 256))), _LEAST), _ONE - _LEAST) for i in range(-2400, 2401)], np.int64)


class _Shares:
    """Order 0: the share of each symbol of a chunk as an interval of ``total``, and in the logistic domain.

    Symbols are numbered from the most to the least frequent, so most numbers below ``total`` are found
    by their first bits alone."""

    def __init__(self, counts: np.ndarray):
        self.size = np.maximum(counts.astype(np.int64) >> max(int(counts.sum()).bit_length() - 24, 0), 1)
        self.start = np.cumsum(self.size) - self.size
        self.total = int(self.size.sum())
        self.stretched = _STRETCH[np.minimum(self.size * 4096 // self.total, 4095)]
        self.shift = max(self.total.bit_length() - 16, 0)
        edges = np.arange((self.total - 1 >> self.shift) + 2, dtype=np.int64) << self.shift
        self.lowest = np.searchsorted(self.start, np.minimum(edges, self.total - 1), "right") - 1

    def find(self, v: np.ndarray) -> np.ndarray:
        """The symbols in whose intervals ``v`` lie."""
        at = v >> self.shift
        y = self.lowest.take(at, mode="clip")
        rows = np.flatnonzero(y != self.lowest.take(at + 1, mode="clip"))
        y[rows] = np.maximum(np.searchsorted(self.start, v[rows], "right") - 1, 0)
        return y


class _Models:
    """The adaptive state of ``n`` blocks, and the predictions of their next symbols."""

    def __init__(self, n: int, shares: _Shares):
        self.stretched = shares.stretched
        row = np.arange(n, dtype=np.int64)
        # the guesses of order 1 and, behind them, of order 2: symbol * 4 + confidence
        self.at = np.stack((row << _ORDER1, (n << _ORDER1) + (row << _ORDER2)))
        self.mask = np.array([[(1 << _ORDER1) - 1], [(1 << _ORDER2) - 1]])
        self.table = np.zeros((n << _ORDER1) + (n << _ORDER2), np.int32)  # order 1: at first the most frequent symbol
        self.table[n << _ORDER1 :] = -4  # order 2: at first none
        self.mixed, self.before = np.zeros((2, n), np.int64), np.zeros(n, np.int64)
        # what the trust in both orders adds to the logit, by their confidence, whether they agree and whether order 2 has a guess
        trust = _STRETCH[np.array([3, 8, 24, 48]) << 6] << 8
        trust = (trust[:, None] * 100 + trust * 80).ravel() >> 8
        self.trust = np.tile(np.repeat(trust + (2400 << 8), 4).astype(np.int32), n)  # and the place of 0 in _SQUASH
        self.at64 = row << 6
        self.weight = np.full(n, 60 << 8, np.int64)  # of the share of the guess

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """The guess and the chance that it is right."""
        self.i = (self.mixed >> 20 & self.mask) + self.at
        self.e = self.table.take(self.i, mode="clip").astype(np.int64)
        self.g, self.c = self.e >> 2, self.e & 3
        there = self.e[1] >= 0
        guess = np.where(there, self.g[1], self.g[0])
        self.set = ((self.c[1] << 2) + self.c[0] << 2) + self.at64
        self.set += guess == self.g[0]
        self.set += there
        self.set += there
        self.t = self.trust.take(self.set, mode="clip")
        self.s = self.stretched.take(guess, mode="clip")
        self.chance = _SQUASH.take((self.weight * self.s >> 16) + (self.t >> 8), mode="clip")
        return guess, self.chance

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        off = (hit.astype(np.int64) << 16) - self.chance
        self.trust[self.set] = self.t + (off >> _RATE_TRUST)
        self.weight += self.s * off >> _RATE_WEIGHT
        self.table[self.i] = np.where(self.g == x, self.e + (self.c < 3), np.where(self.c > 1, self.e - 1, x << 2))
        self.mixed[0] = x * 0x9E3779B1
        np.add(self.mixed[0], self.before, out=self.mixed[1])
        self.before = x * 0x85EBCA77


def _encode(grid: np.ndarray, shares: _Shares) -> list[bytes]:
    """The coded words of each column of ``grid``."""
    block, n = grid.shape
    m = _Models(n, shares)
    low, span = np.zeros(n, np.int64), np.full(n, (1 << 62) - 1, np.int64)
    rows_of: list[np.ndarray] = []
    words: list[np.ndarray] = []
    for step in range(block):
        x = grid[step].astype(np.int64)
        guess, chance = m.guess()
        hit = guess == x
        bound = (span >> 16) * chance
        r = (span - bound) // shares.total
        low += np.where(hit, 0, bound + r * shares.start.take(x))
        span = np.where(hit, bound, r * shares.size.take(x))
        rows = np.flatnonzero(span < _SHORT)
        while len(rows):
            lows = low[rows]
            rows_of.append(rows.astype(np.int32))
            words.append((lows >> 46).astype(np.uint32))  # the 17th bit is a carry, settled at the end
            low[rows] = (lows & _SHORT - 1) << 16
            span[rows] = s = span[rows] << 16
            rows = rows[s < _SHORT]
        m.learn(x, hit)
    del m
    # a word is enough to end with: the decoder takes zeros after it, and the span is longer than that
    rows_of.append(np.arange(n, dtype=np.int32))
    words.append((low + _SHORT - 1 >> 46).astype(np.uint32))
    row = np.concatenate(rows_of)
    used = np.bincount(row, minlength=n)
    order = np.argsort(row.astype(np.int16) if n < 1 << 15 else row, kind="stable")
    longest = int(used.max())
    grouped = np.zeros((n, longest), np.uint32)
    grouped[np.arange(longest) < used[:, None]] = np.concatenate(words)[order]
    carry = np.zeros(n, np.uint32)
    turned = np.ascontiguousarray(grouped.T)
    for k in range(longest - 1, -1, -1):
        w = turned[k] + carry
        turned[k], carry = w & 0xFFFF, w >> 16
    grouped = turned.T.astype("<u2", order="C")
    return [grouped[i, : used[i]].tobytes() for i in range(n)]


def _decode(coded: list[bytes], block: int, shares: _Shares) -> np.ndarray:
    """Symbols of each block, a row for each."""
    n = len(coded)
    longest = max(len(c) for c in coded) // 2 + 5
    taken = np.zeros((n, longest), np.uint16)
    for i, c in enumerate(coded):
        taken[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    head = taken[:, :4].astype(np.int64)
    code, span = head[:, 0] << 46 | head[:, 1] << 30 | head[:, 2] << 14 | head[:, 3] >> 2, np.full(n, (1 << 62) - 1, np.int64)
    # what follows the first 62 bits
    words = ((taken[:, 3:-1] & 3) << 14 | taken[:, 4:] >> 2).ravel()
    at = np.arange(n, dtype=np.int64) * (longest - 4)
    del taken
    m = _Models(n, shares)
    grid = np.zeros((block, n), np.int32)
    for step in range(block):
        guess, chance = m.guess()
        bound = (span >> 16) * chance
        hit = code < bound
        r = (span - bound) // shares.total
        rest = code - bound
        y = shares.find(np.minimum(rest // r, shares.total - 1))
        x = np.where(hit, guess, y)
        code = np.where(hit, code, rest - r * shares.start.take(y))
        span = np.where(hit, bound, r * shares.size.take(y))
        grid[step] = x
        rows = np.flatnonzero(span < _SHORT)
        while len(rows):  # clipped: a damaged block may ask for more
            k = at[rows]
            code[rows] = code[rows] << 16 | words.take(k, mode="clip")
            at[rows] = k + 1
            span[rows] = s = span[rows] << 16
            rows = rows[s < _SHORT]
        m.learn(x, hit)
    return grid.T


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, their counts, and the number of each id by falling count."""
    dense = len(ids) and ids.max() < max(4 * len(ids), 1 << 16)
    if dense:
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        counts = counts[names]
    else:
        names, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    by_count = np.argsort(-counts, kind="stable")
    number = np.empty(len(names), np.int32)
    number[by_count] = np.arange(len(names), dtype=np.int32)
    if not dense:
        return names, counts, number[place]
    number_of = np.zeros(int(names[-1]) + 1, np.int32)
    number_of[names] = number
    return names.astype("<u4"), counts, number_of[ids]


def write_chunk(keys: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk: head, compressed tables of documents and of ids, sizes and checksums of blocks, blocks."""
    ids = ids.astype("<u4", copy=False)
    names, counts, symbols = _alphabet(ids)
    shares = _Shares(np.sort(counts)[::-1]) if len(ids) else None
    coded: list[bytes] = []
    width, steps = max(ABREAST * BLOCK // block, 1), min(block, len(ids))
    for lo in range(0, len(ids), width * block):
        part = symbols[lo : lo + width * block]
        n = -(-len(part) // block)
        grid = np.zeros(n * steps, np.int32)
        grid[: len(part)] = part
        grid = np.ascontiguousarray(grid.reshape(n, steps).T)
        coded += _encode(grid, shares)
    sums = [zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) for i in range(len(coded))]
    known = np.array([k is not None for k in keys], np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    table = zlib.compress(numbers.tobytes() + np.array(lengths, "<u4").tobytes() + known.tobytes(), 1)
    gaps = np.diff(names, prepend=np.uint32(0)).astype("<u4")
    alphabet = zlib.compress(gaps.tobytes() + counts.astype("<u4").tobytes(), 9)
    head = _HEAD.pack(MAGIC, len(ids), block, len(keys), len(table), len(alphabet))
    sizes = np.array([len(c) for c in coded], "<u4").tobytes()
    return b"".join([head, table, alphabet, sizes, np.array(sums, "<u4").tobytes(), *coded])


def read_chunk(chunk: bytes, only: list[int] | None = None) -> tuple[list[int | None], list[int], np.ndarray]:
    """Keys, lengths and ids of a chunk; with ``only``, the ids of these blocks alone.

    Raises ValueError where a checksum does not fit."""
    magic, n, block, documents, of_documents, of_ids = _HEAD.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = _HEAD.size
    table = zlib.decompress(chunk[at : at + of_documents])
    at += of_documents
    gaps, counts = np.frombuffer(zlib.decompress(chunk[at : at + of_ids]), "<u4").reshape(2, -1)
    at += of_ids
    names = np.cumsum(gaps, dtype="<u4")
    known = np.frombuffer(table, np.uint8, documents, 12 * documents).tolist()
    keys = [k if there else None for k, there in zip(np.frombuffer(table, "<i8", documents).tolist(), known)]
    lengths = np.frombuffer(table, "<u4", documents, 8 * documents).tolist()
    blocks = -(-n // block)
    sizes = np.frombuffer(chunk, "<u4", blocks, at).astype(np.int64)
    sums = np.frombuffer(chunk, "<u4", blocks, at + 4 * blocks).tolist()
    begins = at + 8 * blocks + np.concatenate(([0], np.cumsum(sizes)))
    chosen = list(range(blocks)) if only is None else only
    if not chosen:
        return keys, lengths, np.zeros(0, "<u4")
    by_count = np.argsort(-counts.astype(np.int64), kind="stable")
    shares, parts = _Shares(counts[by_count]), []
    names = names[by_count]
    width = max(ABREAST * BLOCK // block, 1)
    for lo in range(0, len(chosen), width):
        some = chosen[lo : lo + width]
        grid = names[_decode([chunk[begins[i] : begins[i + 1]] for i in some], min(block, n), shares)]
        for i, row in zip(some, grid):
            row = row[: min(block, n - i * block)]
            if zlib.crc32(row.tobytes()) != sums[i]:
                raise ValueError(f"block {i} is damaged")
            parts.append(row)
    return keys, lengths, np.concatenate(parts)


def write(docs: DataFrame, path: str, target: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode the whole texts (null: empty), each followed by ``end_id``, and write them in
    ascending order of ``key`` (a whole number; nulls come first and stay null) to ``target``.

    The files are Spark's, so a lost task leaves no half file: a row per chunk with its place
    (``part``, ids of the part ``ahead`` of it), its number of ids and its bytes. An empty table gives
    none. A very long text is one chunk: its ids are held whole, as its row is, while its blocks are
    coded ``ABREAST`` at a time. Other columns are not read, whatever their names."""
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("key").sortWithinPartitions("key")

    def code(parts):
        import pyarrow as pa
        import pyarrow.compute as pc

        bpe, part = encoder(path), TaskContext.get().partitionId()
        keys: list[int] = []
        lengths: list[int] = []
        bodies: list[np.ndarray] = []
        held, ahead = 0, 0

        def chunk():
            ids = np.concatenate(bodies)
            bodies.clear()
            body = write_chunk(keys, lengths, ids)
            columns = [pa.array([part], pa.int32()), pa.array([ahead], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "ahead", "n_ids", "chunk"])

        for batch in parts:
            values = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(values).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(values):
                hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")), lo + 1)
                ids, sizes = bpe.many(values.slice(lo, hi - lo), end_id)
                keys += batch.column(0).slice(lo, hi - lo).to_pylist()
                lengths += sizes.tolist()
                bodies.append(ids)
                held += len(ids)
                lo = hi
                if held >= CHUNK:
                    yield chunk()
                    keys.clear()
                    lengths.clear()
                    held, ahead = 0, ahead + held
        if keys:
            yield chunk()

    chunks = ordered.mapInArrow(code, _COLUMNS)
    chunks.write.option("compression", "none").parquet(target)


def read(spark, target: str, key: str = "doc_id") -> DataFrame:
    """``key``, start (ids of all documents before), n_tokens and ids (binary, little-endian
    unsigned 32-bit) of every document in the files at ``target``."""
    chunks = spark.read.schema(_COLUMNS).parquet(target)
    # a row per task that wrote, whatever the number of chunks and documents
    totals = {r[0]: r[1] for r in chunks.groupBy("part").agg(F.sum("n_ids")).collect()}
    before, starts = 0, []
    for part in sorted(totals):
        starts.append((part, before))
        before += totals[part]
    placed = chunks.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")

    def decode(parts):
        import pyarrow as pa

        for batch in parts:
            for base, chunk in zip(*(batch.column(c) for c in ("base", "chunk"))):
                keys, lengths, ids = read_chunk(chunk.as_py())
                raw = ids.tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                for lo in range(0, len(keys), 2000):
                    b, e = begins[lo : lo + 2000], ends[lo : lo + 2000]
                    columns = [
                        pa.array(keys[lo : lo + 2000], pa.int64()),
                        pa.array(b + base.as_py(), pa.int64()),
                        pa.array(lengths[lo : lo + 2000], pa.int64()),
                        pa.array([raw[4 * x : 4 * y] for x, y in zip(b.tolist(), e.tolist())], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids"])

    bases = placed.select((F.col("before") + F.col("ahead")).alias("base"), "chunk")
    rows = bases.mapInArrow(decode, "key long, start long, n_tokens long, ids binary")
    return rows.select(F.col("key").alias(key), "start", "n_tokens", "ids")


def round_trip(docs: DataFrame, path: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back."""
    target = new_path(docs.sparkSession, "token-file")
    write(docs, path, target, end_id, key)
    return read(docs.sparkSession, target, key)
