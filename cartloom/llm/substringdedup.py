"""Repeated substrings: every byte that lies in a string of ``length`` bytes which also starts
anywhere else is removed.

Columns of suffixes are built for many strings at once, a symbol of each per round, as in the
construction of a collection's Burrows-Wheeler transform: the order of the suffixes of one
column follows from the order of the next one by a stable sort on the new symbol, and their
common prefixes from minima over that order. Over whole texts this needs as many rounds over
the whole corpus as the longest text has bytes, so anchors first narrow it down:

1. Anchors (one pass). In every window of ``length`` bytes the 64-byte string with the least
   hash is its anchor, so equal windows have equal anchors at equal offsets. An anchor owns a
   run of window starts. A row per anchor keeps the hash of its 64 bytes, and a 128-bit hash of
   all bytes that its windows touch, its context.
2. Counts. A context that occurs twice repeats all its windows. An anchor hash with one context
   repeats none, or those. Only different contexts of one anchor hash stay open, at the borders of
   repeated passages.
3. Columns. The open contexts are fetched once each, grouped by anchor hash and aligned at their
   anchors, and their columns are built from right to left. Neighbours with a common prefix
   of ``length`` repeat. Anchor hashes with more contexts than ``most`` are settled by counting the
   128-bit hashes of their single windows, spread over all tasks.
4. Removal. The starts found, as runs by text, meet the texts once more.

Texts that occur more than once are removed whole without a look inside, but their
windows count for others. Nothing is gathered beyond one text or ``most`` contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import staged

K = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POSITION = np.uint64((1 << 24) - 1)
#: Bytes that are hashed at a time; positions within fit into 24 bits.
CHUNK = 1 << 18
#: Hashes of texts whose broadcast is safe.
BROADCAST_TEXTS = 1_000_000


def _byte_table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_TABLE = _byte_table()


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Of each 64-byte string, from doubled lengths."""
    h, size, factor = _TABLE[raw], 1, _MIX
    with np.errstate(over="ignore"):
        while size < K:
            h = h[:-size] * factor + h[size:]
            factor = factor * factor
            size *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Of every text: its index, the anchor's position, its first and last window start,
    the anchor's hash, the context's hash."""
    import xxhash

    wide = length - K + 1
    part: list[tuple[int, int, bytes]] = []  # index, where the piece starts, piece
    size = 0

    def run() -> Iterator[tuple[int, int, int, int, int, bytes]]:
        joined = b"".join(p[2] for p in part)
        h = _hashes(np.frombuffer(joined, np.uint8))
        least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        at = (least & _POSITION).astype(np.int64)
        begin = 0
        for index, offset, piece in part:
            n = len(piece) - length + 1
            own = at[begin : begin + n]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            first = [0, *cut.tolist()]
            last = [*(cut - 1).tolist(), n - 1]
            places = own[first].tolist()
            keys = h[places].view(np.int64).tolist()
            for lo, hi, a, key in zip(first, last, places, keys):
                a -= begin
                context = xxhash.xxh3_128_digest(piece[lo : hi + length], seed=a - lo)
                yield index, offset + a, offset + lo, offset + hi, key, context
            begin += len(piece)

    for index, text in enumerate(texts):
        if len(text) < length:
            continue
        for lo in range(0, len(text) - length + 1, CHUNK):
            piece = text[lo : lo + CHUNK + length - 1]
            if len(piece) < length:
                break
            part.append((index, lo, piece))
            size += len(piece)
            if size >= CHUNK:
                yield from run()
                part.clear()
                size = 0
    if part:
        yield from run()


def repeated_columns(contexts: list[bytes], before: list[int], groups: list[int], length: int) -> np.ndarray:
    """For each context the columns (0: ``length - K`` bytes before the anchor) at which a
    window starts that another context of its group has too.

    Columns go from right to left. ``order`` sorts the suffixes of the current column by group
    and bytes; ``common[i]`` is the common prefix of its entries i-1 and i.
    """
    m, anchor = len(contexts), length - K
    width = anchor + length
    symbols = np.zeros((width, m), np.uint16)  # 0: outside of the context
    for i, (body, b) in enumerate(zip(contexts, before)):
        symbols[anchor - b : anchor - b + len(body), i] = np.frombuffer(body, np.uint8)
    for i, (body, b) in enumerate(zip(contexts, before)):
        symbols[anchor - b : anchor - b + len(body), i] += 1
    group = np.unique(np.array(groups), return_inverse=True)[1].astype(np.uint16)
    order = np.argsort(group, kind="stable")
    same_group = np.concatenate(([False], group[order][1:] == group[order][:-1]))
    common = np.zeros(m, np.int32)
    place = np.empty(m, np.int64)
    found = np.zeros((m, anchor + 1), bool)
    for c in range(width - 1, -1, -1):
        place[order] = np.arange(m)
        order = order[np.argsort(symbols[c][order], kind="stable")]
        order = order[np.argsort(group[order], kind="stable")]
        s = symbols[c][order]
        joined = np.flatnonzero(same_group & (s > 0) & np.concatenate(([False], s[1:] == s[:-1])))
        fresh = np.zeros(m, np.int32)
        if len(joined):
            low, high = place[order[joined - 1]] + 1, place[order[joined]] + 1
            fresh[joined] = 1 + _least(common, low, high)
        common = fresh
        if c <= anchor:
            hit = np.flatnonzero(common >= length)
            found[order[hit], c] = True
            found[order[hit - 1], c] = True
    return found


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of ``values[low:high]``, every range with a member."""
    out = np.empty(len(low), values.dtype)
    gap = high - low
    table, span = values, 1
    while True:
        here = (gap >= span) & (gap < 2 * span)
        if here.any():
            out[here] = np.minimum(table[low[here]], table[high[here] - span])
        if not (gap >= 2 * span).any():
            return out
        table = np.minimum(table[:-span], table[span:])
        span *= 2


def _runs(columns: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbours in sorted ``columns``."""
    cut = np.flatnonzero(np.diff(columns) > 1)
    return list(zip(columns[np.concatenate(([0], cut + 1))].tolist(), columns[np.concatenate((cut, [len(columns) - 1]))].tolist()))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, most: int = 8192) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_bytes, n_removed, n_spans (maximal removed
    runs), kept (binary, the remaining bytes concatenated).

    Null texts are empty; texts below ``length`` bytes lose nothing; rows that repeat are
    copies of each other like any equal texts; an empty table gives an empty one.
    """
    if length < 2 * K:
        raise ValueError(f"length must be at least {2 * K}")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = docs.select(F.col(key).alias("id"), body.alias("body"))
    source = source.withColumn("txt", F.unhex(F.md5("body")))
    copies = source.groupBy("txt").agg(F.count("*").alias("copies"))
    copies = staged(copies.filter("copies > 1"), "copies")

    def anchor_rows(parts):
        import pyarrow as pa

        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in parts:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                names = piece.column(0).to_pylist()
                rows = [(names[i], *rest) for i, *rest in anchors(piece.column(1).to_pylist(), length)]
                columns = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["txt", "at", "lo", "hi", "anchor", "context"]
                )

    rows = source.filter(F.length("body") >= length).select("txt", "body")
    rows = staged(rows.mapInArrow(anchor_rows, "txt binary, at int, lo int, hi int, anchor long, context binary"), "anchors")
    contexts = rows.groupBy("context").agg(
        F.count("*").alias("n"), F.first("anchor").alias("anchor"), F.min(F.struct("txt", "at", "lo", "hi")).alias("one")
    )
    contexts = staged(contexts, "contexts")
    several = staged(contexts.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "several")
    unsettled = contexts.join(several, "anchor").select("anchor", "context", "n", "m", "one.*")

    # the texts of open contexts, each fetched from one copy
    wanted = unsettled.groupBy("txt").agg(F.collect_list(F.struct("anchor", "context", "n", "m", "at", "lo", "hi")).alias("open"))
    # 16 bytes for each text that repeats: sent to all tasks if their number allows it
    repeated_texts = copies.select("txt")
    repeated_texts = F.broadcast(repeated_texts) if copies.count() <= BROADCAST_TEXTS else repeated_texts
    single = source.join(repeated_texts, "txt", "left_anti").select("txt", "body")
    several_rows = source.join(repeated_texts, "txt", "left_semi").withColumn("pick", F.xxhash64("id"))
    chosen = several_rows.groupBy("txt").agg(F.min("pick").alias("pick"))
    first = several_rows.join(chosen, ["txt", "pick"]).select("txt", "body")
    fetched = single.union(first).join(wanted, "txt")

    def cut_out(parts):
        import pyarrow as pa

        names = ["anchor", "context", "n", "m", "txt", "at", "lo", "hi", "bytes"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in parts:
            made = []
            for name, whole, wants in zip(*(batch.column(c) for c in ("txt", "body", "open"))):
                name, whole = name.as_py(), whole.as_py()
                for w in wants.as_py():
                    made.append((w["anchor"], w["context"], w["n"], w["m"], name, w["at"], w["lo"], w["hi"], whole[w["lo"] : w["hi"] + length]))
            columns = zip(*made) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    pieces = fetched.mapInArrow(
        cut_out, "anchor long, context binary, n long, m long, txt binary, at int, lo int, hi int, bytes binary"
    )
    pieces = staged(pieces, "open-contexts")

    def columns(parts):
        import pyarrow as pa

        held: list[tuple] = []

        def settle() -> tuple[list, list, list]:
            unique = list({(r[0], r[1]): r for r in held}.values())  # a text may have come twice
            hits = repeated_columns([r[7] for r in unique], [r[4] - r[5] for r in unique], [r[0] for r in unique], length)
            names, los, his = [], [], []
            for r, hit in zip(unique, hits):
                if r[2] == 1 and hit.any():
                    for a, b in _runs(np.flatnonzero(hit)):
                        names.append(r[3])
                        los.append(r[4] - (length - K) + a)
                        his.append(r[4] - (length - K) + b)
            return names, los, his

        def out(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.binary()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())], names=["txt", "lo", "hi"]
            )

        for batch in parts:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "txt", "at", "lo", "hi", "bytes"))):
                if len(held) >= most and held[-1][0] != row[0]:
                    yield out(settle())
                    held.clear()
                held.append(row)
        if held:
            yield out(settle())

    few = pieces.filter(F.col("m") <= most).repartition("anchor").sortWithinPartitions("anchor", "context")
    settled = few.mapInArrow(columns, "txt binary, lo int, hi int")

    def windows(parts):
        import pyarrow as pa
        import xxhash

        for batch in parts:
            for lo in range(0, batch.num_rows, 100):
                piece = batch.slice(lo, 100)
                made = [
                    (xxhash.xxh3_128_digest(body[i : i + length]), n, name, start + i)
                    for n, name, start, body in zip(*(piece.column(c).to_pylist() for c in ("n", "txt", "lo", "bytes")))
                    for i in range(len(body) - length + 1)
                ]
                columns = zip(*made) if made else [[]] * 4
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["window", "n", "txt", "lo"])

    many = pieces.filter(F.col("m") > most).dropDuplicates(["context"])
    starts = many.mapInArrow(windows, "window binary, n long, txt binary, lo int")
    common = starts.groupBy("window").agg(F.sum("n").alias("n"), F.count("*").alias("c")).filter("c > 1").select("window")
    counted = starts.filter("n = 1").join(common, "window").select("txt", "lo", F.col("lo").alias("hi"))

    whole = rows.join(contexts.filter("n > 1").select("context"), "context", "left_semi").select("txt", "lo", "hi")
    found = whole.join(repeated_texts, "txt", "left_anti").union(settled).union(counted)
    spans = found.groupBy("txt").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    plan = copies.select("txt", "copies", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans")).union(
        spans.select("txt", F.lit(1).cast("long").alias("copies"), "spans")
    )
    joined = source.join(staged(plan, "spans"), "txt", "left").select(
        "id", "body", "spans", (F.coalesce("copies", F.lit(1)) > 1).alias("copied")
    )

    def strip(parts):
        import pyarrow as pa

        names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
        for batch in parts:
            for lo in range(0, max(batch.num_rows, 1), 500):
                piece = batch.slice(lo, 500)
                made = [_strip(*row, length) for row in zip(*(piece.column(c).to_pylist() for c in ("body", "spans", "copied")))]
                columns = list(zip(*made)) if made else [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    schema = joined.select("id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.col("body").alias("kept")).schema
    return joined.mapInArrow(strip, schema).withColumnRenamed("id", key)


def _strip(body: bytes, spans: list[dict] | None, copied: bool, length: int) -> tuple[int, int, int, bytes]:
    n = len(body)
    if copied and n >= length:
        return n, n, 1, b""
    if not spans:
        return n, 0, 0, body
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(body[at:lo])
        at = hi
    kept.append(body[at:])
    left = b"".join(kept)
    return n, n - len(left), len(runs), left
