"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to the capacity, so the plan of a packing depends on the histogram
of lengths alone and its size is bounded by the capacity, not by the rows. The plan:

1. large pieces, longest first, are cut into groups of equal cardinality and each group's
   length is rounded up to its longest;
2. the few rounded sizes are packed by the configuration linear program, solved by column
   generation, and rounded down to whole sequences;
3. actual pieces take the places of their groups, which leaves room where they are shorter;
4. the large pieces that rounding down left over and all small ones go, longest first,
   into the sequence they fit best.

Pieces are numbered within their length by a salted count, so that a length which a third
of all rows share is never in one task, and then look their place up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.bytebpe import encoder
from cartloom.llm.common import staged

#: One run of places: pieces ``first .. first+count-1`` of a length go, ``each`` to a
#: sequence, to the sequences from ``sequence`` on, the first of each at ``offset``.
PLAN_COLUMNS = ("length", "first", "count", "sequence", "each", "offset")


def cut(
    docs: DataFrame, path: str, end_id: int, capacity: int, text: str = "text", digest: bool = False
) -> DataFrame:
    """A row per piece with all columns of ``docs`` but the text, and ``piece``, ``start``,
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit). With ``digest``, ``ids_crc32``
    takes the place of the ids, which then never leave the task.

    A document is its ids (null text: none) and ``end_id``. Documents above ``capacity``
    ids are cut into pieces of exactly ``capacity``, the first piece taking the remainder.
    Columns of these four names are replaced.
    """
    new = ("piece", "start", "length", "ids_crc32" if digest else "ids")
    types = ("int", "long", "long", "long" if digest else "binary")
    kept = [c for c in docs.columns if c != text and c not in new]

    def encode(parts):
        import pyarrow as pa

        bpe, end = encoder(path), int(end_id).to_bytes(4, "little")
        for batch in parts:
            texts = batch.column(batch.schema.get_field_index("__text"))
            for lo in range(0, max(batch.num_rows, 1), 500):
                rows, pieces, starts, lengths, ids = [], [], [], [], []
                for row, value in enumerate(texts.slice(lo, 500).to_pylist(), lo):
                    whole = bpe.ids(value or "") + end
                    n = len(whole) // 4
                    at = -(-n // capacity) * capacity - n  # what the first piece lacks
                    bounds = [0, *range(capacity - at, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(row)
                        pieces.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        own = whole[4 * a : 4 * b]
                        ids.append(crc32(own) if digest else own)
                taken = batch.select(kept).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken.columns,
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(ids, pa.int64() if digest else pa.binary()),
                    ],
                    names=[*kept, *new],
                )
        pa.default_memory_pool().release_unused()

    schema = docs.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(new, types)]).schema
    source = docs.select(*kept, F.col(text).alias("__text"))
    return source.mapInArrow(encode, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns (how many of each size) and their counts in an optimum of the linear
    program, by column generation: a knapsack over the duals finds the next pattern."""
    k = len(sizes)
    s, b = np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // s).astype(float)
    basis_inverse = np.diag(1.0 / np.diag(columns))
    x = basis_inverse @ b
    for _ in range(60 * k):
        duals = basis_inverse.sum(axis=0)
        pattern, value = _knapsack(s, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = basis_inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        basis_inverse = np.linalg.inv(columns)
        x = np.maximum(basis_inverse @ b, 0)
    return [(tuple(int(v) for v in columns[:, j]), float(x[j])) for j in range(k) if x[j] > 0]


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = sizes <= c
        got = np.where(fits, best[np.where(fits, c - sizes, 0)] + values, -1.0)
        j = int(np.argmax(got))
        if got[j] > best[c - 1]:
            best[c], choice[c] = got[j], j
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        pattern[choice[c]] += 1
        c -= int(sizes[choice[c]])
    return pattern, float(best[capacity])


def plan(histogram: dict[int, int], capacity: int, groups: int = 40, small: int = 3) -> pd.DataFrame:
    """Places for ``histogram[length]`` pieces of each length, see ``PLAN_COLUMNS``.

    ``groups`` is the number of groups of equal cardinality; pieces of at most
    ``capacity / small`` are small.
    """
    used: dict[int, int] = defaultdict(int)  # pieces of a length placed so far
    rows: list[tuple[int, ...]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of sequences
    levels: list[int] = []
    next_sequence = 0

    def place(length: int, sequence: int, sequences: int, each: int, offset: int) -> None:
        rows.append((length, used[length], sequences * each, sequence, each, offset))
        used[length] += sequences * each

    def add_free(room: int, sequence: int, sequences: int) -> None:
        if room and sequences:
            if room not in free:
                insort(levels, room)
            free[room].append((sequence, sequences))

    full = histogram.get(capacity, 0)
    if full:
        place(capacity, 0, full, 1, 0)
        next_sequence = full
    large = sorted((n for n in histogram if capacity // small < n < capacity), reverse=True)
    total = sum(histogram[n] for n in large)
    if total:
        per_group = -(-total // groups)
        members: list[list[list[int]]] = []  # of each group: [length, count], longest first
        space = 0
        for n in large:
            left = histogram[n]
            while left:
                if not space:
                    members.append([])
                    space = per_group
                got = min(left, space)
                members[-1].append([n, got])
                left, space = left - got, space - got
        sizes = [g[0][0] for g in members]
        distinct = sorted(set(sizes), reverse=True)  # groups within one length are one size
        merged = [sum((g for g, n in zip(members, sizes) if n == d), []) for d in distinct]
        demand = [sum(c for _, c in g) for g in merged]
        for pattern, count in configurations(distinct, demand, capacity):
            sequences = int(count + 1e-6)
            left = [sum(c for _, c in g) for g in merged]
            for j, a in enumerate(pattern):
                if a:
                    sequences = min(sequences, left[j] // a)
            if sequences <= 0:
                continue
            runs = [(next_sequence, sequences, 0)]  # sequence, how many, filled
            next_sequence += sequences
            for j, a in enumerate(pattern):
                for _ in range(a):
                    after = []
                    for start, many, filled in runs:
                        while many:
                            n, c = merged[j][0]
                            got = min(many, c)
                            place(n, start, got, 1, filled)
                            after.append((start, got, filled + n))
                            start, many = start + got, many - got
                            if got == c:
                                merged[j].pop(0)
                            else:
                                merged[j][0][1] -= got
                    runs = after
            for start, many, filled in runs:
                add_free(capacity - filled, start, many)
    for n in sorted((n for n in histogram if n != capacity), reverse=True):
        left = histogram[n] - used[n]
        while left:
            at = bisect_left(levels, n)
            if at == len(levels):
                each = capacity // n
                sequences = left // each
                if sequences:
                    place(n, next_sequence, sequences, each, 0)
                    add_free(capacity - each * n, next_sequence, sequences)
                    next_sequence += sequences
                    left -= sequences * each
                if left:
                    place(n, next_sequence, 1, left, 0)
                    add_free(capacity - left * n, next_sequence, 1)
                    next_sequence += 1
                    left = 0
                break
            room = levels[at]
            start, many = free[room].pop()
            if not free[room]:
                del free[room]
                levels.pop(at)
            each = room // n
            sequences = min(many, left // each)
            if sequences:
                place(n, start, sequences, each, capacity - room)
                add_free(room - each * n, start, sequences)
                left -= sequences * each
                start, many = start + sequences, many - sequences
            if many and left:  # fewer pieces than would fill one more
                place(n, start, 1, left, capacity - room)
                add_free(room - left * n, start, 1)
                start, many, left = start + 1, many - 1, 0
            add_free(room, start, many)
    return pd.DataFrame(rows, columns=list(PLAN_COLUMNS), dtype="int64")


def best_plan(histogram: dict[int, int], capacity: int, groups: int = 40) -> pd.DataFrame:
    """The plan with fewest sequences: large pieces above a third of the capacity, or above a
    half of it. The latter are never packed together, so it is best-fit decreasing, and the plan
    kept is never worse than that."""
    plans = [plan(histogram, capacity, groups, small) for small in (3, 2)]
    return min(plans, key=lambda p: int((p["sequence"] + p["count"] // p["each"]).max()) if len(p) else 0)


def pack(
    pieces: DataFrame,
    capacity: int,
    order: list[str],
    groups: int = 40,
    rows_per_salt: int = 100_000,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence is longer than
    ``capacity`` and its pieces follow each other without gaps from offset 0.

    ``pieces`` has a ``length`` of 1 to ``capacity``; other columns are carried along.
    It is read three times, so pass a staged table. ``order`` names columns that tell rows
    apart and so fix which of the rows of one length gets which place; equal rows are
    interchangeable. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    rows = pieces.count()
    salt = F.pmod(F.xxhash64(*order), F.lit(max(1, rows // rows_per_salt))).alias("__salt")
    salted = pieces.withColumn("__salt", salt)
    counted = salted.groupBy("length", "__salt").count()
    ahead = F.sum("count").over(_running("length", "__salt")) - F.col("count")
    before = counted.select("length", "__salt", ahead.alias("__before"))
    # at most capacity rows
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("count")).collect()}
    if any(n is None or not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    table = best_plan(histogram, capacity, groups)
    # equal (length, salt) groups are bounded by about rows_per_salt, whatever the skew
    local = F.row_number().over(_within("length", "__salt", order)) - 1
    numbered = (
        salted.withColumn("__local", local)
        .join(before, ["length", "__salt"])
        .withColumn("__rank", F.col("__local") + F.col("__before"))
        .drop("__salt", "__local", "__before")
    )
    shared = spark.sparkContext.broadcast(
        {n: g.sort_values("first").to_numpy() for n, g in table.groupby("length")}
    )
    kept = [c for c in numbered.columns if c != "__rank"]

    def look_up(parts):
        import pyarrow as pa

        places = shared.value
        for batch in parts:
            n = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(n), "int64"), np.zeros(len(n), "int64")
            for length in np.unique(n):
                own = np.flatnonzero(n == length)
                runs = places[int(length)]
                run = runs[np.searchsorted(runs[:, 1], rank[own], "right") - 1]
                at = rank[own] - run[:, 1]
                sequence[own] = run[:, 3] + at // run[:, 4]
                offset[own] = run[:, 5] + at % run[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    out = numbered.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(look_up, out.schema)


def _running(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(keys[0]).orderBy(keys[1])


def _within(length: str, salt: str, order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(length, salt).orderBy(*order)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ``ids``: the pieces of each sequence in order of offset,
    at most the capacity of them."""
    part = F.struct("offset", "ids")
    joined = F.aggregate(
        F.array_sort(F.collect_list(part)),
        F.lit(b"").cast("binary"),
        lambda whole, p: F.concat(whole, p["ids"]),
    )
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id") -> DataFrame:
    """Cut and pack ``docs``: one row per piece, with ``key``, piece, start, length,
    ids_crc32, sequence_id, offset. Ids themselves: ``cut`` and ``sequences``."""
    pieces = cut(docs.select(key, "text"), path, end_id, capacity, digest=True)
    return pack(staged(pieces, "pieces"), capacity, [key, "piece"])
