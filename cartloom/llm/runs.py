"""Periodic runs of words by an enhanced suffix array, without tree nodes.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
identical), at least ``max(24, 3 q)`` words long, that no neighbouring word extends.

1. Suffix array: the texts of a batch are numbered as one sequence of words, each closed by an
   end mark of its own, so that no comparison crosses texts; ranks are doubled, and only
   suffixes that still tie are sorted again.
2. The LCP table comes from the ranks of all doublings.
3. Branching tandems: an LCP interval of depth ``d`` is a stretch ``[lb, rb]`` of the suffix
   array. For each suffix ``i`` of every child but the largest, ``ISA[i + d]`` and ``ISA[i - d]``
   in ``[lb, rb]`` with a different next word tell a square of period ``d`` that cannot be moved
   one word to the right, hence ends where its run ends. The children are the stretches between
   the interval's own LCP values, found by next smaller values; no tree is kept.
4. The squares of one end are rotated to the left as far as words ``d`` apart agree. Squares that lie
   in a run with the same end whose period divides theirs are the run again, and merge into it.

A run has two suffixes, a period apart, that agree on ``length - q >= 16`` words. Texts whose LCP
table stays below 16 therefore hold no run, and steps 2 to 4 read the others only.

Null texts have no words. Texts are judged one by one: a text of any length is handled whole in the
task that reads it, with about 100 bytes a word and 4 more for each doubling.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import SPACE

WORD = re.compile(f"[^{SPACE}]+")
#: Words of a batch of texts that share one suffix array; a longer text is a batch of its own.
BATCH_WORDS = 1 << 17

Run = tuple[int, int, int]  # start, length, period


def suffix_ranks(words: np.ndarray, stop: int | None = None) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until they differ (or up to
    ``stop`` words). Equal words must have equal numbers and ends numbers of their own."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, n, size = [rank], len(words), 1
    if not n:
        return levels
    order = np.argsort(rank, kind="stable")
    tied = _tied(rank[order])
    while tied.any() and (stop is None or size < stop):
        at = np.flatnonzero(tied)  # places in the order whose suffixes still tie
        who = order[at]
        head = rank[who]
        follow = np.where(who + size < n, rank[np.minimum(who + size, n - 1)] + 1, 0)
        by = np.argsort(head * (n + 1) + follow, kind="stable")
        who, head, follow = who[by], head[by], follow[by]
        order[at] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
        # a rank is the first place of its group: groups keep their places when they are split
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        if not levels[1:]:
            rank = _first_places(rank, order)
            levels[0] = rank
        rank = rank.copy()
        rank[who] = first
        levels.append(rank)
        size *= 2
        tied = _tied(rank[order])
    return levels


def _first_places(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    sizes = np.bincount(rank)
    return (np.cumsum(sizes) - sizes)[rank]


def _tied(ranks: np.ndarray) -> np.ndarray:
    same = ranks[1:] == ranks[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


def lcp_table(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Words that the suffixes at places ``r - 1`` and ``r`` of the order share; 0 at place 0."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        shared[1:] += step
    return shared


def intervals(lcp: np.ndarray) -> np.ndarray:
    """A row ``(lb, rb, child_lb, child_rb, depth)`` for each child of an LCP interval that is not
    its largest."""
    n = len(lcp)
    values = lcp.tolist()
    rows: list[tuple[int, int, int, int, int]] = []
    #: open intervals: depth, left border, borders of the children so far
    stack: list[tuple[int, int, list[int]]] = []
    for r in range(1, n + 1):
        depth = values[r] if r < n else -1
        left = r - 1
        while stack and stack[-1][0] > depth:
            d, lb, borders = stack.pop()
            borders = [lb, *borders, r]
            sizes = [y - x for x, y in zip(borders, borders[1:])]
            largest = sizes.index(max(sizes))
            if d > 0:
                rows.extend(
                    (lb, r - 1, borders[j], borders[j + 1] - 1, d) for j in range(len(sizes)) if j != largest
                )
            left = lb
        if depth >= 0:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(r)
            else:
                stack.append((depth, left, [r]))
    return np.array(rows, np.int64).reshape(-1, 5)


def branching_tandems(words: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares whose next word breaks the period."""
    n = len(words)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    table = intervals(lcp)
    table = table[table[:, 4] <= n // 2]
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, periods = [], []
    sizes = table[:, 3] - table[:, 2] + 1
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + (1 << 20), 1 << 20), "right")
    for lo, hi in zip(cuts, [*cuts[1:], len(table)]):  # about a million suffixes at a time
        part, size = table[lo:hi], sizes[lo:hi]
        if not len(part):
            continue
        row = np.repeat(np.arange(len(part)), size)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        i = order[part[row, 2] + inner]
        lb, rb, d = part[row, 0], part[row, 1], part[row, 4]
        for other, first in ((i + d, i), (i - d, i - d)):
            inside = (other >= 0) & (other < n)
            at = place[np.clip(other, 0, n - 1)]
            hit = np.flatnonzero(inside & (at >= lb) & (at <= rb))
            start, period = first[hit], d[hit]
            after, again = start + 2 * period, start + period
            # ends have numbers of their own, so the square always has a next word
            branching = words[after] != words[again]
            starts.append(start[branching])
            periods.append(period[branching])
    both = np.unique(np.stack((np.concatenate(starts), np.concatenate(periods))), axis=1)
    return both[0], both[1]


def runs_of(words: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int, times: int) -> list[Run]:
    """All runs of one text (its last number is the end mark) of at least ``least`` words and
    ``times`` periods, by start, then period."""
    starts, periods = branching_tandems(words, order, lcp)
    # a run above two periods goes on to the left of its last square
    goes_on = (starts > 0) & (words[starts - 1] == words[starts + periods - 1])
    enough = goes_on | (2 * periods >= np.maximum(least, times * periods))
    starts, periods = starts[enough], periods[enough]
    by_end: dict[int, list[Run]] = {}
    found = []
    for k in np.argsort(periods, kind="stable"):
        i, d = int(starts[k]), int(periods[k])
        end = i + 2 * d
        if any(d % q == 0 and s <= i for s, _, q in by_end.get(end, ())):
            continue
        s = _leftmost(words, i, d)
        run = (s, end - s, d)
        by_end.setdefault(end, []).append(run)
        if run[1] >= max(least, times * d):
            found.append(run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _leftmost(words: np.ndarray, i: int, d: int) -> int:
    """The least start to which words ``d`` apart agree without a break up to ``i``."""
    step = 64
    while i > 0:
        lo = max(0, i - step)
        differ = np.flatnonzero(words[lo:i] != words[lo + d : i + d])
        if len(differ):
            return lo + int(differ[-1]) + 1
        i, step = lo, step * 2
    return 0


def find_runs(texts: list[list[str]], least: int = 24, times: int = 3) -> list[list[Run]]:
    """The runs of each list of words."""
    number: dict[str, int] = {}
    sizes = [len(t) for t in texts]
    ends = len(texts)
    flat = np.empty(sum(sizes) + ends, np.int64)
    bounds, at = [], 0
    for k, t in enumerate(texts):
        flat[at : at + len(t)] = [number.setdefault(w, len(number)) + ends for w in t]
        flat[at + len(t)] = k  # the end mark
        bounds.append((at, at + len(t) + 1))
        at += len(t) + 1
    # suffixes of one text that share this many words, the least that a run has
    least_shared = least - least // times
    shared = least_shared.bit_length() - 1
    levels = suffix_ranks(flat, 1 << shared)
    out: list[list[Run]] = []
    deep = levels[min(shared, len(levels) - 1)]
    for a, b in bounds:
        ranks = deep[a:b]
        if len(levels) <= shared or len(np.unique(ranks)) == len(ranks):
            out.append([])
            continue
        own = flat[a:b]
        own = np.where(own < ends, -1, own)
        own_levels = suffix_ranks(own)
        order = np.argsort(own_levels[-1], kind="stable")
        lcp = lcp_table(own_levels, order)
        out.append(runs_of(own, order, lcp, least, times) if lcp.max() >= least_shared else [])
    return out


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def best(runs: list[Run]) -> Run | None:
    """The run of greatest length over period; of equals the first, then that of least period."""
    top: Run | None = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def repeated(words: list[str], number: int) -> list[str]:
    """The planted form of a text: if ``number % 10`` is 0, its words from the place
    ``number // 10 % n`` repeat a first part of them; otherwise the words as they are."""
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole = words[a : a + p] * -(-(n - a) // p)
    return words[:a] + whole[: n - a]


OUTPUT = "n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, text: str = "text", planted: Column | None = None) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_words``, ``n_runs``, ``runs`` (by start,
    then period) and ``collapsed`` (the words left, joined by a space); columns of these names
    are replaced. ``planted``: an unsigned number by which ``repeated`` changes the words first
    (null: it does not)."""

    def make(words: list[str], runs: list[Run]):
        names = ("start", "length", "period")
        return len(words), len(runs), [dict(zip(names, r)) for r in runs], " ".join(collapsed(words, runs))

    return _each(docs, text, planted, OUTPUT, make)


def digests(docs: DataFrame, text: str = "text", planted: Column | None = None) -> DataFrame:
    """As ``periodic_runs``, with the best run and SHA-256 digests in place of runs and words."""

    def make(words: list[str], runs: list[Run]):
        top = best(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (
            len(runs),
            *(top or (None, None, None)),
            1000 * top[1] // top[2] if top else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest(),
        )

    return _each(docs, text, planted, DIGESTS, make)


def _each(docs: DataFrame, text: str, planted: Column | None, columns: str, make) -> DataFrame:
    new = [c.split(" ")[0] for c in columns.split(", ")]
    types = [c.split(" ")[1] for c in columns.split(", ")]
    kept = [c for c in docs.columns if c != text and c not in new]
    number = F.lit(None) if planted is None else planted
    source = docs.select(*kept, F.col(text).alias("__text"), number.cast("long").alias("__number"))
    schema = docs.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(new, types)]).schema

    def run(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def result(batch, lo: int, texts: list[list[str]]):
            made = [make(t, r) for t, r in zip(texts, find_runs(texts))]
            made_columns = [pa.array(c, arrow.field(n).type) for n, c in zip(new, zip(*made))]
            old = batch.slice(lo, len(texts)).columns[: len(kept)]
            return pa.RecordBatch.from_arrays([*old, *made_columns], names=[*kept, *new])

        for batch in parts:
            words, numbers = batch.column(len(kept)), batch.column(len(kept) + 1).to_pylist()
            texts, size, first = [], 0, 0
            for k in range(batch.num_rows):
                found = WORD.findall(words[k].as_py() or "")
                if numbers[k] is not None:
                    found = repeated(found, numbers[k])
                if texts and size + len(found) > BATCH_WORDS:
                    yield result(batch, first, texts)
                    texts, size, first = [], 0, k
                texts.append(found)
                size += len(found)
            if texts:
                yield result(batch, first, texts)

    return source.mapInArrow(run, schema)


def planted_number(key: str = "doc_id") -> Column:
    """Unsigned CRC-32 of the decimal key; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary"))
