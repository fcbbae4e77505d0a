"""Repair of conversation structure by Hirschberg's divide and conquer.

The rows of a conversation, in order of turn, are edited at least cost until the initials of
their roles read ``(s?(ua)+)?``: a system row or none, then user and assistant in turn, or nothing at all.

| edit | cost |
| --- | --- |
| Keep | 0 |
| Rerole to user or assistant | 3 |
| Delete | 4; the only edit of a blank or duplicate row |
| Insert a user or assistant row of empty text | 3 |

A truncated row that is not deleted costs 3 more. The initials D, I, K, R of the edits, in order, are
the audit; of all cheapest audits the least in ASCII order is taken. A row's first fault counts:
blank (no character but ASCII white space), duplicate (a row before it has its role and text),
truncated (its last such character is none of ``. ! ?``).

**Method.** What was read so far leaves one of four states: nothing, system, user, assistant. A forward
vector has, for each state, the least cost of the rows read and the rank of the least audit of that
cost; a backward vector has the least cost of the rows to come. They meet in the middle: the crossing
with the least sum, and of equals with the least rank, is on the audit wanted, and
fixes the end of the left half and the start of the right one. Both halves are solved the same way, so no
table of rows times states is kept.

**At scale.** Rows travel as (order, 32-byte digests, a code); equal rows are folded into one with a count
before they do. They are range-partitioned by conversation and turn, so one conversation may lie in
many tasks; each task writes chunks of at most ``CHUNK`` rows with the 4 x 4 costs and ranks between the
state before and the state after. Chunks of one conversation form a tree (task, 256 tasks, all).
Costs go up the tree and states down: each node meets its children in the middle like rows. At last
each chunk is solved between its two states. Texts are joined to the rows that stay by digest, once.

Handling: nulls in any column read as one space (a null turn comes first; a null conversation is one of its
own); rows of one turn are ordered by role, then by the SHA-256 of the text; other columns are
not carried along. A role that begins with none of s, u, a (an empty one too) must be reroled or deleted.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.llm.common import staged

#: Rows of a chunk.
CHUNK = 4096
#: Cost of what can't be.
NEVER = 1 << 60

# fixed values: the initials of the roles, the states they lead to, the costs and the grammar
INITIALS = "sua"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NOTHING, ASSISTANT)

#: (state, rival, lead): a state that costs more than its rival by over the lead is on no cheapest path. What
#: follows a system row may follow an assistant's; what follows nothing may too, with one row deleted
#: at most; and a user row is an insert away from an assistant's. So vectors less their least cost are few.
DOMINATED = (
    (SYSTEM, ASSISTANT, 0),
    (SYSTEM, USER, INSERT),
    (NOTHING, ASSISTANT, DELETE),
    (NOTHING, USER, DELETE + INSERT),
)

#: The state that the next inserted or reroled row leads to.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The states in which a row of an initial may be kept.
KEPT_IN = {"s": (NOTHING,), "u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,)}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

#: A row's code: 3 * (place of its initial in "sua", 3 for others) + fault (0 none, 1 truncated,
#: 2 to be deleted).
FINE, CUT_OFF, GONE = range(3)

Vector = tuple[tuple[int, int], ...]  # per state: cost, rank of the least audit


@cache
def edits(code: int) -> tuple[tuple[int, int, int, str], ...]:
    """What may be done with a row: (state before, state after, cost, letters). Inserts stand
    right before a row that stays, since a deletion before them is less in ASCII order."""
    place, fault = divmod(code, 3)
    out = [(p, p, DELETE, "D") for p in range(4)]
    if fault == GONE:
        return tuple(out)
    more = TRUNCATED if fault == CUT_OFF else 0
    for p in range(4):
        state, cost, letters = p, more, ""
        for _ in range(3):  # a third insert would lead back to a state already met
            out.append((p, NEXT[state], cost + REROLE, letters + "R"))
            if place < 3 and state in KEPT_IN[INITIALS[place]]:
                out.append((p, STATE_OF[INITIALS[place]], cost, letters + "K"))
            state, cost, letters = NEXT[state], cost + INSERT, letters + "I"
    return tuple(out)


@cache
def between(code: int, before: int, after: int) -> str | None:
    """The letters of the best edit of a row between two states."""
    return min(((c, w) for p, q, c, w in edits(code) if (p, q) == (before, after)), default=(0, None))[1]


@cache
def closing(state: int) -> str:
    """The inserts that end a conversation."""
    letters = ""
    while state not in ENDS:
        state, letters = NEXT[state], letters + "I"
    return letters


def end_costs(end: int) -> tuple[int, ...]:
    """The backward vector after the last row: of a fixed state, or (-1) of the end."""
    if end < 0:
        return tuple(INSERT * len(closing(q)) for q in range(4))
    return tuple(0 if q == end else NEVER for q in range(4))


def start_vector(state: int) -> Vector:
    return tuple((0, 0) if p == state else (NEVER, 0) for p in range(4))


def _ranked(best: list[tuple | None]) -> Vector:
    """Costs with ranks from (cost, rank before, what tells equals apart)."""
    order = sorted((b[1:], q) for q, b in enumerate(best) if b is not None)
    rank = {q: k for k, (_, q) in enumerate(order)}
    return tuple((b[0], rank[q]) if b is not None else (NEVER, 0) for q, b in enumerate(best))


@cache
def _forward_from_zero(vector: Vector, code: int) -> Vector:
    best: list[tuple | None] = [None] * 4
    for p, q, cost, letters in edits(code):
        if vector[p][0] < NEVER:
            offer = (vector[p][0] + cost, vector[p][1], letters)
            if best[q] is None or offer < best[q]:
                best[q] = offer
    for q, rival, lead in DOMINATED:
        if best[q] and best[rival] and best[q][0] > best[rival][0] + lead:
            best[q] = None
    return _ranked(best)


@cache
def _backward_from_zero(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    out = [NEVER] * 4
    for p, q, cost, _ in edits(code):
        if costs[q] < NEVER:
            out[p] = min(out[p], costs[q] + cost)
    return tuple(out)


def forward(vector: Vector, codes: bytes, copies) -> Vector:
    """The forward vector after rows. The steps on vectors less their least cost are few and
    remembered. Copies of a row after its first are deletions."""
    spent = 0
    for code, n in zip(codes, copies):
        vector = _forward_from_zero(vector, code)
        least = min(c for c, _ in vector)
        spent += least + DELETE * (n - 1)
        if least:
            vector = tuple((c - least if c < NEVER else NEVER, r) for c, r in vector)
    return tuple((c + spent if c < NEVER else NEVER, r) for c, r in vector)


def backward(costs: tuple[int, ...], codes: bytes, copies) -> tuple[int, ...]:
    spent = 0
    for code, n in zip(reversed(codes), reversed(copies)):
        costs = _backward_from_zero(costs, code)
        least = min(costs)
        spent += least + DELETE * (n - 1)
        if least:
            costs = tuple(c - least if c < NEVER else NEVER for c in costs)
    return tuple(c + spent if c < NEVER else NEVER for c in costs)


def crossing(vector: Vector, costs: tuple[int, ...]) -> int:
    """The state in which the cheapest and least audit passes between forward and backward."""
    return min(range(4), key=lambda q: (vector[q][0] + costs[q], vector[q][1]))


def solve(codes: bytes, copies, start: int, end: int) -> list[int]:
    """The state after each row, between a start and an end (-1: the end of the conversation)."""
    states = [0] * len(codes)
    open_parts = [(0, len(codes), start, end)]
    while open_parts:
        lo, hi, p, q = open_parts.pop()
        if hi - lo == 0:
            continue
        if hi - lo == 1:
            ahead = forward(start_vector(p), codes[lo:hi], copies[lo:hi])
            states[lo] = crossing(ahead, end_costs(q))
            continue
        mid = (lo + hi) // 2
        ahead = forward(start_vector(p), codes[lo:mid], copies[lo:mid])
        behind = backward(end_costs(q), codes[mid:hi], copies[mid:hi])
        meet = crossing(ahead, behind)
        open_parts += [(lo, mid, p, meet), (mid, hi, meet, q)]
    return states


Node = tuple[Vector, ...]  # a forward vector from each start state


def node_of(codes: bytes, copies) -> Node:
    return tuple(forward(start_vector(p), codes, copies) for p in range(4))


def across(vector: Vector, node: Node) -> Vector:
    """The forward vector after a node's rows."""
    best: list[tuple | None] = [None] * 4
    for p, (cost, rank) in enumerate(vector):
        for q, (more, within) in enumerate(node[p]):
            if cost < NEVER and more < NEVER:
                offer = (cost + more, rank, within)
                if best[q] is None or offer < best[q]:
                    best[q] = offer
    return _ranked(best)


def joined(nodes: list[Node]) -> Node:
    out = tuple(start_vector(p) for p in range(4))
    for node in nodes:
        out = tuple(across(v, node) for v in out)
    return out


def solve_nodes(nodes: list[Node], start: int, end: int) -> list[int]:
    """As ``solve``, over nodes instead of rows."""
    states = [0] * len(nodes)
    open_parts = [(0, len(nodes), start, end)]
    while open_parts:
        lo, hi, p, q = open_parts.pop()
        mid = max(lo + 1, (lo + hi) // 2)
        ahead = start_vector(p)
        for node in nodes[lo:mid]:
            ahead = across(ahead, node)
        behind = end_costs(q)
        for node in reversed(nodes[mid:hi]):
            behind = tuple(
                min(min(c + b, NEVER) for (c, _), b in zip(node[s], behind)) for s in range(4)
            )
        meet = crossing(ahead, behind)
        if hi - lo == 1:
            states[lo] = meet
        else:
            open_parts += [(lo, mid, p, meet), (mid, hi, meet, q)]
    return states


def packed(node: Node) -> list[int]:
    return [x for vector in node for cost_rank in vector for x in cost_rank]


def unpacked(numbers) -> Node:
    n = [int(x) for x in numbers]
    return tuple(tuple((n[8 * p + 2 * q], n[8 * p + 2 * q + 1]) for q in range(4)) for p in range(4))


# ---------------------------------------------------------------- on tables


@dataclass(frozen=True)
class Repair:
    """``reports``: a row per conversation with ``rows``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbours whose roles may not follow each other), ``cost``,
    ``audit``. ``repaired``: the rows after the repair, with ``part``, ``place`` (their order),
    ``role``, ``text`` and ``edit`` (I, K or R). Both have ``conv_id``."""

    reports: DataFrame
    repaired: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``) with planted faults, by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes ``. ! ?`` out of it, 3
    repeats it (``copies`` 2), 4 makes it a user's. Nulls read as one space."""

    def spelled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(spelled("text"), ".!?", ""))
    return (
        conversations.select("conv_id", "turn", "role", "text", kind.alias("__kind"))
        .filter("__kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("__kind") == 4, "user").otherwise(spelled("role")).alias("role"),
            text.otherwise(spelled("text")).alias("text"),
            F.when(F.col("__kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def _with_digests(rows: DataFrame) -> DataFrame:
    """``conv`` (a key without nulls), ``turn``, ``role``, ``text``, ``copies``, ``row_key`` (equal for
    equal rows) and ``same_key`` (equal for rows of a conversation with equal role and text)."""

    def spelled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    out = rows.select(
        F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))).alias("conv"),
        "turn",
        spelled("role").alias("role"),
        spelled("text").alias("text"),
        copies.cast("long").alias("copies"),
    )

    def digest(*parts: Column) -> Column:
        sized = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
        return F.unhex(F.sha2(F.concat(*sized), 256))

    turn = F.when(F.col("turn").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("turn").cast("string")))
    # the text is read once: both keys are made of its digest
    out = out.withColumn("__text", F.sha2("text", 256))
    return out.withColumn("same_key", digest(F.col("conv"), F.col("role"), F.col("__text"))).withColumn(
        "row_key", F.concat(F.unhex("__text"), F.unhex(F.sha2(F.concat(F.hex("same_key"), turn), 256)))
    )


def repair(rows: DataFrame, chunk: int = CHUNK) -> Repair:
    """The repair of every conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text`` and,
    if a row stands for several, ``copies``)."""
    keyed = _with_digests(rows)
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    blank = trimmed == ""
    ended = F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    place = F.coalesce(F.instr(F.lit(INITIALS), F.left(F.col("role"), F.lit(1))), F.lit(0))
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    thin = keyed.select(
        "conv", "turn", "role", "row_key", "same_key", "copies",
        initial.alias("initial"), blank.alias("blank"), ended.alias("ended"),
    )
    # equal rows are folded before they travel
    folded = thin.groupBy("conv", "turn", "role", "row_key", "same_key", "initial", "blank", "ended").agg(
        F.sum("copies").alias("copies")
    )
    folded = staged(folded, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (
        folded.filter("NOT blank")
        .groupBy("same_key")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("same_key", "first")
    )
    later = F.coalesce(F.col("first") != order, F.lit(False))
    judged = folded.join(firsts, "same_key", "left").select(
        "conv", "turn", "role", "row_key", "copies", "initial", "blank", "ended", (later & ~F.col("blank")).alias("later")
    )
    chunks = staged(_chunks(judged, chunk), "turn-chunks")
    ends = _states(chunks)
    bodies = chunks.select("conv", "part", "piece", "codes", "copies", "keys")
    solved = bodies.join(ends, ["conv", "part", "piece"], "left").select(
        "conv", "part", "piece", "codes", "copies", "keys",
        F.coalesce("start", F.lit(NOTHING)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"),
        F.coalesce("last", F.lit(True)).alias("last"),
    )
    solved = staged(solved.mapInArrow(_solve_chunks, SOLVED), "solved-turns")
    reports = _reports(folded, chunks, solved)
    lines = solved.select("conv", "part", "piece", F.posexplode("lines").alias("at", "line")).select(
        "conv", "part", (F.shiftleft(F.col("piece").cast("long"), 32) + F.col("at")).alias("place"), "line.*"
    )
    texts = keyed.groupBy("row_key").agg(F.first("role").alias("own_role"), F.first("text").alias("own_text"))
    kept = lines.filter("row_key IS NOT NULL").join(texts, "row_key")
    made = lines.filter("row_key IS NULL")
    back = rows.select("conv_id").distinct().select(
        "conv_id",
        F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))).alias("conv"),
    )
    whole = kept.select(
        "conv", "part", "place", F.coalesce("role", "own_role").alias("role"), F.col("own_text").alias("text"), "edit"
    ).unionByName(made.select("conv", "part", "place", "role", F.lit("").alias("text"), "edit"))
    repaired = whole.join(back, "conv").drop("conv")
    return Repair(reports.join(back, "conv").drop("conv"), repaired.select("conv_id", "part", "place", "role", "text", "edit"))


CHUNKS = (
    "conv string, part int, piece int, codes binary, copies array<long>, keys binary, node array<long>, "
    "first int, last int, rows long, blank long, duplicate long, truncated long, illegal long"
)
SOLVED = (
    "conv string, part int, piece int, audit string, cost long, "
    "lines array<struct<row_key:binary,role:string,edit:string>>"
)
#: Bytes of a row key.
KEY = 64


def _legal(a: int, b: int) -> bool:
    return a < 3 and b < 3 and INITIALS[a] + INITIALS[b] in FOLLOWS


class _Chunk:
    """Rows of one conversation on their way into a chunk."""

    def __init__(self, conv: str, part: int, piece: int, before: int | None):
        self.conv, self.part, self.piece, self.last = conv, part, piece, before
        self.codes, self.copies, self.keys = bytearray(), [], []
        self.first: int | None = None
        self.counts = [0, 0, 0, 0, 0]  # rows, blank, duplicate, truncated, illegal

    def add(self, key: bytes, n: int, initial: int, blank: bool, later: bool, ended: bool) -> None:
        self.codes.append(3 * initial + (GONE if blank or later else FINE if ended else CUT_OFF))
        self.copies.append(n)
        self.keys.append(key)
        counts = self.counts
        counts[0] += n
        counts[1] += n if blank else 0
        counts[2] += 0 if blank else n if later else n - 1
        counts[3] += not (blank or later or ended)
        counts[4] += n - 1  # copies have one role, which never follows itself
        counts[4] += self.last is not None and not _legal(self.last, initial)
        self.first = initial if self.first is None else self.first
        self.last = initial

    def row(self) -> tuple:
        codes = bytes(self.codes)
        node = packed(node_of(codes, self.copies))
        ends = (self.first, self.last, *self.counts)
        return (self.conv, self.part, self.piece, codes, self.copies, b"".join(self.keys), node, *ends)


def _chunks(judged: DataFrame, most: int) -> DataFrame:
    """The rows of ``repair`` in order, a chunk of one conversation to a row."""
    order = ["conv", "turn", "role", "row_key"]

    def collect(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        part, open_chunk, done = TaskContext.get().partitionId(), None, []

        def batch(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _arrow_chunks())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in CHUNKS.split(", ")])

        for table in parts:
            for conv, key, n, initial, blank, later, ended in zip(*(c.to_pylist() for c in table.columns)):
                if open_chunk is None or open_chunk.conv != conv:
                    if open_chunk is not None:
                        done.append(open_chunk.row())
                    open_chunk = _Chunk(conv, part, 0, None)
                elif len(open_chunk.codes) >= most:
                    done.append(open_chunk.row())
                    open_chunk = _Chunk(conv, part, open_chunk.piece + 1, open_chunk.last)
                open_chunk.add(key, n, initial, blank, later, ended)
                if len(done) >= 500:
                    yield batch(done)
                    done = []
        if open_chunk is not None:
            done.append(open_chunk.row())
        if done:
            yield batch(done)

    dealt = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv", "row_key", "copies", "initial", "blank", "later", "ended").mapInArrow(collect, CHUNKS)


def _arrow_chunks():
    import pyarrow as pa

    whole, small, many = pa.int64(), pa.int32(), pa.list_(pa.int64())
    return [pa.string(), small, small, pa.binary(), many, pa.binary(), many, small, small, *[whole] * 5]


def _states(chunks: DataFrame) -> DataFrame:
    """``start``, ``end`` and ``last`` of the chunks of conversations that have several."""
    nodes = chunks.select("conv", "part", "piece", "node")
    several = nodes.groupBy("conv").count().filter("count > 1").select("conv")
    level = nodes.join(several, "conv").select(
        "conv", F.col("part").cast("long").alias("up"), F.col("piece").cast("long").alias("at"), "node"
    )
    levels = [staged(level, "nodes")]
    highest = levels[0].agg(F.max("up")).first()[0] or 0
    name = "conv string, at long, node array<long>"

    def compose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        node = joined([unpacked(x) for x in part.sort_values("at")["node"]])
        return pd.DataFrame({"conv": [key[0]], "at": [key[1]], "node": [packed(node)]})

    while len(levels) == 1 or highest:
        above = levels[-1].groupBy("conv", "up").applyInPandas(compose, name)
        levels.append(staged(above.withColumn("up", F.shiftright("at", 8)), "nodes"))
        highest >>= 8

    def part_ways(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        start, end, last = int(part["start"].iloc[0]), int(part["end"].iloc[0]), bool(part["last"].iloc[0])
        after = solve_nodes([unpacked(x) for x in part["node"]], start, end)
        return pd.DataFrame(
            {
                "conv": part["conv"],
                "up": part["up"],
                "at": part["at"],
                "start": [start, *after[:-1]],
                "end": after,
                "last": [False] * (len(after) - 1) + [last],
            }
        )

    # the top level hangs on one node per conversation
    ends = levels[-1].select("conv", "up").distinct().select(
        "conv", "up", F.lit(NOTHING).alias("start"), F.lit(-1).alias("end"), F.lit(True).alias("last")
    )
    for level in reversed(levels):
        found = level.join(ends, ["conv", "up"]).groupBy("conv", "up")
        found = staged(found.applyInPandas(part_ways, "conv string, up long, at long, start int, end int, last boolean"), "ways")
        ends = found.select("conv", F.col("at").alias("up"), "start", "end", "last")
    return found.select(
        "conv", F.col("up").cast("int").alias("part"), F.col("at").cast("int").alias("piece"), "start", "end", "last"
    )


def _solve_chunks(parts):
    import pyarrow as pa

    line = pa.struct([("row_key", pa.binary()), ("role", pa.string()), ("edit", pa.string())])
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(line)]
    names = ["conv", "part", "piece", "audit", "cost", "lines"]
    for table in parts:
        if table.num_rows:
            rows = [solved_chunk(*r) for r in zip(*(c.to_pylist() for c in table.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def solved_chunk(conv, part, piece, codes, copies, keys, start, end, last) -> tuple:
    """Audit, cost and the rows that are left of a chunk."""
    audit, lines, cost, state = [], [], 0, start
    for k, (after, code, n) in enumerate(zip(solve(codes, copies, start, end), codes, copies)):
        letters = between(code, state, after)
        for letter in letters:
            if letter == "I":
                state = NEXT[state]
                lines.append({"row_key": None, "role": ROLES[state], "edit": "I"})
            elif letter != "D":
                role = ROLES[NEXT[state]] if letter == "R" else None
                lines.append({"row_key": keys[KEY * k : KEY * k + KEY], "role": role, "edit": letter})
        cost += letters.count("I") * INSERT + (letters[-1] == "R") * REROLE + (letters[-1] == "D") * DELETE
        cost += (letters[-1] != "D" and code % 3 == CUT_OFF) * TRUNCATED + DELETE * (n - 1)
        audit.append(letters + "D" * (n - 1))
        state = after
    if last:
        for letter in closing(state):
            state = NEXT[state]
            audit.append(letter)
            lines.append({"row_key": None, "role": ROLES[state], "edit": "I"})
            cost += INSERT
    return conv, part, piece, "".join(audit), cost, lines


def _reports(folded: DataFrame, chunks: DataFrame, solved: DataFrame) -> DataFrame:
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = folded.groupBy("conv").agg(F.coalesce(span.cast("long"), F.lit(0)).alias("gaps"))
    counts = chunks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("rows", "blank", "duplicate", "truncated", "illegal")])
    # neighbours that lie in two tasks: a row per task of a conversation
    ends = chunks.groupBy("conv", "part").agg(F.min_by("first", "piece").alias("first"), F.max_by("last", "piece").alias("last"))
    before = F.lag("last").over(Window.partitionBy("conv").orderBy("part"))
    letter = [F.when(c < 3, F.substring(F.lit(INITIALS), c + 1, F.lit(1))).otherwise("-") for c in (before, F.col("first"))]
    wrong = before.isNotNull() & ~F.concat(*letter).isin(*FOLLOWS)
    borders = ends.select("conv", wrong.cast("long").alias("wrong")).groupBy("conv").agg(F.sum("wrong").alias("wrong"))
    piece = F.array_sort(F.collect_list(F.struct("part", "piece", "audit")))
    audits = solved.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(piece, lambda x: x["audit"]), "").alias("audit")
    )
    return (
        counts.join(gaps, "conv")
        .join(borders, "conv")
        .join(audits, "conv")
        .select("conv", "rows", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("wrong")).alias("illegal"), "cost", "audit")
    )


def digests(conversations: DataFrame, found: Repair) -> DataFrame:
    """A row per conversation of ``conversations`` (those without rows too): the report of ``found``
    and ``repaired_sha256``, of its repaired ``role:text`` lines. The lines of a conversation are
    hashed one after the other as they stream by; none is held."""
    lines = found.repaired.select("conv_id", "part", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    schema = dealt.select("conv_id", F.lit("").alias("sha")).schema

    def stream(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        key_type = to_arrow_schema(schema).field(0).type
        current, state, keys, shas = None, None, [], []
        for table in parts:
            for key, line in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
                if state is None or key != current:
                    if state is not None:
                        keys.append(current)
                        shas.append(state.hexdigest())
                    current, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n")
                    state.update(line.encode())
            if len(keys) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(shas)], names=["conv_id", "sha"])
                keys, shas = [], []
        if state is not None:
            keys.append(current)
            shas.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(shas)], names=["conv_id", "sha"])

    hashed = dealt.select("conv_id", "line").mapInArrow(stream, schema)
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        every.join(found.reports, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        .drop("conv_id")
        .join(hashed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
        .select(
            F.col("id").alias("conv_id"),
            *zeros,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
