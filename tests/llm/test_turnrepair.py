from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cartloom.llm import queries, turnrepair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def judged(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row, or an empty string."""
    seen, out = set(), []
    for role, text in rows:
        visible = VISIBLE.findall(text)
        if not visible:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


@cache
def cheapest(initials: str, faults: tuple[str, ...]) -> tuple[int, str]:
    """Least (cost, audit) over all edits, each state of the grammar reached by its least one."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for letter in "ua":
                    after = step.get((state, letter))
                    offer = (cost + 3, audit + "I")
                    if after and (after not in best or offer < best[after]):
                        best[after] = offer
        return best

    for initial, fault in zip(initials, faults):
        new = {}

        def offer(state, cost, audit):
            if state is not None and (state not in new or (cost, audit) < new[state]):
                new[state] = (cost, audit)

        for state, (cost, audit) in inserted(dict(best)).items():
            offer(state, cost + 4, audit + "D")
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                offer(step.get((state, initial)), cost + more, audit + "K")
                for letter in "ua":
                    offer(step.get((state, letter)), cost + 3 + more, audit + "R")
        best = new
    best = inserted(dict(best))
    return min(best[s] for s in ("", "a") if s in best)


def every_edit(initials: str, faults: list[str]) -> tuple[int, str]:
    """Least (cost, audit) by trying all."""
    made = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    choices = []
    for initial, fault in zip(initials, faults):
        own = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            own += [(more, "K", initial), (3 + more, "R", "u"), (3 + more, "R", "a")]
        choices.append([(3 * len(m) + c, "I" * len(m) + w, m + r) for m in made for c, w, r in own])
    choices.append([(3 * len(m), "I" * len(m), m) for m in made])
    return min(
        (sum(x[0] for x in edit), "".join(x[1] for x in edit))
        for edit in itertools.product(*choices)
        if GRAMMAR.fullmatch("".join(x[2] for x in edit))
    )


def rebuilt(rows: list[tuple[str, str]], audit: str) -> str:
    lines, state, at = [], "", 0
    for letter in audit:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        lines.append(f"{role}:{text}")
    return "\n".join(lines)


def plain_damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def order(row: tuple) -> tuple:
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())


def plain_report(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of damaged rows."""
    rows = sorted(rows, key=order)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    said = [(r, t) for _, r, t in rows]
    faults = judged(said)
    initials = "".join(r[:1] or "-" for r, _ in said)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(initials, tuple(faults)) if rows else (0, "")
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(rebuilt(said, audit).encode()).hexdigest())


def codes_of(initials: str, faults: list[str]) -> bytes:
    kind = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
    return bytes(3 * ("sua".find(i) if i in "sua" else 3) + kind[f] for i, f in zip(initials, faults))


def audit_of(codes: bytes, copies=None) -> tuple[int, str]:
    found = turnrepair.solved_chunk("", 0, 0, codes, copies or [1] * len(codes), bytes(64 * len(codes)), 0, -1, True)
    return found[4], found[3]


def made_rows(r: random.Random, n: int) -> tuple[str, list[str]]:
    return "".join(r.choice("suuuaaax") for _ in range(n)), [r.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(n)]


def test_every_short_conversation():
    for n in range(3):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product(["", "truncated", "blank"], repeat=n):
                assert audit_of(codes_of(initials, faults)) == every_edit("".join(initials), list(faults))
    r = random.Random(1)
    for _ in range(12):
        initials, faults = made_rows(r, 3)
        assert audit_of(codes_of(initials, faults)) == every_edit(initials, faults)


def test_long_conversations():
    r = random.Random(2)
    for _ in range(400):
        initials, faults = made_rows(r, r.randint(0, 60))
        assert audit_of(codes_of(initials, faults)) == cheapest(initials, tuple(faults))


def test_copies_are_deleted_rows():
    r = random.Random(3)
    for _ in range(200):
        initials, faults = made_rows(r, r.randint(1, 12))
        copies = [r.choice([1, 1, 3]) for _ in initials]
        whole = "".join(i * n for i, n in zip(initials, copies))
        each = tuple(f if not k else "duplicate" for f, n in zip(faults, copies) for k in range(n))
        assert audit_of(codes_of(initials, faults), copies) == cheapest(whole, each)


def test_nodes_solve_as_rows_do():
    r = random.Random(4)
    for _ in range(200):
        initials, faults = made_rows(r, r.randint(1, 40))
        codes = codes_of(initials, faults)
        cuts = sorted({0, len(codes), *(r.randrange(len(codes) + 1) for _ in range(4))})
        pieces = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        nodes = [turnrepair.unpacked(turnrepair.packed(turnrepair.node_of(p, [1] * len(p)))) for p in pieces]
        after = turnrepair.solve_nodes(nodes, 0, -1)
        rows = turnrepair.solve(codes, [1] * len(codes), 0, -1)
        assert after == [rows[b - 1] for b in cuts[1:]]
        half = turnrepair.joined([turnrepair.joined(nodes[:2]), turnrepair.joined(nodes[2:])])
        assert turnrepair.solve_nodes([half], 0, -1) == after[-1:]


def test_remembered_steps_are_few():
    r = random.Random(5)
    turnrepair._forward_from_zero.cache_clear()
    turnrepair._backward_from_zero.cache_clear()
    initials, faults = made_rows(r, 20_000)
    turnrepair.solve(codes_of(initials, faults), [1] * 20_000, 0, -1)
    turnrepair.solve(codes_of("s" * 5000, ["blank"] * 5000), [1] * 5000, 0, -1)
    assert turnrepair._forward_from_zero.cache_info().currsize < 2000
    assert turnrepair._backward_from_zero.cache_info().currsize < 2000


def conversations() -> list[tuple]:
    r = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "no", "Why?", " \t", "", None, "Line.\nLine!", "end. \n ", "ü", "a:b\nuser:c."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.choice([1, 2, 3, 6, 40])):
            turn = None if r.random() < 0.03 else turn if r.random() < 0.95 else turn + 3
            rows.append((conv, turn, r.choice(roles), r.choice(texts) if r.random() < 0.6 else f"Text {turn}."))
    rows += [(900, t, ["user", "assistant"][t % 2], f"Turn {t}{'.' * (t % 7 > 0)}") for t in range(700)]
    rows += [(901, 5, "user", "same.")] * 40 + [(902, None, None, None)]
    rows += rows[:5]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("chunk", [3, 50, 4096])
def test_query_equals_plain_code(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(turnrepair.repair, "__defaults__", (chunk,))
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(1)).withColumn("lines", F.lit("x"))
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()}
    expected = {conv: plain_report(found) for conv, found in plain_damage(rows).items()}
    assert got == expected


def test_interface(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "tool", "Yes."), (1, 2, "user", "cut"), (1, 2, "user", "cut")]
    found = turnrepair.repair(spark.createDataFrame(rows, SCHEMA))
    report = found.reports.first().asDict()
    cost, audit = cheapest("atuu", ("", "", "truncated", "duplicate"))
    assert (report["rows"], report["duplicate"], report["truncated"], report["cost"], report["audit"]) == (4, 1, 1, cost, audit)
    lines = [(r.role, r.text, r.edit) for r in found.repaired.orderBy("part", "place").collect()]
    assert GRAMMAR.fullmatch("".join(r[0] for r, _, _ in lines))
    assert "\n".join(f"{r}:{t}" for r, t, _ in lines) == rebuilt([r[2:] for r in rows], audit)
    none = turnrepair.damage(spark.createDataFrame([], SCHEMA))
    found = turnrepair.repair(none)
    assert found.reports.count() == 0 and turnrepair.digests(none, found).count() == 0
