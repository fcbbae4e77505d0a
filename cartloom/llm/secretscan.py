"""Secret scans: patterns, and a battery of randomness tests. DataFrame functions only.

Candidates beyond the patterns are all runs of 20 or more characters of an encoding, and the smallest
fitting encoding gives the alphabet. Three tests hold a candidate against uniform draws from it:
chi-squared of its character counts, the number of runs below and above the middle of the alphabet,
serial correlation of neighbours. What they reject is not random.

Short names pass such tests too, so the p-value holds the same three features against names:
in the likelihood-ratio form of the tests, the counts of characters, the runs of digits, upper
case, lower case and other characters, and the pairs of neighbours are compared between uniform
draws and a chain of names. The chain is counted from all runs of such characters of the table,
words included: class after class, and character after character with case folded. Under it the
ratio has mean one, so its inverse bounds the p-value (Markov), for each length and alphabet.
Among all candidates of an encoding and length class of the whole table the Benjamini-Hochberg rule
sets the p-value that still counts, so longer texts and larger tables do not raise the share of
false finds.

Work per text grows with n log n for n matches. Positions are code points; ends are exclusive.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import staged

KINDS = ("assign", "access", "hex", "random")
_KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = _KEYWORD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Pattern, alphabet in order, whether case is folded; the first that fits is inferred.
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", True),
    (r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", True),
    (r"^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, True),
    (r"^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER, False),
    (r".", _LOWER.upper() + _LOWER + _DIGITS + "+/_-", False),
)
#: Two-sided bound of each test's normal score.
BOUND = 3.3
FALSE_DISCOVERY = 0.001
#: Lower ends of the length classes.
LENGTHS = (20, 24, 32, 48, 96)
#: p-values are binned by this many steps to a power of ten.
STEPS, TOP = 4, 400

#: Characters of candidates, in the order of the tables of pairs.
SYMBOLS = _DIGITS + _LOWER.upper() + _LOWER + "+/_=-"
_SIDE = len(SYMBOLS)
#: Code points of a block of a text that is redacted.
BLOCK = 4096

_SPAN = "array<struct<s:int,e:int,t:string>>"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), of)[0]


def _prefix(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` folded over each prefix of an array, by doubling: log n passes over n values."""
    shifts = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def double(done: Column, d: Column) -> Column:
        return F.transform(done, lambda x, i: F.when(i >= d, of(x, F.get(done, i - d))).otherwise(x))

    return _let(values, lambda v: F.aggregate(F.filter(shifts, lambda d: d < F.size(v)), v, double))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start, end, matched text."""

    def spans(matches: Column) -> Column:
        before = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda p: F.length(p))
        ends = _prefix(F.zip_with(before, matches, lambda n, m: n + F.length(m)), lambda x, y: x + y)
        return F.zip_with(
            ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t"))
        )

    every = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(pattern), every).otherwise(F.array().cast(_SPAN))


def _pairs(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    head = F.slice(values, F.lit(1), F.size(values) - 1)
    return F.aggregate(F.zip_with(head, F.slice(values, F.lit(2), F.size(values) - 1), of), F.lit(0.0), lambda s, x: s + x)


def _accepts(run: Column, alphabet: str) -> Column:
    """Whether the battery finds ``run`` (a text) uniform over the alphabet; its length counts once."""
    a = float(len(alphabet))

    def step(done: Column, x: Column) -> Column:
        pair = done["last"] > -2
        turned = pair & ((done["last"] >= a / 2) != (x >= a / 2))
        return F.struct(
            x.alias("last"),
            (done["sum"] + x).alias("sum"),
            (done["squares"] + x * x).alias("squares"),
            (done["products"] + F.when(pair, done["last"] * x).otherwise(0.0)).alias("products"),
            (done["high"] + (x >= a / 2).cast("double")).alias("high"),
            (done["turns"] + turned.cast("double")).alias("turns"),
        )

    def judge(d: Column, first: Column) -> Column:
        n = F.length(run).cast("double")
        copies = F.transform(F.array_distinct(F.split(run, "")), lambda c: n - F.length(F.replace(run, c, F.lit(""))))
        squares = F.aggregate(copies, F.lit(0.0), lambda s, x: s + x * x)
        df = a - 1
        uneven = (F.cbrt(F.greatest(squares * a / n - n, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        turns = 1 + 2 * d["high"] * (n - d["high"]) / n
        spread = F.sqrt(F.greatest((turns - 1) * (turns - 2) / (n - 1), F.lit(0.0)))
        runs = F.when(spread > 0, (d["turns"] + 1 - turns) / spread).otherwise(F.lit(99.0))
        mean = d["sum"] / n
        below = d["squares"] - n * mean * mean
        beside = d["products"] - mean * (2 * d["sum"] - first - d["last"]) + (n - 1) * mean * mean
        serial = F.when(below > 1e-9, (beside / below + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        return (uneven <= BOUND) & (F.abs(runs) <= BOUND) & (F.abs(serial) <= BOUND)

    start = F.struct(F.lit(-2.0).alias("last"), *[F.lit(0.0).alias(c) for c in ("sum", "squares", "products", "high", "turns")])
    ranks = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double") - 1)
    first = F.instr(F.lit(alphabet), F.substring(run, 1, 1)).cast("double") - 1
    return _let(F.aggregate(ranks, start, step), lambda d: judge(d, first))


def _uniform(token: Column) -> Column:
    body, verdict = F.rtrim(token, F.lit("=")), None
    for pattern, alphabet, fold in reversed(ENCODINGS):
        passes = _accepts(F.lower(body) if fold else body, alphabet)
        verdict = passes if verdict is None else F.when(token.rlike(pattern), passes).otherwise(verdict)
    return verdict


def _encoding(token: Column) -> Column:
    which = F.lit(len(ENCODINGS) - 1)
    for k, (pattern, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        which = F.when(token.rlike(pattern), k).otherwise(which)
    return which


def _mixed(token: Column) -> Column:
    return token.rlike("[a-z]") & token.rlike("[A-Z]")


def pair_counts(texts: DataFrame, text: Column) -> dict[tuple[bool, str], int]:
    """How often each pair of neighbours occurs in runs of candidate characters with and without
    letters of both cases, over the whole table: at most two rows per pair of ``SYMBOLS``."""
    # one blank is split without a pattern, and each distinct piece meets the pattern once
    pieces = texts.select(F.explode(F.split(text, " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = pieces.select("n", F.explode(F.split("w", "[^A-Za-z0-9+/_=-]+")).alias("w")).filter(F.length("w") > 1)
    # a long run is cut into blocks of 64 and the character after them
    blocks = F.regexp_extract_all("w", F.lit("(?=(.{2,65})).{1,64}"), F.lit(1))
    cut = words.select("n", _mixed(F.col("w")).alias("mixed"), F.explode(blocks).alias("w"))
    at = F.sequence(F.lit(1), F.length("w") - 1)
    pairs = cut.select("n", "mixed", F.explode(F.transform(at, lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    return {(r[0], r[1]): r[2] for r in pairs.groupBy("mixed", "pair").agg(F.sum("n")).collect()}


def _class(c: str, mixed: bool) -> str:
    if c in _DIGITS:
        return "0"
    return "a" if c in _LOWER else ("A" if mixed else "a") if c.isalpha() else "-"


def name_chain(counts: dict[tuple[bool, str], int], mixed: bool) -> list[float]:
    """Minus the logarithm of the chance that a name goes on with the second symbol after the
    first, for all pairs of ``SYMBOLS``: its class after the first one's class, times the symbol
    (case folded) among those of its class after the first symbol. Names with letters of one case have
    one class of letters. Unseen pairs get a small share."""
    classes, seconds, firsts, after = Counter(), Counter(), Counter(), Counter()
    for (both, pair), n in counts.items():
        x, y = pair.lower()
        kind = _class(y, False)
        seconds[kind, y] += n
        firsts[kind] += n
        after[x, y] += n
        after[x, kind, None] += n
        if both == mixed:
            classes[_class(pair[0], mixed), _class(pair[1], mixed)] += n
    kinds = "0aA-" if mixed else "0a-"
    members = Counter(_class(c, False) for c in dict.fromkeys(SYMBOLS.lower()))

    def minus_log(x: str, y: str) -> float:
        cx, cy = _class(x, mixed), _class(y, mixed)
        of_class = (classes[cx, cy] + 0.5) / (sum(classes[cx, k] for k in kinds) + 0.5 * len(kinds))
        x, y = x.lower(), y.lower()
        kind = _class(y, False)
        single = (seconds[kind, y] + 0.5) / (firsts[kind] + 0.5 * members[kind])
        return -math.log(of_class) - math.log((after[x, y] + 2 * single) / (after[x, kind, None] + 2))

    return [minus_log(x, y) for x in SYMBOLS for y in SYMBOLS]


def _log_p(token: Column, mixed: list[float], single: list[float]) -> Column:
    """Minus the decimal logarithm of the p-value of a candidate among names."""
    body = F.rtrim(token, F.lit("="))
    rank = F.transform(F.split(body, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    pairs = F.length(body).cast("double") - 1

    def ratio(chain: list[float], rank: Column, alphabet: Column) -> Column:
        table = F.split(F.lit(",".join(map(repr, chain))), ",").cast("array<double>")  # folded once
        return _pairs(rank, lambda x, y: F.get(table, x * _SIDE + y)) - pairs * F.log(alphabet)

    alphabet = F.lit(_SIDE - 26.0)
    for pattern, letters, fold in reversed(ENCODINGS):
        if fold:
            alphabet = F.when(token.rlike(pattern), float(len(letters))).otherwise(alphabet)
    both = F.when(token.rlike(ENCODINGS[3][0]), 62.0).otherwise(float(_SIDE))
    # a side of the branch is computed only for its tokens
    found = F.when(_mixed(body), ratio(mixed, rank, both)).otherwise(ratio(single, rank, alphabet))
    return F.when(pairs > 0, F.greatest(found / math.log(10), F.lit(0.0))).otherwise(0.0)


def _length_class(length: Column) -> Column:
    return F.aggregate(F.array(*[F.lit(x) for x in LENGTHS]), F.lit(0), lambda s, x: F.when(length >= x, x).otherwise(s))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of (s, e, kind) in order of start, then kind.

    A null text counts as empty and has none. A random span that lies inside one of the
    patterns' spans is left out. Repeated rows are scanned like others, and an empty table
    gives an empty one. Keys may be null or repeat, as none is used. A text is scanned whole in
    one task, whatever its length and number of matches. A column named ``spans`` is replaced.
    """
    kept = [c for c in docs.columns if c != "spans"]
    body = F.coalesce(F.col(text), F.lit(""))
    secret = F.filter(
        found(body, ASSIGN), lambda x: F.length(F.regexp_extract(x["t"], f"^{_KEYWORD}([A-Za-z0-9+/_.=-]+)$", 1)) >= 12
    )
    counts = pair_counts(docs, body)
    mixed, single = name_chain(counts, True), name_chain(counts, False)

    def plain(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))

    first = docs.select(
        *kept,
        F.concat(plain(secret, "assign"), plain(found(body, ACCESS), "access"), plain(found(body, HEX), "hex")).alias("__base"),
        F.filter(found(body, CANDIDATE), lambda x: F.length(F.rtrim(x["t"], F.lit("="))) > 1).alias("__runs"),
    )
    tested = F.transform(
        "__runs",
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            (_encoding(x["t"]) * 1000 + _length_class(x["e"] - x["s"])).alias("group"),
            F.least(F.floor(_log_p(x["t"], mixed, single) * STEPS), F.lit(TOP)).cast("int").alias("bin"),
            _uniform(x["t"]).alias("uniform"),
        ),
    )
    first = staged(first.withColumn("__runs", tested), "scanned")
    counted = first.select(F.inline("__runs")).groupBy("group", "bin").count()
    least = _least_bins([tuple(r) for r in counted.collect()])  # a row per encoding, length class and bin
    def bound(x: Column) -> Column:
        value = F.lit(TOP + 1)
        for group, least_bin in least.items():
            value = F.when(x["group"] == group, F.lit(least_bin)).otherwise(value)
        return value

    random = plain(F.filter("__runs", lambda x: x["uniform"] & (x["bin"] >= bound(x))), "random")

    def outside(spans: Column) -> Column:
        """The spans but random ones within a base span: base ones that start no later reach less far."""
        last = len(KINDS) - 1
        reach = _prefix(F.transform(spans, lambda x: F.when(x["k"] < last, x["e"]).otherwise(0)), lambda x, y: F.greatest(x, y))
        return _let(reach, lambda far: F.filter(spans, lambda x, i: (x["k"] < last) | (F.get(far, i) < x["e"])))

    ordered = _let(F.array_sort(F.concat("__base", random)), outside)
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(ordered, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(names, x["k"]).alias("kind")))
    return first.select(*kept, spans.alias("spans"))


def _least_bins(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """The smallest bin of each group (encoding and length class) that the Benjamini-Hochberg rule accepts."""
    out: dict[int, int] = {}
    for group in {c[0] for c in counts}:
        own = sorted(((b, n) for c, b, n in counts if c == group), reverse=True)
        total, above = sum(n for _, n in own), 0
        for b, n in own:
            above += n
            if 10 ** (-b / STEPS) * total / above <= FALSE_DISCOVERY:
                out[group] = b
    return out


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The scanned rows without ``spans`` and with each stretch of the text that spans cover
    replaced by ``mark``; a text without spans, null too, stays as it is."""
    body = F.col(text)

    def part(blocks: Column, lo: Column, hi: Column) -> Column:
        """Code points ``lo`` to ``hi`` of the text, from the blocks that hold them."""
        first = F.floor(lo / BLOCK).cast("int")
        some = F.slice(blocks, first + 1, F.floor(hi / BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), lo - first * BLOCK + 1, hi - lo)

    def clean(blocks: Column, ends: Column) -> Column:
        def gap(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            return F.when(x["s"] >= before, F.concat(part(blocks, before, x["s"]), F.lit(mark))).otherwise("")

        tail = part(blocks, F.element_at(ends, -1), F.length(body))
        return F.concat(F.array_join(F.transform("spans", gap), ""), tail)

    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = _prefix(F.transform("spans", lambda x: x["e"]), lambda x, y: F.greatest(x, y))
    whole = _let(blocks, lambda b: _let(ends, lambda e: clean(b, e)))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(body)).drop("spans")
