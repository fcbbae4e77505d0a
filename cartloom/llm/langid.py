"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit one binary classifier, linear over hashed
byte n-grams of the lower-cased letters, predicts its sign. Margins are measured in units of the
usual margin of learned rows, so a clean text has them near +1 or -1 and one of two languages near 0
where their codewords differ. A text gets the language whose codeword loses least against the
margins, each bit weighted by how well its classifier separates the learned rows.

All that judges a text is set on learned rows, each predicted by classifiers fitted on the other half:
the units, the temperature of the score (its mean is the share of right answers), and how far a text of
some size may lie from its nearest codeword. A text is ambiguous if the second choice is close or if
it lies beyond that bound, as texts of unknown languages do.

The classifiers are fitted on at most ``sample_rows`` labelled rows, the same number of each
language, chosen by a hash of the key; the texts they get and those they predict are whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 4096
#: Classes of text size (powers of four of n-grams), rows that a class needs for a bound of its own, and
#: how far beyond the 99 % quantile of its learned rows' losses a text may lie.
SIZES, ENOUGH, SLACK = 12, 20, 1.65
#: ASCII that is not a lower-case letter becomes a space; other bytes stay.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Relative frequencies of the hashed byte bigrams and trigrams of a text's letters."""
    body = b" ".join(text.lower().encode().translate(_LETTERS).split())
    total = np.zeros(DIMENSIONS, np.float64)
    raw = np.frombuffer(b" " + body + b" ", np.uint8)
    for lo in range(0, len(raw), 1 << 20):
        b = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
        two = b[:-1] * 251 + b[1:]
        three = two[:-1] * 1009 + b[2:] * 7
        for grams in (two, three):
            mixed = (grams * np.uint32(2654435761)) >> np.uint32(20)
            total += np.bincount(mixed, minlength=DIMENSIONS)
    return (total / max(total.sum(), 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(k: int) -> np.ndarray:
    """``k`` codewords of signs. Up to six languages: all ways to divide them (each pair
    differs in 2^(k-2) bits). More: rows of a Hadamard matrix, which differ in half of the bits."""
    if k <= 6:
        columns = [[1 if i == 0 or not m >> (i - 1) & 1 else -1 for i in range(k)] for m in range(1, 1 << (k - 1))]
        return np.array(columns, float).T.reshape(k, -1)
    h = np.ones((1, 1))
    while len(h) < k + 1:
        h = np.block([[h, h], [h, -h]])
    return h[1 : k + 1, 1:]


def sizes(x: np.ndarray) -> np.ndarray:
    """The power of four of the number of n-grams behind each row of frequencies, from the least one."""
    least = np.where(x > 0, x, 1).min(1)
    return np.clip(np.floor(np.log(1 / least) / np.log(4)), 0, SIZES - 1).astype(int)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    scale: np.ndarray
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    unit: np.ndarray | float = 1.0  # the usual margin of each bit
    temperature: float = 1.0
    reach: np.ndarray | None = None  # the largest loss to the nearest codeword, by size

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((np.sqrt(x) * self.scale) @ self.weights + self.bias) / self.unit

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss against each codeword: 0 if all bits are as they should be, 2 if none is."""
        away = 1 - np.clip(margins, -1, 1)[:, None, :] * self.code[None]
        return (away * self.trust).sum(2) / self.trust.sum()

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of the weight, the runner-up's share, the loss."""
        loss = self.losses(margins)
        share = np.exp((loss.min(1, keepdims=True) - loss) / self.temperature)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = share[np.arange(len(share)), best]
        share[np.arange(len(share)), best] = 0
        return best, top, share.max(1), loss.min(1)

    def beyond(self, x: np.ndarray, loss: np.ndarray) -> np.ndarray:
        """Whether texts lie farther from their codeword than learned ones of their size."""
        return np.zeros(len(x), bool) if self.reach is None else loss > self.reach[sizes(x)]


def _descend(features: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of the bits by accelerated gradient descent."""
    w, b = np.zeros((features.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    seen_w, seen_b = w.copy(), b.copy()
    for t in range(rounds):
        p = -y / (1 + np.exp(np.clip(y * (features @ seen_w + seen_b), -30, 30))) / len(y)
        new_w = seen_w - 4 * (features.T @ p.astype(np.float32)) - 4e-5 * seen_w
        new_b = seen_b - 4 * p.sum(0).astype(np.float32)
        k = t / (t + 3)
        seen_w, seen_b = new_w + k * (new_w - w), new_b + k * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(x: np.ndarray, labels: list[str], rounds: int = 80) -> Model:
    """The classifiers of the bits, and what judges their margins. Fewer than four rows and a
    single language leave unit, temperature and bound as they are by default."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:  # nothing to tell apart
        return Model(languages, np.ones((len(languages), 1)), np.ones(1, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.ones(1, np.float32), np.ones(1))
    index = np.array([languages.index(v) for v in labels])
    y = code[index]
    roots = np.sqrt(x)
    scale = np.float32(1 / max(np.sqrt((roots**2).sum(1).mean()), 1e-9)) * np.ones(1, np.float32)
    features = roots * scale
    w, b = _descend(features, y, rounds)
    right = ((features @ w + b) * y > 0).mean(0)
    trust = np.maximum(2 * right - 1, 0.05)
    model = Model(languages, code, scale, w, b, trust / trust.sum() * len(trust))
    return _judged(model, x, features, index, rounds) if len(index) >= 4 else model


def _judged(model: Model, x: np.ndarray, features: np.ndarray, index: np.ndarray, rounds: int) -> Model:
    """The model with unit, temperature and bound from margins of rows that other rows predict."""
    y = model.code[index]
    # every second row of each language: rows are in order of language
    half = np.arange(len(index)) % 2 == 0
    margins = np.zeros(y.shape)
    for mine in (half, ~half):
        w, b = _descend(features[~mine], y[~mine], rounds)
        margins[mine] = features[mine] @ w + b
    model.unit = np.maximum(np.median(np.abs(margins), 0), 1e-6)
    best, _, _, loss = model.decode(margins / model.unit)
    correct = best == index
    wanted = (correct.sum() + 1) / (len(index) + 2)  # Laplace's rule, so never one
    lo, hi = 1e-3, 1e3
    for _ in range(60):
        model.temperature = float(np.sqrt(lo * hi))
        mean = model.decode(margins / model.unit)[1].mean()
        lo, hi = (model.temperature, hi) if mean > wanted else (lo, model.temperature)
    size, reach = sizes(x), np.full(SIZES, 2.0)
    for k in range(SIZES):
        near = loss[correct & (size >= k)]
        own = loss[correct & (size == k)]
        if len(own) >= ENOUGH:
            reach[k] = SLACK * np.quantile(own, 0.99)
        elif k and len(near) < ENOUGH:  # longer than nearly all learned texts
            reach[k] = reach[k - 1]
    model.reach = np.maximum.accumulate(reach[::-1])[::-1]  # a shorter text may lie as far as a longer one
    return model


def sample(docs: DataFrame, key: str, text: str, lang: str, sample_rows: int) -> tuple[np.ndarray, list[str]]:
    """Features and labels of at most ``sample_rows`` rows with a language, a null text
    or key counting as no row, evenly over the languages."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    sized = rows.groupBy("lang").count()
    languages = sized.count()
    each = max(sample_rows // max(languages, 1), 1)
    # about four times as many rows as wanted by a bound on the hash, then the first of them
    hashed = F.shiftrightunsigned(F.xxhash64("key"), 1).cast("double") / float(1 << 63)
    # a row per language: sent to the rows, which else would meet in a task per language
    few = F.broadcast(sized) if languages <= sample_rows else sized
    thin = rows.drop("text").join(few, "lang").filter(hashed * F.col("count") < 4.0 * each + 40)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = thin.dropDuplicates(["lang", "key"]).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= each)
    ids = sorted({r[0] for r in chosen.select("key").collect()})  # at most sample_rows
    rows = rows.filter(F.col("key").isin(ids)) if ids else rows.limit(0)
    # of rows that share a key and a language the least text counts
    rows = rows.groupBy("lang", "key").agg(F.min("text").alias("text")).select("text", "lang", "key")

    def features(parts):
        import pyarrow as pa

        for batch in parts:
            texts = batch.column(0).to_pylist()
            made = [counts(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(made, pa.binary())], names=["lang", "key", "x"]
            )

    found = rows.mapInArrow(features, rows.select("lang", "key", F.lit(b"").alias("x")).schema).collect()
    found.sort(key=lambda r: (str(r["lang"]), r["key"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, DIMENSIONS), np.float32)
    return x, [r["lang"] for r in found]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 1600) -> Model | None:
    """A model of the languages of ``docs``; none if no row has a language and a text."""
    x, labels = sample(docs, key, text, lang, sample_rows)
    return fit(x, labels) if labels else None


def predict(docs: DataFrame, model: Model | None, text: str = "text", close: float = 0.03) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous; columns of these names are replaced.

    A null text, one without a letter and any text under an empty model is ``und`` with score
    0 and not ambiguous. Ambiguous: the runner-up has at least ``close`` of the score.
    """
    new = ("lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*kept, F.col(text).alias("__text"))

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            for lo in range(0, max(batch.num_rows, 1), 256):
                piece = batch.slice(lo, 256)
                texts = piece.column(len(kept)).to_pylist()
                named, score, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
                if rows:
                    x = np.stack([counts(texts[i]) for i in rows])
                    best, top, second, loss = model.decode(model.margins(x))
                    unsure = (second >= close * top) | model.beyond(x, loss)
                    for i, b, s, u in zip(rows, best.tolist(), top.tolist(), unsure.tolist()):
                        named[i], score[i], unclear[i] = model.languages[b], s, u
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[: len(kept)], pa.array(named), pa.array(score, pa.float64()), pa.array(unclear)],
                    names=[*kept, *new],
                )

    schema = docs.select(*kept, F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(True).alias(new[2])).schema
    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The fourth of the keys that nothing is learned from."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2
